"""Driver-side configuration: manifests, nested settings, job order. No DataFrames here."""

from __future__ import annotations

import copy
import json
from pathlib import Path


def build_manifest(root: str, datasets: list[str], tags: dict[str, str] | None = None) -> tuple[list[dict], dict[str, str]]:
    """(entries, skipped with reason) of datasets whose query, corpus and qrels files are there."""
    entries, skipped = [], {}
    for name in datasets:
        at = Path(root) / name
        need = {"queries": at / "queries.jsonl", "corpus": at / "origin_corpus.jsonl", "qrels": at / "qrels.jsonl"}
        missing = [k for k, p in need.items() if not p.exists()]
        if missing:
            skipped[name] = "missing " + ", ".join(missing)
            continue
        mix = at / "mix_corpus.jsonl"
        entries.append({"name": name, "tag": (tags or {}).get(name, name.lower())} | {k: str(p) for k, p in need.items()} | ({"mix_corpus": str(mix)} if mix.exists() else {}))
    return entries, skipped


def load_manifest(text: str, only: list[str] | None = None) -> list[dict]:
    """Entries with tags that no two share; the mix corpus falls back to the corpus."""
    rows = [r for r in json.loads(text) if not only or r["name"] in only]
    for r in rows:
        r.setdefault("tag", r["name"].lower())
        r.setdefault("mix_corpus", r.get("corpus"))
    tags = [r["tag"] for r in rows]
    if len(set(tags)) != len(tags):
        raise ValueError("two datasets share a tag")
    return rows


def merged(base: dict, over: dict) -> dict:
    """Nested settings: tables merge, anything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def with_settings(conf: dict, settings: list[str]) -> dict:
    """conf with "a.b=value" settings; values are JSON where they can be."""
    out = copy.deepcopy(conf)
    for s in settings:
        key, _, raw = s.partition("=")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        at = out
        *parents, last = key.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def view_count(explicit: int | None, k: int | None) -> int:
    """Explicit over the general setting over 1; -1 stands for all."""
    n = explicit if explicit is not None else k if k is not None else 1
    if n == 0 or n < -1:
        raise ValueError("a number of views, or -1 for all")
    return n


#: The instructions of tasks without settings of their own.
INSTRUCTIONS = {
    "default": {
        "query": "Represent the user's query for retrieving relevant content.",
        "doc": "Represent the candidate content for retrieval.",
    },
    "multiview": {
        "query_text": "Given a text query, retrieve the matching content.",
        "query_image": "Given an image query, retrieve the matching content.",
        "doc_text": "Represent this text document for retrieval.",
        "doc_image": "Represent this image document for retrieval.",
    },
}


def instruction_tables(source: str | None) -> dict[str, dict[str, str]]:
    """task -> role or role_modality -> instruction: those built in, of a JSON text, or of a JSON or YAML file.

    Settings may hold the tables as data.task_instructions, as task_instructions, or be them.
    """
    said = (source or "").strip()
    if said in ("", "builtin"):
        return copy.deepcopy(INSTRUCTIONS)
    if not said.startswith("{") and not Path(said).is_file():
        raise FileNotFoundError(f"{said}: neither built in nor JSON nor a file")
    if said.startswith("{"):
        conf = json.loads(said)
    elif said.endswith((".yaml", ".yml")):
        import yaml

        conf = yaml.safe_load(Path(said).read_text(encoding="utf-8")) or {}
    else:
        conf = json.loads(Path(said).read_text(encoding="utf-8"))
    if not isinstance(conf, dict):
        raise TypeError("instructions must be a table")
    for at in (conf.get("data"), conf):
        if isinstance(at, dict) and isinstance(at.get("task_instructions"), dict):
            return dict(at["task_instructions"])
    return dict(conf)
