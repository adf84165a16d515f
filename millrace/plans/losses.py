"""Loss settings: any accepted layout becomes one complete table of modules."""

from __future__ import annotations

from typing import NamedTuple


class Module(NamedTuple):
    """Defaults of a module; flat maps old top-level keys to its fields; needs_views: of no use on single views."""

    defaults: dict
    flat: dict = {}
    block: str = ""
    implied_by: str = ""
    needs_views: bool = False


def _entry(value) -> dict:
    """A module's setting as fields: a switch alone only sets enable."""
    return dict(value) if isinstance(value, dict) else {"enable": bool(value)}


def settle(config: dict, modules: dict[str, Module], core: set[str]) -> tuple[dict[str, dict], list[str]]:
    """(fields of every module, remarks).

    config["modules"] wins over an old block, which wins over old flat keys. A module that
    says nothing of enable has its default, or is on where its implied_by field is set.
    """
    given = {n: _entry(v) for n, v in (config.get("modules") or {}).items()}
    remarks = [f"unknown module {n}" for n in given if n not in modules]
    out = {}
    used = {"modules"} | core
    for name, m in modules.items():
        fields = dict(given.get(name, {}))
        if m.block and m.block in config:
            used.add(m.block)
            remarks.append(f"old block {m.block}" + (" ignored" if fields else ""))
            fields = fields or _entry(config[m.block])
        for old, field in m.flat.items():
            if old in config:
                used.add(old)
                remarks.append(f"old key {old}" + (" ignored" if field in fields else ""))
                fields.setdefault(field, config[old])
        on = bool(fields.get(m.implied_by)) if m.implied_by else bool(m.defaults.get("enable"))
        out[name] = m.defaults | fields | {"enable": bool(fields.get("enable", on))}
    return out, remarks + [f"unknown key {k}" for k in config if k not in used]


def without_effect(settled: dict[str, dict], modules: dict[str, Module], many_views: bool) -> list[str]:
    """Modules that are on and weighted but need several views of a record where there is one."""
    return [n for n, f in settled.items() if f["enable"] and f.get("weight", 1) and modules[n].needs_views and not many_views]
