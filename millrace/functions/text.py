"""String functions of ingestion, prompts and lexical mining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ranges whose characters form two-character tokens.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Null for the empty string and 0."""
    text = c.cast("string")
    return F.when((text != "") & (text != "0"), text)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*cs)


def first_truthy(*cs: Column) -> Column:
    return F.coalesce(*(truthy(c) for c in cs))


def tokens(c: Column) -> Column:
    """ASCII words, and pairs of neighbouring characters in runs of CJK; a run of one is its own token."""
    ascii_words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(c, F.lit(CJK + "+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(ascii_words, F.flatten(pairs))


def content_key(text: Column, images: Column | None = None) -> Column:
    """Key of a record's content: stripped text and image paths, not its instruction."""
    parts = strip(F.coalesce(text, F.lit("")))
    joined = parts if images is None else F.concat_ws("\u0001", parts, images)
    return F.concat(F.lit("h:"), F.substring(F.sha2(joined, 256), 1, 20))


def namespaced(tag: Column, raw: Column) -> Column:
    """tag::raw; a null id stays null, an empty tag adds nothing."""
    return F.when(F.coalesce(tag, F.lit("")) == "", raw).otherwise(F.concat(tag, F.lit("::"), raw))


def split_namespace(c: Column) -> Column:
    """struct(tag, raw) at the first ::"""
    at = F.instr(c, "::")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).alias("tag"), F.when(at > 0, F.substring(c, at + 2, F.char_length(c))).otherwise(c).alias("raw"))


def resolve_path(path: Column, root: str) -> Column:
    """Absolute and remote paths as they are, others below root."""
    return F.when(path.rlike(r"^(/|https?://|data:|file://)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def placeholders(text: Column, images: Column, keep: bool = False, mark: str = "<image>") -> Column:
    """struct(text, error): marks must be as many as images; stripped, what is between them is joined by a space."""
    parts = F.split(text, mark)
    n = F.size(parts) - 1
    bare = F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), " ")
    wrong = (n > 0) & (n != images)
    return F.struct(F.when(wrong, None).otherwise(text if keep else F.when(n > 0, bare).otherwise(text)).alias("text"), F.when(wrong, F.lit("placeholder count")).alias("error"))


def punctuated(instruction: Column) -> Column:
    """With a full stop unless it ends in punctuation."""
    s = strip(instruction)
    return F.when(s.rlike(r"\p{P}$") | (s == ""), s).otherwise(F.concat(s, F.lit(".")))


def prompt(instruction: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.when(strip(instruction) != "", strip(instruction)), text)
