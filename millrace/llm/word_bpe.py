"""BPE encoding and decoding of whole texts with a public vocabulary of word pieces.

A text is cut at white space into runs, and nothing that the tokenizer does reaches over
white space: special tokens are taken out of a run as they are written, what lies between
is brought to NFC and lower case and cut into words, a word's UTF-8 bytes are written as
the vocabulary's signs, and its last sign carries the end mark.

A word of up to SHORT signs is merged in two contiguous arrays, the boundaries of its parts
and the rank of each adjacent pair of parts: the least rank is looked for from the left,
the boundary inside that pair deleted, and the ranks of its two neighbours refreshed. Longer
words keep the pairs in a heap over linked parts, which gives the same parts without the
quadratic scan. Runs come again and again, so their ids are remembered; the memory of a
worker is bounded by starting over at REMEMBERED runs, which changes no result.

The vocabulary's size is fixed, so it is broadcast. Each text is a row of its own in a map
without a shuffle, so a hot source or a lost executor costs nothing but its tasks.

Defined results: a null or empty text has no ids and decodes to the empty text; a text of
any length, with or without white space, is encoded whole; bytes that are no UTF-8 count as
U+FFFD; which signs are letters, and their lower case, is as in the Unicode of the installed
Python and regex modules, which for signs new since Unicode 15.1 can differ from the
tokenizer library's; an id outside the vocabulary is skipped by decode(), as is a null; null, repeated or
extra columns stay as they are, and a column of the user's called like a result is kept as
<name>_in; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.columns import col, renamed

#: Signs of a word up to which its least rank is found by scanning.
SHORT = 128
#: Runs of up to RUN characters that a worker remembers at once.
REMEMBERED, RUN = 400_000, 64
#: Fixed values, from the vocabulary file: what is a word, and the mark of a word's end.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: White space between runs. str.split() takes these four signs for white space as well.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
NONE = 1 << 60


def signs() -> list[str]:
    """The printable sign of each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids of pieces, ranks of mergeable pairs, and the special tokens; a few MB whatever the corpus."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        if m["type"] != "BPE" or m.get("end_of_word_suffix") != END or m.get("byte_fallback") or m.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is no BPE of words with an end mark")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        return cls(dict(m["vocab"]), {p: i for i, p in enumerate(pairs)}, {t["content"]: t["id"] for t in d["added_tokens"]})


@dataclass
class Codec:
    """Encodes and decodes texts, one after the other."""

    vocabulary: Vocabulary
    remembered: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.word = regex.compile(WORD)
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.pieces = [""] * (max([*v.ids.values(), *v.special.values()], default=-1) + 1)
        for piece, i in [*v.ids.items(), *v.special.items()]:
            self.pieces[i] = piece
        self.inner, self.last = ([v.ids.get(x + mark, -1) for x in signs()] for mark in ("", END))
        self.ranks = {v.ids[a] << 32 | v.ids[b]: r for (a, b), r in v.ranks.items()}
        self.made = [v.ids[a + b] for a, b in v.ranks]

    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """(boundaries, ids) of the parts of one word; a byte that the vocabulary lacks is in none."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        cuts = [*range(len(word) + 1)]
        if -1 in ids:
            cuts = [*[c for c, i in zip(cuts, ids) if i >= 0], len(word)]
            ids = [i for i in ids if i >= 0]
        return self.scanned(cuts, ids) if len(ids) <= SHORT else self.linked(cuts, ids)

    def scanned(self, cuts: list[int], ids: list[int]) -> tuple[list[int], list[int]]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i] = made[least]
            del cuts[i + 1], ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NONE)
        return cuts, ids

    def linked(self, cuts: list[int], ids: list[int]) -> tuple[list[int], list[int]]:
        rank, made = self.ranks.get, self.made
        n = len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap: list[tuple[int, int, int]] = []

        def meet(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, j))

        for i in range(n - 1):
            meet(i, i + 1)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            meet(before[i], i)
            meet(i, after[i])
        kept = [i for i in range(n) if ids[i] >= 0]
        return [*[cuts[i] for i in kept], cuts[-1]], [ids[i] for i in kept]

    def between(self, s: str) -> list[int]:
        """Ids of what stands between special tokens. Lower case is taken sign by sign, so a sigma at a word's end is no special case."""
        out: list[int] = []
        t = s.lower() if s.isascii() else unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()
        for w in self.word.findall(t):
            out += self.parts(w.encode())[1]
        return out

    def run(self, s: str) -> bytes:
        """Ids of a text without white space, as little-endian unsigned 32-bit integers."""
        known = self.remembered.get(s)
        if known is not None:
            return known
        out: list[int] = []
        at = 0
        for m in self.special.finditer(s) if self.special else ():
            out += self.between(s[at : m.start()])
            out.append(self.vocabulary.special[m[0]])
            at = m.end()
        out += self.between(s[at:])
        made = np.array(out, dtype="<u4").tobytes()
        if len(s) <= RUN:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[s] = made
        return made

    def encode(self, text: str) -> bytes:
        runs = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.run, runs))

    def decode(self, ids: list[int]) -> str:
        """Pieces joined by spaces: the vocabulary file states no decoder that would take the end marks for spaces."""
        pieces, n = self.pieces, len(self.pieces)
        return " ".join([pieces[i] for i in ids if i is not None and 0 <= i < n])


def shared(spark: SparkSession, path: str):
    """The vocabulary of a file on the driver, for all workers."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


_codecs: dict[int, Codec] = {}


def codec(vocabulary) -> Codec:
    """A worker's codec of a broadcast vocabulary, made once."""
    v = vocabulary.value
    if id(v) not in _codecs:
        _codecs.clear()
        _codecs[id(v)] = Codec(v)
    return _codecs[id(v)]


def plain(b) -> str:
    return b.decode("utf-8", "replace") if b else ""


def text_bytes(text: str) -> Column:
    return F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, as an array."""
    v = shared(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(v)
        for s in parts:
            yield pd.Series([np.frombuffer(c.encode(plain(b)), dtype="<u4").astype(np.int32) for b in s])

    df = renamed(docs, out)
    source = f"{text}_in" if out.lower() == text.lower() else text
    return df.withColumn(out, ids(text_bytes(source)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each row's ids, special tokens included."""
    v = shared(df.sparkSession, path)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(v)
        for s in parts:
            yield pd.Series(["" if x is None else c.decode([None if pd.isna(i) else int(i) for i in x]) for x in s])

    kept = renamed(df, out)
    source = f"{ids}_in" if out.lower() == ids.lower() else ids
    return kept.withColumn(out, text(col(source)))


def digests(docs: DataFrame, path: str, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""
    v = shared(docs.sparkSession, path)
    kind = docs.select(col(row)).schema[0].dataType.simpleString()

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(v)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                b = c.encode(plain(x.as_py()))
                n.append(len(b) // 4)
                ids_sha.append(hashlib.sha256(b).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(np.frombuffer(b, dtype="<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select(col(row).alias("id"), text_bytes(text).alias("b")).mapInArrow(pass_over, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("id", row)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
