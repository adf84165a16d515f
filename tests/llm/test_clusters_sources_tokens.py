"""Centroid clustering, source divergence and BPE against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import centroids, divergence, word_bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


# --- centroid clustering ---
def plain_clusters(rows, d, k, rounds, scale=1024, seed=3):
    """With Python's integers alone: rows (id, components)."""
    x = [(i, [math.floor(Fraction(v) * scale) for v in vec]) for i, vec in rows if vec is not None and len(vec) == d and all(v is not None and np.isfinite(v) for v in vec)]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in first[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min(range(len(cs)), key=lambda n: (far(v, cs[n]), n))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, v in x:
            own[near(v)].append(v)
        cs = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(own, cs)]
    return sorted(((i, near(v), far(v, cs[near(v)])) for i, v in x), key=str), cs


@pytest.mark.parametrize("size", [1.0, 1e3, 1e9, 1e14])
def test_clusters_are_exact_at_every_magnitude(spark, size):
    r = random.Random(int(size))
    rows = [(i, [r.uniform(-size, size) for _ in range(5)]) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(4)] + [(300, [0.0] * 5), (301, [-0.0] * 5), (7, [size] * 5), (None, [size / 3] * 5)]
    bad = [(400, None), (401, [1.0] * 4), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [1.0, float("nan"), 0.0, 0.0, 0.0]), (404, [float("inf")] * 5)]
    df = spark.createDataFrame([(*x, "extra") for x in rows + bad], "vec_id long, embedding array<double>, distance string").repartition(5)
    made, cs, told = centroids.cluster(df, d=5, k=4, rounds=4)
    want, plain = plain_clusters(rows, 5, 4, 4)
    assert cs == plain
    got = [(r.vec_id, r.cluster, r.distance) for r in made.collect()]
    assert sorted(got, key=str) == [(i, c, d if d < 2**63 else None) for i, c, d in want]
    assert sum(t["rows"] for t in told) == len(want) and [t["inertia"] for t in told] == [sum(d for _, c, d in want if c == n) for n in range(4)]


def test_products_stay_below_the_bound_or_are_integers():
    x = np.array([[2**26, -(2**26)], [3, 4]], dtype=np.int64)
    c = np.array([[-(2**26), 2**26]], dtype=np.int64)
    want = [[2 * (2**27) ** 2], [(3 + 2**26) ** 2 + (4 - 2**26) ** 2]]
    assert centroids.distances(x, c).tolist() == want
    assert centroids.distances(x[1:], x[1:]).dtype == np.int64
    assert centroids.sums(np.array([[2**60]] * 40, dtype=np.int64), np.zeros(40, dtype=int), 2).tolist() == [[40 * 2**60], [0]]
    assert centroids.whole(np.array([[-0.5, 1e308]]), 1024).tolist() == [[-512, int(1e308) * 1024]]


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 4.0])], "vec_id long, embedding array<float>")
    made, cs, _ = centroids.cluster(df, d=2, k=8)
    assert len(cs) == 2 and {r.distance for r in made.collect()} == {0}
    assert centroids.cluster(df.limit(0), d=2)[0].count() == 0 and centroids.cluster(df, d=3)[0].columns == ["vec_id", "cluster", "distance"]


# --- source divergence ---
def plain_divergence(rows, least=3, top=200):
    import re

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        mine = [d for d in docs if d[0] == lang]
        terms = {t for _, _, ws in mine for t in ws if sum(t in set(x) for _, _, x in mine) >= least}
        count = lambda t, pick: sum(ws.count(t) for _, s, ws in mine if pick(s))
        sources = {s for _, s, _ in mine}

        def shares(pick, terms=terms, count=count):
            n = {t: count(t, pick) for t in terms}
            return n, {t: 1 + 10**9 * (c + 1) // (sum(n.values()) + len(terms)) for t, c in n.items()}

        _, whole = shares(lambda s: True)
        of = {s: shares(lambda x, s=s: x == s) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (n, p) in of.items():
            pair = [(sum(f(p[t], of[o][1][t]) for t in terms), o) for o in sources if o != s]
            term = [(f(p[t], whole[t]), t) for t in terms if n[t] > 0 and p[t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items[:most])]
    return sorted(out)


def some_documents(seed=2, n=120):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Été", "ÉTÉ", "x-y", "naïve2go", "字字"]
    rows = [(" ".join(r.choices(words[i % 5 * 4 :], k=r.randint(0, 30))), f"l{i % 2}", f"s{i % 7}") for i in range(n)]
    rows += [(None, "l0", "quiet"), ("", "l1", None), ("12 34", None, "s0"), ("alone here", "single", "s1"), (rows[0][0], "l0", "s0")] * 2
    return rows


@pytest.mark.parametrize(("block", "cube", "heavy"), [(256, 1 << 21, 0.5), (3, 40, 0.5), (256, 1 << 21, -1.0), (2, 64, 2.0)])
def test_divergence_by_definition(spark, monkeypatch, block, cube, heavy):
    """Blocks of few sources, tiles of few terms, all terms heavy, none heavy: the same sums."""
    for name, value in (("BLOCK", block), ("CUBE", cube), ("HEAVY", heavy), ("HELD", 1), ("COUNTED", 50)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, term string").repartition(4)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, top=6).collect())
    assert got == plain_divergence(rows, top=6)


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(none).count() == 0
    long = spark.createDataFrame([("word " * 300_000 + "other", "l", s) for s in "abc"], "text string, lang string, source string")
    got = {(r.source, r.item): r.value for r in divergence.audit(long).where("part = 'pair'").collect()}
    assert len(got) == 6 and set(got.values()) == {0}


def test_shares_leave_no_long(spark):
    p = spark.range(1).select(divergence.share(F.lit(9 * 10**12).cast("long"), F.lit(10**13).cast("long"), F.lit(10**6).cast("long")).alias("p")).first().p
    assert p == 1 + 10**9 * (9 * 10**12 + 1) // (10**13 + 10**6)


# --- BPE ---
@pytest.fixture(scope="module")
def codec():
    return word_bpe.Codec(word_bpe.Vocabulary.read(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def texts():
    r = random.Random(3)
    signs = "abcdeéΣσςßİI'’.<|>!end123 \t\n\x1c\x1f\x85　字한각" + chr(0x301) + "ñ😀"
    out = ["", " ", "Hello  World's café 123", "<|endoftext|>", "a<|startoftext|>'s<|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΌΣ", "don't we'll I'm they've", "x" * 127, "x" * 128, "x" * 129, "ab" * 4000, "a\x1cb \x1d\x1e", "e" + chr(0x301) + " é"]
    out += ["".join(r.choice(signs) for _ in range(r.randint(0, 200))) for _ in range(400)]
    out += ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (100, 128, 129, 500, 5000)]
    return out


def test_ids_and_text_are_the_librarys(codec, library):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(codec, t) == want, repr(t)
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_both_ways_to_merge_are_one(codec):
    r = random.Random(8)
    for n in (1, 2, 30, 200, 900):
        word = "".join(r.choice("etaoin") for _ in range(n)).encode()
        ids = [codec.inner[b] for b in word[:-1]] + [codec.last[word[-1]]]
        one, other = (way([*range(n + 1)], ids[:]) for way in (codec.scanned, codec.linked))
        assert one == other and one[0][0] == 0 and one[0][-1] == n and len(one[0]) == len(one[1]) + 1


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 2)
    small = word_bpe.Codec(word_bpe.Vocabulary.read(PATH))
    for t in texts()[:60]:
        assert ids_of(small, t) == library.encode(t, add_special_tokens=False).ids
    assert len(small.remembered) <= 2


def test_bpe_on_a_table(spark, library):
    rows = [(i, t, "mine", [9]) for i, t in enumerate(texts()[:40])] + [(None, None, "mine", None), (3, "again", "mine", None), (3, "again", "mine", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = word_bpe.decode(word_bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows) and {r.decoded_in for r in got} == {"mine"} and got[0].ids_in == [9]
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in word_bpe.digests(df, PATH).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        if r.doc_id != 3:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(np.array(want, dtype="<u4").tobytes()), sha(library.decode(want, skip_special_tokens=False).encode()))
    odd = spark.createDataFrame([([0, None, -1, 10**9],), (None,)], "ids array<int>")
    assert [r.decoded for r in word_bpe.decode(odd, PATH).collect()] == ["!", ""]
    assert word_bpe.digests(df.limit(0), PATH).count() == 0


def test_another_kind_of_tokenizer_is_refused(tmp_path):
    with pytest.raises(ValueError, match="end mark"):
        word_bpe.Vocabulary.read(public.path("byte_bpe_50k.json"))
