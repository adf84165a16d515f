"""HTML main text by site style trees.

The pages of a host are merged into one style tree. An element node is the path of elements (tag,
classes, role) from the root; its presentation on a page is the sequence of its child elements; its content
nodes are the blocks of text right under it. For a node that m distinct pages have:

- presentation importance: entropy of its presentations over the pages, base m. A
  menu looks the same on every page, articles hardly ever do;
- content importance: the mean, over its distinct blocks, of 1 - log_m(pages with the
  block). It is 0 if every page has the same blocks, 1 if no two share one;
- importance of its text: (1 - g^l) * presentation of the element around it + g^l * content, where l is the
  number of that element's presentations and g = 0.9: what a varied presentation shows counts the more.

Blocks of nodes under LEAST are removed. Little evidence counts little: a node's importance on a host is
shrunk towards that in the tree of all hosts merged, and this towards a prior, as if
PRIOR pages stood for it. The prior is 1, or 0 for elements that tags or class names hint at
(WEAK): such hints decide only where no tree does. Pages of equal text count once, so that copies of an
article do not make it look like a notice. Where the tree would leave a page nothing, it removes nothing.

Three kinds are removed whatever the tree says, as their text can be new on every page: what an element or
role declares not to be main text (DECLARED), adverts and reader comments (APART, by whole class names),
and hidden elements.

Defined results: null or empty html gives an empty text; a null url is a host of its
own, the empty one; markup of any brokenness and depth is read to its end, in linear time; repeated rows are
extracted alike; an empty table gives no rows. All columns but html stay; a user's column `text` is called text_in.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col, fresh, renamed
from millrace.llm.redirects import host_of
from millrace.storage import materialize, release, small_batches

LEAST, PRIOR, GAMMA = 0.5, 8, 0.9
#: Node numbers that are broadcast at most; beyond, a host's meet its pages in a salted join.
BROADCAST_NODES, SALTS = 500_000, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select option button".split())
#: Of these the slash of <svg/> ends the element; of the others HTML passes it over.
FOREIGN = frozenset(["svg"])
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FRAME = frozenset("html body article main".split())
DECLARED = frozenset("nav footer aside menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
#: Whole class names; a name that merely starts like one (ad-hoc-query, comments-on-kant) says nothing.
APART = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad sponsored sponsored-content comment comments commentlist comment-list comment-section comments-area comments-list comments-section comment-body comment-form comment-respond user-comments reader-comments disqus disqus_thread respond replies".split())
WEAK_TAGS = frozenset(["form", "header"])
WEAK = frozenset("menu nav navbar breadcrumb breadcrumbs sidebar widget footer masthead topbar cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent notice popup modal newsletter subscribe share social related pagination pager toolbar banner promo".split())
OPENS = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
SIGN = re.compile(r"[>\"']")
ATTR = re.compile(r"""(?<![^\s"'/])(class|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>"']|\Z)""", re.I)
SPACES = re.compile(r"\s+")
CLOSES = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
#: What a node's text is: kept unless a tree says else, removed unless a tree says else, removed.
KEEP, HINTED, OFF = 0, 1, 2


def _end(page: str, pos: int, last: dict[str, int]) -> int:
    """Where the tag that starts before pos ends; a quoted value may hold >, an open quote may not."""
    while m := SIGN.search(page, pos):
        pos = m.end()
        if m[0] == ">":
            return pos
        before = page[max(0, m.start() - 8) : m.start()].rstrip()
        if before.endswith("=") and pos <= last[m[0]]:
            pos = page.index(m[0], pos) + 1
    return len(page)


class Element:
    __slots__ = ("tag", "key", "kind", "children", "form", "block")

    def __init__(self, tag: str, key: int, kind: int, form: int, block: bool):
        self.tag, self.key, self.kind, self.form, self.block = tag, key, kind, form, block
        self.children: list[str] = []


class Page:
    """A page's blocks in order: (node, the node around it, kind, text); styles: the presentations of every node."""

    def __init__(self, page: str):
        self.blocks: list[list] = []
        self.styles: dict[int, set[int]] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        root = Element("", 0, KEEP, 0, True)
        stack, opened = [root], Counter()
        buf: list[str] = []
        forms: list[bool] = [False]  # does the form hold an article or a heading?
        mute = 0
        last = {q: page.rfind(q) for q in "\"'"}
        ends = {"-->": page.rfind("-->"), "]]>": page.rfind("]]>")}
        closes: dict[str, list[tuple[int, int]]] = {}  # where the end tags of raw elements are, looked for once each
        pos, n = 0, len(page)

        def around() -> Element:
            return next(e for e in reversed(stack) if e.block)

        def flush() -> None:
            if buf:
                text = SPACES.sub(" ", html_lib.unescape("".join(buf))).strip()
                buf.clear()
                if text:
                    blocks = (e for e in reversed(stack) if e.block)
                    at = next(blocks)
                    self.blocks.append([at.key, next(blocks, root).key, at.kind, text, at.form])

        def pop() -> None:
            nonlocal mute
            e = stack.pop()
            opened[e.tag] -= 1
            if e.block:
                self.styles.setdefault(e.key, set()).add(xxhash.xxh64_intdigest(" ".join(e.children)))
            else:
                mute -= 1

        while pos < n:
            m = OPENS.search(page, pos)
            if not mute:
                buf.append(page[pos : m.start() if m else n])
            if not m:
                break
            pos = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0])
                if close:
                    pos = page.index(close, pos) + 3 if pos <= ends[close] else n
                else:
                    pos = _end(page, pos, last)
                continue
            start, pos = pos, _end(page, pos, last)
            block = tag in BLOCK
            if block:
                flush()
            if m[1]:
                if opened[tag]:
                    flush() if block else None
                    # an element's end closes those left open in it
                    while stack[-1].tag != tag:
                        pop()
                    pop()
                continue
            given = page[start : pos - 1]
            # a button within a paragraph is part of its sentence, elsewhere a control
            if tag in RAW and not (tag == "button" and around().tag == "p"):
                if not (tag in FOREIGN and given.endswith("/")):
                    if tag not in closes:
                        closes[tag] = [m.span() for m in CLOSES[tag].finditer(page)]
                    at = bisect_left(closes[tag], (pos, 0))
                    pos = closes[tag][at][1] if at < len(closes[tag]) else n if tag in ("script", "style") else pos
                continue
            if tag in VOID:
                if tag == "br" and not mute:
                    buf.append(" ")
                continue
            attrs = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTR.findall(given)} if given else {}
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in SPACES.sub("", attrs.get("style", ""))
            if given.endswith("/"):
                continue
            if not block:
                # inline elements are no nodes; hidden ones are followed to their end
                if hidden:
                    stack.append(Element(tag, 0, OFF, 0, False))
                    opened[tag] += 1
                    mute += 1
                continue
            if opened["p"]:
                # a block ends an open paragraph
                k = len(stack) - 1
                while k and not stack[k].block:
                    k -= 1
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1].tag == tag:
                pop()
            up = around()
            if tag == "hr":
                continue
            classes = sorted(attrs.get("class", "").split())
            role = attrs.get("role", "")
            name = ".".join([tag, *classes, role])
            kind, form = up.kind, up.form
            if form and tag in ("article", "main", "h1", "h2"):
                forms[form] = True
            if tag == "form" and not form:
                form = len(forms)
                forms.append(False)
            if tag not in FRAME:
                if tag in DECLARED or role in ROLES or hidden or not APART.isdisjoint(classes):
                    kind = OFF
                elif (tag in WEAK_TAGS and not (tag == "header" and (opened["article"] or opened["main"]))) or not WEAK.isdisjoint(classes):
                    kind = max(kind, HINTED)
            elif hidden:
                kind = OFF
            if not up.children or up.children[-1] != name:
                up.children.append(name)  # a run of equal elements counts as one
            stack.append(Element(tag, xxhash.xxh64_intdigest(name, up.key) >> 1, kind, form, True))
            opened[tag] += 1
        flush()
        while len(stack) > 1:
            pop()
        for b in self.blocks:
            if b[2] == HINTED and forms[b[4]]:
                b[2] = KEEP

    def text(self, flips: frozenset[int] = frozenset()) -> str:
        """The main text; flips: nodes that are judged other than by themselves."""
        stays = [b for b in self.blocks if b[2] != OFF]
        main = [b for b in stays if (b[2] == KEEP) != (b[0] in flips)]
        return "\n\n".join(b[3] for b in main or stays)


def extract(page: str | None, flips: frozenset[int] = frozenset()) -> str:
    return Page(page or "").text(flips)


def items(page: str | None) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(hash of the page's text, [(0, node, 0, kind, presentation) or (1, node, node around, kind, hash of a block)])."""
    p = Page(page or "")
    seen = xxhash.xxh64()
    found: dict[tuple, None] = {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    used = set()
    for node, up, kind, text, _ in p.blocks:
        if kind != OFF:
            raw = text.encode("utf-8", "surrogatepass")
            seen.update(raw + b"\n")
            found[1, node, up, kind, signed(xxhash.xxh64_intdigest(raw))] = None
            used.update((node, up))
    for node in used:
        style = xxhash.xxh64_intdigest(np.array(sorted(p.styles.get(node, ())), dtype=np.uint64).tobytes())
        found[0, node, 0, KEEP, signed(style)] = None
    return signed(seen.intdigest()), list(found)


def importance(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, node, hinted, pages, content, presentation, importance): text nodes of every host, and (host null) of all merged.

    A page is first met with its copies, by the hash of its text; then only counts travel, added up on
    the map side, so a hot host costs no more than its distinct contents.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [("kind", pa.int32()), ("node", pa.int64()), ("up", pa.int64()), ("hint", pa.int32()), ("value", pa.int64())]
        for batch in batches:
            hashes, flat, ends = [], [], [0]
            for h in batch.column(1):
                page, found = items(h.as_py())
                hashes.append(page)
                flat += found
                ends.append(len(flat))
            fields = [pa.array([x[k] for x in flat], t) for k, (_, t) in enumerate(kinds)]
            struct = pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds])
            yield pa.record_batch([batch.column(0), pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=["host", "page", "items"])

    with small_batches(pages.sparkSession, 500):
        read = pages.select(col(host), col(html)).mapInArrow(run, "host string, page long, items array<struct<kind:int,node:long,up:long,hint:int,value:long>>")
        own = materialize(read.groupBy("host", "page").agg(F.first("items").alias("items")), "trees")
    every = own.groupBy("page").agg(F.first("items").alias("items")).select(F.lit(None).cast("string").alias("host"), "items")
    rows = own.select("host", "items").unionByName(every).select("host", F.explode("items").alias("i")).select("host", "i.*")
    counted = rows.groupBy("host", "kind", "node", "up", "hint", "value").agg(F.count("*").alias("c"))
    sums = materialize(counted.groupBy("host", "kind", "node", "up", "hint").agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.ln("c")).alias("ln"), F.sum(F.col("c") * F.ln("c")).alias("cln")), "sums")
    release(own)
    ratio = lambda a, b: F.when(b > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / b))).otherwise(F.lit(1.0))
    looks = sums.where("kind = 0").select("host", "node", F.col("m").alias("pages"), F.col("l").alias("looks"), ratio(F.ln("m") - F.col("cln") / F.col("m"), F.ln("m")).alias("presentation"))
    texts = sums.where("kind = 1").groupBy("host", "node", "up").agg(F.min("hint").alias("hinted"), F.sum("l").alias("n"), F.sum("ln").alias("ln"))
    own_pages = looks.select(F.col("host").alias("h"), F.col("node").alias("n1"), "pages")
    up = looks.select(F.col("host").alias("h2"), F.col("node").alias("n2"), "looks", "presentation")
    met = texts.join(own_pages, F.expr("host <=> h and node = n1")).join(up, F.expr("host <=> h2 and up = n2"), "left")
    content = 1 - ratio(F.col("ln") / F.col("n"), F.ln("pages"))
    content = F.when(F.col("pages") > 1, content).otherwise(F.lit(1.0))
    weight = F.pow(F.lit(GAMMA), F.coalesce("looks", F.lit(1)))
    # the tree's root has no element around it
    return met.select("host", "node", "hinted", "pages", content.alias("content"), F.coalesce("presentation", F.lit(1.0)).alias("presentation"), ((1 - weight) * F.coalesce("presentation", content) + weight * content).alias("importance"))


def flips_of(weights: DataFrame, least: float = LEAST, prior: int = PRIOR) -> DataFrame:
    """(host, nodes): the nodes of a host that the trees judge other than their own hints."""
    shrunk = lambda i, n, to: (to * prior + i * (n - 1)) / (prior + n - 1)
    every = weights.where("host is null").select("node", F.col("importance").alias("i"), F.col("pages").alias("n"))
    met = weights.where("host is not null").join(every, "node", "left")
    hinted = (F.col("hinted") > 0).cast("double")
    whole = shrunk(F.coalesce("i", F.lit(1.0)), F.coalesce("n", F.lit(1)), 1 - hinted)
    final = shrunk(F.col("importance"), F.col("pages"), whole)
    return met.where((final < least) != (F.col("hinted") > 0)).groupBy("host").agg(F.collect_set("node").alias("nodes"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, trees: bool = True) -> DataFrame:
    """pages with text, its main text, instead of html; trees=False: by each page's own elements alone."""
    pages = renamed(pages, "text") if html.lower() != "text" else pages
    host, nodes, salt, out = fresh(pages, "host", "nodes", "salt", "text_out")
    hosted = pages.withColumn(host, host_of(col(url)))
    if trees:
        weights = materialize(importance(hosted, host, html), "weights")
        flips = materialize(flips_of(weights, least).select(F.col("host").alias(host), F.col("nodes").alias(nodes)), "flips")
        release(weights)
        n = flips.agg(F.sum(F.size(nodes)), F.count("*")).first()
        if (n[0] or 0) + n[1] <= BROADCAST_NODES:
            met = hosted.join(F.broadcast(flips), host, "left")
        else:
            salted = flips.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = hosted.withColumn(salt, F.pmod(F.xxhash64(col(url), col(html)), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left").drop(salt)
    else:
        met = hosted.withColumn(nodes, F.lit(None).cast("array<long>"))

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, flipped in parts:
            yield pd.Series([extract(x, frozenset(f) if f is not None else frozenset()) for x, f in zip(h, flipped)], dtype=object)

    # the host comes first in a joined frame: the user's order of columns is restored
    return met.withColumn(out, text(col(html), col(nodes))).select(*(col(c) for c in pages.columns if c != html), col(out).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
