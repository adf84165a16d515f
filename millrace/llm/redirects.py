"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge a url by host suffix and path prefix; urls without a rule follow the
group of aliases that redirect and canonical-link edges tie them to.

Precedence: a url's own rule (the longest that fits) decides first, so an explicit
allow is never overridden by an alias. A url without a rule is blocked if any alias
in its component is blocked, else allowed.

Aliases are compared by normalised urls: scheme and host in lower case, without default
port, dot segments and fragment, and with "/" for an empty path. Links in comments are none.

Defined results: a null url, or one without ://, has empty host and path and gets
no rule unless edges tie it; repeated rows are judged alike; equal rules with
opposite actions allow; an empty table gives no rows. A user's columns host, path, rule and verdict
are called <name>_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col, fresh, let, renamed
from millrace.operators.components import connected_components

Rule = tuple[str, str, str]
#: Rules that are tried one by one; longer lists are joined by host.
CASE_RULES = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the registered query: host, path, action.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null, as one CASE over the rules; see ruled() for long lists."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def ruled(urls: DataFrame, rules: list[Rule], host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """urls with rule and verdict, null where none fits.

    A short list is one CASE; of a long one only the rules of a url's own host suffixes are tried: distinct
    (host, path) pairs meet them in a join by host.
    """
    if len(rules) <= CASE_RULES:
        (judged,) = fresh(urls, "judged")
        held = urls.withColumn(judged, rule_of(col(host), col(path), rules))
        return held.select(*(col(c) for c in urls.columns), F.col(judged)["rule"].alias(rule), F.col(judged)["verdict"].alias(verdict))
    table = urls.sparkSession.createDataFrame(sorted(set(rules)), "rh string, rp string, act string")
    keys = urls.select(col(host).alias("h"), col(path).alias("p")).distinct()
    labels = F.split("h", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keys.withColumn("rh", F.explode(suffixes)).join(table, "rh").where(F.expr("startswith(p, rp)"))
    order = F.struct(F.length(F.concat("rh", "rp")), F.col("act") == "allow")
    best = met.groupBy("h", "p").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "act"), order).alias("b"))
    best = best.select(F.col("h").alias("_h"), F.col("p").alias("_p"), F.col("b.rule").alias("_rule"), F.col("b.act").alias("_act"))
    names = fresh(urls, "_h", "_p", "_rule", "_act")
    best = best.toDF(*names)
    out = urls.join(best, (col(host) == col(names[0])) & (col(path) == col(names[1])), "left")
    return out.withColumn(rule, col(names[2])).withColumn(verdict, col(names[3])).drop(*names)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; null if it has none."""
    m = lambda k: F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k)
    return F.nullif(F.concat(m(1), m(2), m(3)), F.lit(""))


def unescaped(text: Column) -> Column:
    """text with character references decoded: numeric ones, and the named ones of signs that urls have."""
    named = {"amp": "&", "AMP": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "equals": "=", "num": "#", "percnt": "%", "plus": "+", "commat": "@", "comma": ",", "semi": ";", "lowbar": "_", "nbsp": "\u00a0"}
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[a-zA-Z]+;|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX](.*);", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+);", 1)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(p.startswith("&#") & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for k, v in named.items():
            out = out.when(p == f"&{k};", F.lit(v))
        return out.otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def normalised(url: Column) -> Column:
    """A url with ://, written as all that name the same page are; any other as it stands."""

    def of(u: Column) -> Column:
        head = F.lower(F.regexp_extract(u, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
        host = F.regexp_replace(F.regexp_replace(host_of(u), r"^[^@]*@", ""), ":$", "")
        tail = F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1)
        start = let(F.concat(head, F.lit("://"), host), lambda x: F.regexp_replace(F.regexp_replace(x, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1"))
        path = let(path_of(u), lambda p: undotted(F.when(p == "", "/").otherwise(p)))
        return F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.concat(start, path, tail)).otherwise(u)

    return let(url, of)


def undotted(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    none = F.array().cast("array<string>")

    def of(p: Column) -> Column:
        # the empty piece before the first slash stays; dots at the end leave a slash
        pieces = F.split(F.regexp_replace(p, r"/(\.\.?)$", "/$1/"), "/")
        kept = let(pieces, lambda xs: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), none, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))))
        return F.when(p.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)

    return let(path, of)


def resolved(target: Column, base: Column) -> Column:
    """target as an absolute url, relative to base by RFC 3986; null if it names no other page.

    That is: nothing but a fragment, a scheme without ://, or relative to a base that has no host.
    """

    def of(t: Column, base: Column) -> Column:
        scheme = F.regexp_extract(base, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
        origin = F.regexp_extract(base, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
        path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
        own = F.regexp_extract(t, r"(?s)^([^?#]*)", 1)
        tail = F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
        whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), own))
        return (
            F.when(t.contains("://") & t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), t)
            .when((t == "") | t.startswith("#") | t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (origin == ""), F.lit(None))
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("?"), F.concat(origin, path, t))
            .otherwise(F.concat(origin, undotted(whole), tail))
        )

    return let(target, lambda t: let(base, lambda b: of(t, b)))


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges (src, dst) that pages state: canonical links and meta refreshes, relative ones resolved by url and <base>."""
    has = col(html).rlike(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)")
    bare = F.regexp_replace(col(html), r"(?s)<!--.*?(?:-->|\z)", "")
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    given = F.trim(unescaped(attribute(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href")))
    found = pages.where(has).select(col(url).alias("src"), bare.alias("html")).select("src", F.coalesce(resolved(given, F.col("src")), F.col("src")).alias("base"), tag.alias("t"))
    canonical = F.when(F.col("t").rlike(r"(?i)^<link") & F.array_contains(F.split(F.lower(attribute(F.col("t"), "rel")), r"\s+"), "canonical"), unescaped(attribute(F.col("t"), "href")))
    refresh = F.when(F.col("t").rlike(r"(?i)^<meta") & (F.lower(F.trim(attribute(F.col("t"), "http-equiv"))) == "refresh"), F.regexp_extract(unescaped(attribute(F.col("t"), "content")), r"""(?is)url\s*=\s*["']?([^"'\s>]+)""", 1))
    stated = found.select("src", "base", F.trim(F.coalesce(canonical, refresh)).alias("to")).where("src is not null and to is not null")
    return stated.select("src", resolved(F.col("to"), F.col("base")).alias("dst")).where("dst is not null and src <> dst")


def judge(pages: DataFrame, edges: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. edges: (src, dst) urls that are aliases of each other.

    Only urls with an edge enter the component search; it runs on the urls themselves,
    and members without a page of their own pass their rule's verdict on as well.
    """
    both = edges.where("src is not null and dst is not null").select(normalised(F.col("src")).alias("src"), normalised(F.col("dst")).alias("dst")).where("src <> dst")
    pages = renamed(pages, "host", "path", "rule", "verdict")
    base = pages.withColumn("host", host_of(col(url))).withColumn("path", path_of(col(url)))
    base = ruled(base, rules, "host", "path", "rule", "verdict")
    if both.isEmpty():
        return base.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    comp = connected_components(both)
    judged = ruled(comp.withColumn("h", host_of(F.col("node"))).withColumn("p", path_of(F.col("node"))), rules, "h", "p", "r", "v")
    bad = judged.groupBy("component").agg(F.max((F.coalesce("v", F.lit("")) == "block").cast("int")).alias("blocked")).where("blocked = 1").select("component")
    node, alias = fresh(base, "node", "alias")
    aliases = judged.join(bad, "component").select(F.col("node").alias(node), F.lit("block").alias(alias))
    out = base.join(aliases, normalised(col(url)) == F.col(node), "left")
    return out.withColumn("verdict", F.coalesce(F.col("verdict"), F.col(alias), F.lit("allow"))).drop(node, alias)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), edges_of(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with u as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') as h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages
), v as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
rules(rh, rp, act) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit as (
  select page_id, host, path, rh || rp as rule, act, row_number() over (partition by page_id order by length(rh || rp) desc) as k
  from v join rules on (host = rh or host like '%.' || rh) and starts_with(path, rp)
)
select v.page_id, v.host, v.path, hit.rule, coalesce(hit.act, 'allow') as verdict
from v left join hit on hit.page_id = v.page_id and k = 1
"""
