"""Ragged JSONL: parsed as variants, so a field may be a string, an object or a list of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import first_truthy
from millrace.storage import size_checked

#: The accepted names of each field, in order of preference.
QUERY = ["query_views", "queries", "query", "anchor", "q"]
POSITIVE = ["positive_views", "positives", "positive", "pos", "positive_document"]
NEGATIVE = ["negatives", "negative", "negs"]
TEXT = ["text", "content", "caption", "sentence"]
IMAGE = ["image", "images", "img", "image_path", "image_paths"]
RECORD_ID = ["id", "uid", "doc_id"]
INSTRUCTION = ["instruction", "instruct"]
QREL_QUERY = ["query_id", "query-id", "qid", "q_id", "queryid", "question_id", "query", "question"]
QREL_DOC = ["doc_id", "doc-id", "docid", "corpus-id", "corpus_id", "cid", "pid", "passage_id", "document_id", "did", "doc"]
QREL_LIST = ["doc_ids", "docids", "corpus_ids", "positive_ids", "positive_doc_ids", "positives", "relevant_docs", "relevant_doc_ids", "gold_ids", "gt_ids", "answer_doc_ids", "pos_ids"]
QREL_SCORE = ["score", "relevance", "rel", "label", "grade", "gain"]
QREL_MAP = ["docs", "qrels", "relevance", "doc_scores"]
RECORD = "struct<text:string,images:array<string>,instruction:string,uid:string>"


def lines(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """(file, line): non-blank lines of all files; with limit, the first ones in listed order."""
    out = None
    for n, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(n).alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
        out = one if out is None else out.unionByName(one)
    return out if limit is None else head(out.withColumn("at", F.monotonically_increasing_id()), limit, "file", "at").drop("at")


def numbered_lines(spark: SparkSession, *paths: str, blank: bool = False) -> DataFrame:
    """(file, path, number, line): lines with their number in their file, from 1, blank ones counted but left out unless `blank`.

    Files stay split: a split's lines come in order, so the lines of the splits before it, one row
    for each split, give it its first number.
    """
    out = None
    for n, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(n).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    splits = out.groupBy("file", "path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file", "path").orderBy("start")) - F.col("n")
    splits = splits.select("file", "path", "start", (before - F.col("first") + 1).alias("add"))
    met = out.join(size_checked(splits), ["file", "path", "start"]).withColumn("number", F.col("at") + F.col("add"))
    return (met if blank else met.where("trim(line) <> ''")).select("file", "path", "number", "line")


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def parsed(rows: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """rows with v, the line as a variant; strict: a line that is no JSON is an error, else v is null.

    The error names file and line of numbered_lines().
    """
    if strict:
        where = F.concat(F.col("path"), F.lit(":"), F.col("number"), F.lit(": ")) if {"path", "number"} <= set(rows.columns) else F.lit("")
        bad = F.when(F.try_parse_json(F.col(line)).isNull(), F.raise_error(F.concat(F.lit("invalid JSON: "), where, F.substring(F.col(line), 1, 80)))).otherwise(F.col(line))
        return rows.withColumn("v", F.parse_json(bad.cast("string")))
    return rows.withColumn("v", F.try_parse_json(F.col(line)))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def pick(v: Column, names: list[str]) -> Column:
    """The first field that is there and not null."""
    return F.coalesce(*(field(v, n, "variant") for n in names))


def kind(v: Column) -> Column:
    """The kind of a variant: ARRAY, OBJECT, STRING or another; null for null and JSON null."""
    return F.when(~F.is_variant_null(v), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def strings(v: Column) -> Column:
    """A string or a list of strings as an array."""
    listed = F.try_variant_get(v, "$", "array<string>")
    return F.when(kind(v) == "ARRAY", listed).when(kind(v).isNotNull(), F.array(F.try_variant_get(v, "$", "string")))


def _error(what: str, *shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what), *shown))


def record(v: Column, uid: Column | None = None) -> Column:
    """struct(text, images, instruction, uid) of a string, an object or null; anything else is an error.

    uid: the id of a record that has none of its own. The first name with something in it counts.
    """
    is_object = kind(v) == "OBJECT"
    uid = uid if uid is not None else F.lit(None).cast("string")
    get = lambda names: first_truthy(*(field(v, n) for n in names))
    none = F.array().cast("array<string>")
    # an empty list or string is passed over, a list of empty strings is not
    full = lambda x: F.when((F.size(strings(x)) > 0) & ~((kind(x) == "STRING") & (strings(x)[0] == "")), strings(x))
    images = F.filter(F.coalesce(*(full(field(v, n, "variant")) for n in IMAGE), none), lambda x: x.isNotNull() & (x != ""))
    known = kind(v).isNull() | kind(v).isin("OBJECT", "STRING")
    return F.when(
        known,
        F.struct(
            F.when(is_object, get(TEXT)).otherwise(F.try_variant_get(v, "$", "string")).alias("text"),
            F.when(is_object, images).otherwise(none).alias("images"),
            F.when(is_object, get(INSTRUCTION)).alias("instruction"),
            F.coalesce(F.when(is_object, get(RECORD_ID)), uid).alias("uid"),
        ),
    ).otherwise(_error("not a record: ", kind(v)).cast(RECORD))


def records(v: Column, uids: Column | None = None, default: Column | None = None) -> Column:
    """Records of a list or of one of them. uids: ids by position, before the default one."""
    items = F.try_variant_get(v, "$", "array<variant>")
    given = uids if uids is not None else F.array().cast("array<string>")
    default = default if default is not None else F.lit(None).cast("string")
    uid = lambda i: F.coalesce(F.get(given, i), default)
    one = F.array(record(v, uid(F.lit(0))))
    return F.when(kind(v) == "ARRAY", F.transform(items, lambda x, i: record(x, uid(i)))).when(v.isNotNull(), one).otherwise(F.array().cast(f"array<{RECORD}>"))


def _listed(v: Column, many: str, one: str) -> Column:
    """Ids by position: a list that is not empty, else the single id."""
    xs = F.when(kind(field(v, many, "variant")) == "ARRAY", field(v, many, "array<string>"))
    return F.coalesce(F.when(F.size(xs) > 0, xs), F.when(first_truthy(field(v, one)).isNotNull(), F.array(field(v, one))))


def examples(rows: DataFrame) -> DataFrame:
    """(query_views, positive_views, negatives, task, group_id, query_id, positive_ids, example_id, teacher_scores) of parsed lines.

    Views get the ids of query_ids, doc_ids and negative_ids by position where they have none;
    each negative is a list of views; a line without a query or a positive is an error.
    """
    v = F.col("v")
    query, doc = first_truthy(field(v, "query_id")), first_truthy(field(v, "doc_id"))
    given = lambda names, what: F.coalesce(pick(v, names), _error(f"no {what}: ", F.substring(F.to_json(v), 1, 80)).cast("variant"))
    some = lambda xs, what: F.when(F.size(xs) > 0, xs).otherwise(_error(f"no {what} views").cast(f"array<{RECORD}>"))
    raw = pick(v, NEGATIVE)
    each = F.when(kind(raw) == "ARRAY", F.try_variant_get(raw, "$", "array<variant>")).when(kind(raw).isNotNull(), F.array(raw)).otherwise(F.array().cast("array<variant>"))
    ids = field(v, "negative_ids", "array<string>")
    views_of = lambda x, i: F.when(kind(x) == "ARRAY", F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: record(y, F.get(ids, i)))).otherwise(F.array(record(x, F.get(ids, i))))
    declared = lambda name: F.filter(strings(field(v, name, "variant")), lambda x: x.isNotNull() & (x != ""))
    full = lambda xs: F.when(F.size(xs) > 0, xs)
    out = rows.select(
        some(records(given(QUERY, "query"), _listed(v, "query_ids", "query_id"), query), "query").alias("query_views"),
        some(records(given(POSITIVE, "positive"), _listed(v, "doc_ids", "doc_id"), doc), "positive").alias("positive_views"),
        F.transform(each, views_of).alias("negatives"),
        F.coalesce(field(v, "task"), F.lit("default")).alias("task"),
        first_truthy(field(v, "group_id"), field(v, "cluster_id")).alias("group_id"),
        query.alias("query_id"),
        F.coalesce(full(declared("positive_ids")), full(declared("relevant_doc_ids")), F.array().cast("array<string>")).alias("declared"),
        first_truthy(field(v, "example_id")).alias("example_id"),
        field(v, "teacher_scores", "array<double>").alias("teacher_scores"),
    )
    own = F.filter(F.transform("positive_views", lambda r: r["uid"]), lambda x: x.isNotNull() & (x != ""))
    return out.withColumn("positive_ids", F.array_distinct(F.concat("declared", own))).drop("declared")


def qrels(rows: DataFrame, line: str = "line") -> DataFrame:
    """(q, d, rel) of qrels lines: columns, or JSON with one document, a list, maps, all of which count.

    The largest relevance of a pair stands, 0 at least. A line that is neither, an object without a query or
    without any document field, and a score that is no number are errors; blank lines are none.
    """
    text = F.btrim(F.col(line), F.lit(" \t\r\n"))
    full = rows.where(text != "").select(text.alias("line"))
    shown = F.substring("line", 1, 80)
    number = lambda x: F.coalesce(x.try_cast("double"), _error("not a score: ", x).cast("double"))
    cells = F.split("line", r"\s+")
    flat = full.where("not startswith(line, '{')").select(F.when(F.size(cells) >= 2, cells).otherwise(_error("neither columns nor JSON: ", shown).cast("array<string>")).alias("c"))
    flat = flat.select(F.col("c")[0].alias("q"), F.col("c")[1].alias("d"), F.when(F.size("c") >= 3, number(F.get("c", F.lit(2)))).otherwise(F.lit(1.0)).alias("rel"))
    v = F.col("v")
    scored = lambda x: F.coalesce(*(F.when(~kind(field(x, n, "variant")).isin("OBJECT", "ARRAY"), field(x, n)) for n in QREL_SCORE))
    default = F.when(scored(v).isNull(), F.lit(1.0)).otherwise(number(scored(v)))
    entry = "array<struct<d:string,rel:double>>"
    none = F.array().cast(entry)
    single = F.coalesce(*(F.when(~kind(field(v, n, "variant")).isin("OBJECT", "ARRAY"), field(v, n)) for n in QREL_DOC))
    # of the list fields the first that is there counts, if it is a list
    listed = F.coalesce(*(field(v, n, "variant") for n in QREL_LIST))
    is_list = kind(listed) == "ARRAY"
    item = lambda i: F.when(kind(i) == "OBJECT", F.struct(F.coalesce(*(field(i, n) for n in QREL_DOC)).alias("d"), F.when(scored(i).isNull(), F.col("score")).otherwise(number(scored(i))).alias("rel"))).otherwise(F.struct(F.try_variant_get(i, "$", "string").alias("d"), F.col("score").alias("rel")))
    maps = [F.when(kind(field(v, n, "variant")) == "OBJECT", F.transform(F.map_entries(field(v, n, "map<string,string>")), lambda e: F.struct(e["key"].alias("d"), number(e["value"]).alias("rel")))) for n in QREL_MAP]
    handled = single.isNotNull() | F.coalesce(is_list, F.lit(False)) | F.coalesce(*maps).isNotNull()
    j = parsed(full.where("startswith(line, '{')")).select("line", "v", F.coalesce(*(field(v, n) for n in QREL_QUERY)).alias("q"), default.alias("score"))
    j = j.select(F.coalesce("q", _error("no query id: ", shown).cast("string")).alias("q"), "line", "v", "score")
    found = F.concat(*(F.coalesce(m, none) for m in maps), F.coalesce(F.when(is_list, F.transform(F.try_variant_get(listed, "$", "array<variant>"), item)), none), F.when(single.isNotNull(), F.array(F.struct(single.alias("d"), F.col("score").alias("rel")))).otherwise(none))
    many = j.select("q", F.explode(F.when(handled, found).otherwise(_error("no document id: ", shown).cast(entry))).alias("e")).select("q", "e.d", "e.rel")
    both = many.unionByName(flat)
    return both.where("d is not null").groupBy("q", "d").agg(F.greatest(F.lit(0.0), F.max("rel")).alias("rel"))
