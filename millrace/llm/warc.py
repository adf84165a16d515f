"""WARC archives: one gzip member per record, and a sidecar offset index.

Input archives may be monolithic: one gzip stream over the whole file, which no
reader can enter in the middle. The normaliser inflates such a stream once, in
bounded memory, rewrites every record as a member of its own and writes an index
of offsets beside it. Records whose payload another record of the corpus holds are
rewritten as revisits of that one.

Files go to any store that pyarrow.fs can open by URI, under a temporary name that
is renamed when complete: a task that runs again writes the same bytes.

Defined results: a null or empty html is an empty payload, and takes part in the
comparison like any other; of equal payloads the record of the largest page_id is
the response (nulls last; of repeated ids the first record), the others revisit it;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import delete, materialize, new_path

LEVEL = 4
CHUNK = 1 << 18
CRLF = b"\r\n"


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Members:
    """Writes gzip members with known offsets; mtime 0, so equal records give equal bytes."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def member(self, parts: Iterator[bytes]) -> tuple[int, int]:
        z, start = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), self.at
        for p in parts:
            self._put(z.compress(p))
        self._put(z.flush())
        return start, self.at - start

    def _put(self, b: bytes) -> None:
        if b:
            self.sink.write(b)
            self.at += len(b)


class Whole(Members):
    """One gzip stream over all records."""

    def __init__(self, sink):
        super().__init__(sink)
        self.z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def add(self, parts) -> None:
        for p in parts:
            self._put(self.z.compress(p))

    def close(self) -> None:
        self._put(self.z.flush())


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: dict[str, str]) -> bytes:
    clean = lambda v: " ".join(str(v).split())  # noqa: E731  no line may end early
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in fields.items()) + CRLF


class Reader:
    """Records of an inflated stream, one gzip member or many, in bounded memory."""

    def __init__(self, source):
        self.source, self.z, self.buf, self.raw = source, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw = self.z.unused_data or self.source.read(CHUNK)
                if not self.raw:
                    return False
                self.z = zlib.decompressobj(31)
            else:
                self.raw = self.z.unconsumed_tail or self.source.read(CHUNK)
                if not self.raw:
                    if out := self.z.decompress(b"", CHUNK):
                        self.buf += out
                        return True
                    if not self.z.eof:
                        raise EOFError("the gzip stream is cut off")
                    continue
            out = self.z.decompress(self.raw, CHUNK)
            if out:
                self.buf += out
                return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, Callable[[], Iterator[bytes]]]]:
        """(fields, header bytes, block): block() yields the content; what is left of it is skipped."""
        while True:
            while (end := self.buf.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buf.strip():
                        raise EOFError("a record's header is cut off")
                    return
            head = bytes(self.buf[: end + 4])
            del self.buf[: end + 4]
            fields = fields_of(head)
            left = [int(fields["Content-Length"])]

            def block(left=left) -> Iterator[bytes]:
                while left[0]:
                    if not self.buf and not self._more():
                        raise EOFError("a record's content is cut off")
                    part = bytes(self.buf[: left[0]])
                    del self.buf[: len(part)]
                    left[0] -= len(part)
                    yield part

            yield fields, head, block
            for _ in block():
                pass
            while len(self.buf) < 4:
                if not self._more():
                    break
            del self.buf[:4]


#: Names of the fields that are read here, as they are written; headers may have them in any case.
NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Target-URI", "Content-Length", "Content-Type", "Page-ID", "Payload-Length", "Refers-To-Page-ID")}


def fields_of(head: bytes) -> dict[str, str]:
    """Fields of a record's header: names in any case, with or without space after the colon, values folded over lines."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = NAMES.get(name.strip().lower(), name.strip())
            out[name] = value.strip()
    return out


def is_http(fields: dict[str, str]) -> bool:
    """Does the record hold an HTTP response, whose body is the payload?"""
    return fields.get("Content-Type", "").lower().replace(" ", "").startswith("application/http") and fields["WARC-Type"] == "response"


def scan(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, record, page_id, payload_digest, record_id) of the responses in raw/, whoever wrote them: input of revisits()."""

    def run(batches):
        import pyarrow as pa

        names = ["archive", "record", "page_id", "payload_digest", "record_id"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = store(f"{folder}/raw/{name}")
                rows: list[tuple] = []
                with where.open_input_stream(path, compression=None) as source:
                    for n, (fields, _, block) in enumerate(Reader(source)):
                        if fields["WARC-Type"] != "response":
                            continue
                        sha, held, within = hashlib.sha1(), b"", not is_http(fields)
                        for part in block():
                            if not within:
                                held += part
                                if (end := held.find(CRLF + CRLF)) < 0:
                                    continue
                                part, held, within = held[end + 4 :], b"", True
                            sha.update(part)
                        sha.update(held)
                        page = fields.get("Page-ID", "")
                        rows.append((name, n, int(page) if page.lstrip("-").isdigit() else None, base64.b32encode(sha.digest()).decode(), fields["WARC-Record-ID"]))
                for i in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, "archive string, record long, page_id long, payload_digest string, record_id string")


def _write(path: str, put: Callable) -> None:
    """put(sink) into path: under another name first, so no reader meets half a file."""
    where, name = store(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part, compression=None) as sink:
        put(sink)
    where.move(part, name)


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One monolithic archive for each partition, all records responses.

    Returns (archive, record, page_id, payload_digest): a row for each record written.
    """
    from pyspark import TaskContext

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))

    def run(batches):
        import pyarrow as pa

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        out: list[tuple] = []
        it = iter(batches)
        first = next((b for b in it if b.num_rows), None)
        if first is None:
            return

        def put(sink):
            whole = Whole(sink)
            for batch in _chain(first, it):
                for p, u, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    body = (h.as_py() or "").encode("utf-8", "surrogatepass")
                    dig = digest(body)
                    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:record:{name}:{len(out)}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": u.as_py() or "", "WARC-Payload-Digest": f"sha1:{dig}", "Page-ID": "" if p is None else p, "Payload-Length": len(body), "Content-Length": len(body)}
                    whole.add((header(fields), body, CRLF + CRLF))
                    out.append((len(out), p, dig))
            whole.close()

        _write(f"{folder}/raw/{name}", put)
        for i in range(0, len(out), 20_000):
            part = out[i : i + 20_000]
            yield pa.record_batch([pa.array([name] * len(part)), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part])], names=["archive", "record", "page_id", "payload_digest"])

    return rows.mapInArrow(run, "archive string, record long, page_id long, payload_digest string")


def _chain(first, rest):
    yield first
    yield from rest


def revisits(records: DataFrame) -> DataFrame:
    """(archive, record, refers_to, refers_id) of all records but one response per payload.

    The payload's representative is a min-aggregation with map-side combine; only
    digests that occur more than once are joined, and AQE splits a hot one.
    """
    if "record_id" not in records.columns:
        records = records.withColumn("record_id", F.concat(F.lit("<urn:record:"), "archive", F.lit(":"), "record", F.lit(">")))
    best = records.groupBy("payload_digest").agg(F.min_by(F.struct("archive", "record", "page_id", "record_id"), F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("largest"), "archive", "record")).alias("r"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "r")
    return records.join(best, "payload_digest").where("not (archive = r.archive and record = r.record)").select("archive", "record", F.col("r.page_id").alias("refers_to"), F.col("r.record_id").alias("refers_id"))


def normalise(archives: DataFrame, again: DataFrame, folder: str) -> DataFrame:
    """Rewrite raw/ archives record by record into warc/, with an index in index/; (archive, records, bytes).

    archives: (archive); again: rows of revisits(). The decisions of one archive go to its
    task, so a task holds no more rows than its archive has records.
    """
    both = archives.select("archive", F.lit(-1).cast("long").alias("record"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_id")).unionByName(again)

    def run(table):
        import pyarrow as pa

        name = table.column("archive")[0].as_py()
        refers = {r: (p, i) for r, p, i in zip(*(table.column(c).to_pylist() for c in ("record", "refers_to", "refers_id"))) if r >= 0}
        where, path = store(f"{folder}/raw/{name}")
        index, size = [], [0]

        def put(sink):
            out = Members(sink)
            with where.open_input_stream(path, compression=None) as source:
                for n, (fields, head, block) in enumerate(Reader(source)):
                    if n in refers:
                        page, rid = refers[n]
                        fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": rid, "Refers-To-Page-ID": "" if page is None else page, "Content-Length": "0"}
                        at, length = out.member((header(fields), CRLF + CRLF))
                    else:
                        at, length = out.member(_record(head, block))
                    index.append(json.dumps({"record": n, "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "offset": at, "length": length}))
            size[0] = out.at

        _write(f"{folder}/warc/{name}", put)
        _write(f"{folder}/index/{name}.jsonl", lambda sink: sink.write("".join(f"{x}\n" for x in index).encode()))
        return pa.table({"archive": [name], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([size[0]], pa.int64())})

    # a number of partitions of its own: the rows are few, the archives behind them are not
    n = max(1, archives.count())
    return both.repartition(n, "archive").groupBy("archive").applyInArrow(run, "archive string, records long, bytes long")


def _record(head: bytes, block) -> Iterator[bytes]:
    yield head
    yield from block()
    yield CRLF + CRLF


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives, each entered at its offset and checked against its digest.

    Revisits have no content: their length and digest are those their header gives.
    """

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = store(f"{folder}/warc/{name}")
                with where.open_input_stream(f"{path.rsplit('/warc/', 1)[0]}/index/{name}.jsonl") as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with where.open_input_file(path) as f:
                    rows = []
                    for entry in index:
                        f.seek(entry["offset"])
                        z = zlib.decompressobj(31)
                        member = z.decompress(f.read(entry["length"])) + z.flush()
                        if not z.eof or z.unused_data:
                            raise ValueError(f"{name}: no single member at {entry['offset']}")
                        end = member.index(b"\r\n\r\n") + 4
                        fields = fields_of(member[:end])
                        body = member[end:-4]
                        body = body[body.find(CRLF + CRLF) + 4 :] if is_http(fields) and CRLF + CRLF in body else body
                        number = lambda k, fields=fields: int(v) if (v := fields.get(k, "").strip()) else None
                        given = fields.setdefault("WARC-Payload-Digest", f"sha1:{digest(body)}")
                        if fields["WARC-Type"] == "response" and given.startswith("sha1:") and f"sha1:{digest(body)}" != given:
                            raise ValueError(f"{name}: record {entry['record']} does not match its digest")
                        rows.append((number("Page-ID"), fields.get("WARC-Target-URI"), len(body) if "Payload-Length" not in fields else number("Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("Refers-To-Page-ID")))
                        if len(rows) == 5000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives, normalise them, and read the normalised ones back."""
    records = materialize(write_monolithic(pages, folder), "records")
    again = revisits(records)
    done = materialize(normalise(records.select("archive").distinct(), again, folder), "archives")
    delete(pages.sparkSession, f"{folder}/raw")
    return read(done, folder)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages, new_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
