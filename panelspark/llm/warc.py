"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: each page is one record; Spark's text writer ends every record with the two line ends the
format asks for. Of pages with equal payloads the one with the smallest page_id is a response, the
others are revisits without payload.

Reading: an archive is cut at every ``WARC/1.1`` line, in splits, by Spark's text reader with that
line as separator. A task only sees candidates: a payload may hold the line too. It emits each
candidate's place and declared length, so its successor. A record is real when a chain of successors
from the start of the file reaches it. Chains are followed inside a split, which leaves one jump
per candidate to a later split; pointer jumping over these jumps (each round doubles their reach)
marks the true entry of every split. Only candidates on the chain from a true entry are kept. Records
that hold the separator, so that they lie in several pieces, are put together in a second pass over
the splits concerned.

Null html is an empty payload, a null url leaves its field out, a null page_id is written as such and
counts as largest; rows with the smallest page_id of their payload are all responses when repeated.
An empty table makes an empty archive and no records.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.storage import cut_lineage, scratch_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: The digits of base 32 as ``conv`` writes them and as RFC 4648 does.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload digests fall into so many buckets. Pages in buckets without any repeated payload stay where
#: they are; only the others are joined.
BUCKETS = 1 << 20
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of a SHA-1: every five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes and ``first``: the page a revisit refers to, else null."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    firsts = cut_lineage(base.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "firsts")
    bucket = F.pmod(F.xxhash64("payload_digest"), F.lit(BUCKETS)).alias("_bucket")
    held = F.broadcast(firsts.select(bucket).distinct())  # at most BUCKETS numbers
    placed_ = base.select("*", bucket)
    alone = placed_.join(held, "_bucket", "left_anti").withColumn("first", F.lit(None).cast("long"))
    maybe = placed_.join(held, "_bucket", "left_semi").join(firsts, "payload_digest", "left")
    return alone.unionByName(maybe).drop("_bucket").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per page below ``path``."""
    def field(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    rows = with_types(pages, least)
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(again, "").otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC.decode()), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"))), field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", record_id(F.col("first"))))).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit("\r\n"), http, body)
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def parsed(piece: bytes):
    """Declared length of the record that ``piece`` (without the first line) starts, its fields, and where its block starts."""
    head, mark, _ = piece.partition(b"\r\n\r\n")
    fields = dict(line.partition(b":")[::2] for line in head.split(b"\r\n"))
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    length = fields.get(b"content-length", b"")
    if not mark or not length.isdigit():
        return None
    start = len(head) + 4
    return len(MAGIC) + start + int(length) + len(END), fields, start


def described(piece: bytes, fields: dict, start: int, size: int):
    """page_id, payload bytes, digest, type and refers_to of a whole record."""
    def page(key):
        name = fields.get(key, b"").decode("ascii", "replace").removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name.lstrip("-").isdigit() else None

    http, _, payload = piece[start : size - len(MAGIC) - len(END)].partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    if kind == "revisit":
        declared = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        told = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
        return page(b"warc-record-id"), int(declared[0]) if declared else None, told, kind, page(b"warc-refers-to")
    return page(b"warc-record-id"), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, value: what lies between separator lines, in order inside a task."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.col("value").cast("binary").alias("value"))


def placed(batches):
    """(file, split, place in the split, piece, has the separator in front) for rows in reading order."""
    key, at = None, 0
    for batch in batches:
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            opening = (file, split) != key
            if opening:
                key, at = (file, split), 0
            led = not (opening and split == 0)  # only a file's first piece has no separator in front
            yield file, split, at, value, led
            at += len(value) + led * len(MAGIC)


def candidates(batches):
    """Per piece: its place and bytes; where it may start a record, the declared length and, if whole, the record."""
    names = ["file", "split", "at", "bytes", "size", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = []
    for file, split, at, piece, led in placed(batches):
        if not piece and not led:  # nothing before the first record
            continue
        found = parsed(piece) if led else None
        size = found[0] if found else None
        whole = size == len(piece) + len(MAGIC)
        rows.append((file, split, at, len(piece) + led * len(MAGIC), size, *(described(piece, found[1], found[2], size) if whole else (None,) * 5)))
        if len(rows) == 4096:
            yield made(rows)
            rows = []
    if rows:
        yield made(rows)


def jumps(group: pa.Table) -> pa.Table:
    """For every candidate of a split: where the chain that starts there leaves the split (null: nowhere)."""
    group = group.sort_by("at")
    at, size, length = (group.column(c).to_pylist() for c in ("at", "size", "bytes"))
    end, leave = at[-1] + length[-1], {}
    for a, n in zip(reversed(at), reversed(size), strict=True):
        if n is not None:
            leave[a] = a + n if a + n >= end else leave.get(a + n)
    starts = sorted(leave)
    return pa.table({"file": pa.array([group.column("file")[0].as_py()] * len(starts), pa.string()),
                     "at": pa.array(starts, pa.int64()), "to": pa.array([leave[a] for a in starts], pa.int64()),
                     "split": pa.array([group.column("split")[0].as_py()] * len(starts), pa.int64())})


def on_chain(group: pa.Table) -> pa.Table:
    """The candidates of a split on the chain from its true entry."""
    group = group.sort_by("at")
    at, size = (group.column(c).to_pylist() for c in ("at", "size"))
    row, here, keep = {a: i for i, a in enumerate(at)}, group.column("entry")[0].as_py(), []
    while here in row and size[row[here]] is not None:
        keep.append(row[here])
        here += size[row[here]]
    return group.take(pa.array(keep, pa.int64())).drop_columns(["entry"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of all archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = f"file string, split long, at long, bytes long, size long, {RECORD}"
    found = cut_lineage(pieces(spark, path).mapInArrow(candidates, kind), "candidates")
    splits = found.groupBy("file", "split").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = F.sum("bytes").over(Window.partitionBy("file")).alias("total")
    bases = cut_lineage(splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), whole_file), "splits")

    narrow = found.select("file", "split", "at", "bytes", "size")
    local = narrow.groupBy("file", "split").applyInArrow(jumps, "file string, at long, to long, split long")
    local = local.join(bases.drop("total"), ["file", "split"]).select("file", (F.col("base") + F.col("at")).alias("node"), (F.col("base") + F.col("to")).alias("next"))
    first = found.filter("split = 0").groupBy("file").agg(F.min(F.when(F.col("size").isNotNull(), F.col("at"))).alias("node"))
    reached = cut_lineage(first.filter("node IS NOT NULL").select("file", "node"), "reached")
    targets = local.filter("next IS NOT NULL").select("file", F.col("next").alias("node")).union(reached).distinct()
    jump = cut_lineage(local.filter("next IS NOT NULL").join(targets, ["file", "node"]), "jumps")
    most = bases.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(most.bit_length()):
        far = reached.join(jump, ["file", "node"]).select("file", F.col("next").alias("node"))
        reached = cut_lineage(reached.union(far).distinct(), "reached")
        onward = jump.select("file", F.col("node").alias("next"), F.col("next").alias("beyond"))
        jump = cut_lineage(jump.join(onward, ["file", "next"]).select("file", "node", F.col("beyond").alias("next")), "jumps")

    # the entry of a split: the reached place that lies in it
    inside = found.filter("size IS NOT NULL").join(bases.drop("total"), ["file", "split"]).select("file", "split", "at", (F.col("base") + F.col("at")).alias("node"))
    entries = inside.join(reached, ["file", "node"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    real = found.join(entries, ["file", "split"]).groupBy("file", "split").applyInArrow(on_chain, kind)
    real = cut_lineage(real, "records")
    whole = real.filter("record_type IS NOT NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    torn = real.filter("record_type IS NULL").join(bases, ["file", "split"]).select(
        "file", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("at") + F.col("size")).alias("stop"), "total")
    torn = torn.filter("stop <= total").drop("total")  # a record that its file does not finish is none
    return whole if torn.isEmpty() else whole.unionByName(joined(spark, path, bases, torn))


def joined(spark: SparkSession, path: str, bases: DataFrame, torn: DataFrame) -> DataFrame:
    """Records that lie in several pieces, put together from the splits they touch."""
    def raw(batches):
        for file, split, at, piece, led in placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([at]), pa.array([led * MAGIC + piece], pa.binary())],
                                             names=["file", "split", "at", "piece"])

    def build(batches):
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                record = b"".join(p["piece"] for p in parts)[len(MAGIC) :]
                size, fields, start = parsed(record)
                rows.append(described(record, fields, start, size))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ends = bases.drop("total").withColumn("limit", F.lead("base", 1, (1 << 63) - 1).over(Window.partitionBy("file").orderBy("split")))
    touched = torn.join(ends, "file").filter("start < limit AND stop > base").select("file", "split", "base", "start", "stop")
    parts = pieces(spark, path).mapInArrow(raw, "file string, split long, at long, piece binary").join(touched, ["file", "split"])
    parts = parts.withColumn("place", F.col("base") + F.col("at")).filter("place >= start AND place < stop")
    grouped = parts.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    return grouped.mapInArrow(build, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives below the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), '')), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
