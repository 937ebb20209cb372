"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to small leaves. A leaf becomes an element ``(head, ids, tail)``: the
text before its first safe cut, the ids between its first and last safe cut, the text after the
last. A *safe cut* lies between a character that is not white space and one that is. No match of
the split pattern covers such a cut, and what is matched on either side does not depend on the
other side: white space is the only thing the pattern looks ahead for, and the left side ends
without it. So the ids between safe cuts never change again. Joining neighbours encodes the window
``left.tail + right.head``; a leaf without a safe cut is an open window that grows until a
neighbour closes it. The join is associative; the root encodes its own head and tail.

Decoding concatenates token bytes up the same kind of tree.

Texts of more than ``SEGMENT`` characters are cut into rows of their own; the elements of one text
meet again in a group, which holds no more than the text it came from.

Nulls are empty texts; an empty text has no ids; rows that are equal are encoded each; other
columns are kept under their names by ``encode``; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import typed

LEAF, SEGMENT = 1 << 10, 1 << 20
#: Fixed value: what the split pattern's library takes for white space (Python's ``\s`` has four more).
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")


@functools.cache
def codec(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Monoid:
    """Elements ``(head, ids, tail)``; ``ids`` is None while the element has no safe cut (all is head)."""

    def __init__(self, path: str, pattern: str):
        self.codec = codec(path, pattern)

    def ids(self, text: str) -> bytes:
        return np.array(self.codec.encode_ordinary(text), "<u4").tobytes() if text else b""

    def leaf(self, text: str):
        first = SAFE.search(text)
        if first is None:
            return text, None, ""
        a = b = first.start()
        for cut in SAFE.finditer(text, a + 1):
            b = cut.start()
        return text[:a], self.ids(text[a:b]), text[b:]

    def join(self, left, right):
        if left[1] is None and right[1] is None:
            return left[0] + right[0], None, ""
        if left[1] is None:
            return self.close(left[0], right)
        if right[1] is None:
            return left[0], left[1], left[2] + right[0]
        return left[0], left[1] + self.ids(left[2] + right[0]) + right[1], right[2]

    @staticmethod
    def close(open_text, right):
        return open_text + right[0], right[1], right[2]

    def reduce(self, elements: list):
        while len(elements) > 1:
            elements = [self.join(*elements[i : i + 2]) if i + 1 < len(elements) else elements[i]
                        for i in range(0, len(elements), 2)]
        return elements[0]

    def tree(self, text: str):
        # a cut that is safe by itself would hide from both halves, so halves meet inside a window
        if len(text) <= LEAF:
            return self.leaf(text)
        middle = len(text) // 2
        return self.join(self.tree(text[:middle]), self.tree(text[middle:]))

    def root(self, element) -> bytes:
        head, ids, tail = element
        return self.ids(head) if ids is None else self.ids(head) + ids + self.ids(tail)

    def encode(self, text: str | None) -> bytes:
        return self.root(self.tree(text or ""))

    def decode(self, ids: bytes) -> bytes:
        def up(part):
            if len(part) <= LEAF:
                return self.codec.decode_bytes(part.tolist())
            middle = len(part) // 2
            return up(part[:middle]) + up(part[middle:])
        return up(np.frombuffer(ids or b"", "<u4"))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with ``out``: the ids as little-endian unsigned 32-bit integers."""
    rest = [c for c in df.columns if c not in (text, out)]
    rows = df.select(F.col(text).cast("string").alias("_text"), F.struct(*rest).alias("_rest") if rest else F.lit(0).alias("_rest"))
    kind = rows.schema["_rest"].dataType.simpleString()
    size = F.coalesce(F.char_length("_text"), F.lit(0))

    def short(batches):
        monoid = Monoid(path, pattern)
        for batch in batches:
            done = [monoid.encode(x) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(done, pa.binary())], names=["_rest", "ids"])

    def elements(batches):
        monoid = Monoid(path, pattern)
        for batch in batches:
            made = [monoid.tree(x) for x in batch.column("_part").to_pylist()]
            columns = [batch.column(c) for c in ("_row", "_at", "_rest")]
            columns += [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)] \
                if made else [pa.array([], t) for t in (pa.string(), pa.binary(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_at", "_rest", "head", "mid", "tail"])

    def meet(group: pa.Table) -> pa.Table:
        monoid = Monoid(path, pattern)
        group = group.sort_by("_at")
        parts = list(zip(*(group.column(c).to_pylist() for c in ("head", "mid", "tail")), strict=True))
        done = monoid.root(monoid.reduce(parts))
        return pa.table({"_rest": group.column("_rest").slice(0, 1), "ids": pa.array([done], pa.binary())})

    few = rows.filter(size <= SEGMENT).mapInArrow(short, f"_rest {kind}, ids binary")
    starts = F.sequence(F.lit(0), F.floor((size - 1) / SEGMENT).cast("int"))
    numbered = rows.filter(size > SEGMENT).withColumn("_row", F.monotonically_increasing_id())  # before the texts are cut
    long = numbered.select(
        "_row", "_rest",
        F.posexplode(F.transform(starts, lambda i: F.substring(F.col("_text"), i * SEGMENT + 1, F.lit(SEGMENT)))).alias("_at", "_part"))
    many = long.mapInArrow(elements, f"_row long, _at int, _rest {kind}, head string, mid binary, tail string")
    many = many.groupBy("_row").applyInArrow(meet, f"_rest {kind}, ids binary")
    return few.unionByName(many).select(*([F.col("_rest")[c].alias(c) for c in rest]), F.col("ids").alias(out))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and ``out``: the bytes that ``ids`` stand for; null ids are empty."""
    schema = f"_row {df.select(F.struct('*').alias('_row')).schema['_row'].dataType.simpleString()}, _out binary"

    def bytes_of(batches):
        monoid = Monoid(path, pattern)
        for batch in batches:
            row = batch.column("_row")
            done = [monoid.decode(x) for x in row.field(row.type.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(done, pa.binary())], names=["_row", "_out"])

    rows = df.select(F.struct("*").alias("_row")).mapInArrow(bytes_of, schema)
    return rows.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != out], F.col("_out").alias(out))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes."""
    done = decode(encode(typed(docs, "doc_id", "text"), path, pattern), path, pattern)
    return done.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
