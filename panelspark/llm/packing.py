"""Best-fit packing by length-histogram planning.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths, at
most ``capacity`` numbers, reaches the driver. Best fit decreasing runs over these counts: runs of
equal lengths go to runs of equal bins, so the plan grows with ``capacity`` and not with documents.
Pieces then take the planned slots by their rank within their length. Ranks are made of counts per
(slice, length) and a running number inside each slice and length, so a length that holds most
pieces is spread over the slices.

Nulls are empty texts (one piece with the end id alone); equal rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import slices, typed
from panelspark.storage import cut_lineage

CAPACITY, END_ID = 2048, 0
CACHE = 300_000
BATCH = 1 << 19  # bytes of text a worker holds as Python strings
#: Fixed value: the split of a word into pre-tokens, as the tokenizer file states it.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of a text for a BPE file with word ends, word by word.

    The tokenizer drops white space and never looks across it, so the ids of a text are those of
    its words. Each new word's pre-tokens go through the file's merges; words are remembered up to
    a bound. Words outside plain Latin script, with a special token, or texts with the control
    characters that count as white space only in Python take the ``tokenizers`` library as it is.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        names = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        end = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:  # the word end becomes the byte 255, which no UTF-8 text has
            body, last = (token[: -len(end)], b"\xff") if token.endswith(end) else (token, b"")
            return bytes(names[c] for c in body) + last

        ranks, spare = {raw(token): number for token, number in model["vocab"].items()}, len(model["vocab"])
        for b in range(256):  # the word end by itself and bytes without a token are never left over
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = spare
                spare += 1
        self.bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PRETOKENS)
        self.plain = regex.compile(r"[!-~À-ɏ]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.words: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if "<|" in word or not self.plain.fullmatch(word):
            return self.slow(word)
        low = "".join(map(str.lower, unicodedata.normalize("NFC", word))) if not word.isascii() else word.lower()
        ids = []
        for piece in self.split.findall(low):
            ids += self.bpe._encode_single_piece(piece.encode() + b"\xff")
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self.slow(text)
        words, known = text.split(), self.words
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    def cut(batches):
        words = tokenizer(path)
        for batch in slices(batches, "text", BATCH):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.ids(text) + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                for n, a in enumerate(range(0, total, capacity)):
                    b = min(total, a + capacity)
                    out.append((doc, n, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = zip(*out, strict=True) if out else ([] for _ in range(5))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return typed(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts.

    Rows ``(length, first rank, count, first bin, per bin, offset)``: ranks from ``first rank`` on go
    to bins from ``first bin`` on, ``per bin`` neighbours to each, the first at ``offset``.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first bin, how many)
    rooms: list[int] = []
    slots, bins = [], 0

    def put(room, first, many):
        if room and many:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, first = capacity, bins
                many = -(-left // (capacity // length))
                bins += many
            # the fullest bin that fits takes items until none fits any more, then the next bin
            per = room // length
            full = min(many, left // per)
            offset = capacity - room
            if full:
                slots.append((length, rank, full * per, first, per, offset))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < many:
                some = min(left, per - 1) if left < per else 0
                if some:
                    slots.append((length, rank, some, first + full, some, offset))
                    put(room - some * length, first + full, 1)
                    rank, left = rank + some, left - some
                rest = first + full + (1 if some else 0)
                put(room, rest, first + many - rest)
    return slots


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and its gapless ``offset`` there."""
    stored = cut_lineage(pieces(docs, path, capacity).withColumn("_slice", F.spark_partition_id()), "pieces")
    counts = cut_lineage(stored.groupBy("length", "_slice").agg(F.count("*").alias("_n")), "lengths")
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = stored.withColumn("_own", F.row_number().over(inside) - 1).join(offsets.hint("merge"), ["length", "_slice"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_own") + F.col("_before")).cast("long").alias("_rank"))
    table = np.array(sorted(slots), np.int64).reshape(-1, 6)

    def take(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(table[:, 0] * (1 << 44) + table[:, 1], length * (1 << 44) + rank, side="right") - 1
            run = table[at]
            nth = rank - run[:, 1]
            where = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            yield pa.RecordBatch.from_arrays(batch.columns[:5] + [pa.array(x, pa.int64()) for x in where],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
