"""Repeated byte strings by external induced sorting of suffixes.

The task: remove every byte covered by a ``LENGTH``-byte string that also starts anywhere else (``length``
and ``gram`` are parameters).

1. *Anchors.* Each window of ``LENGTH`` bytes names one anchor: the position of the smallest hash
   among the ``GRAM``-byte strings inside it, the last one of equals. Equal windows name their
   anchor at the same distance, so only suffixes with the same string at their anchor need sorting
   together. Neighbouring windows share an anchor: an anchor row stands for a run of windows
   ``p1..p2`` and the bytes they cover, its context.
2. *Counting.* Contexts are counted by hash, with map-side combine. A context seen twice settles
   all its windows; a string with one context alone settles them the other way. What is left are
   the borders of repeats.
3. *Induced sorting.* The open contexts are dealt by anchor string and sorted by the bytes right of
   the anchor: Spark's sorter, which spills sorted runs and merges them through a priority queue,
   is the external queue that a shard far larger than memory needs. From the sorted queue come the
   common prefixes of neighbours. Step d puts the d-th byte left of the anchor in front: a stable
   distribution by that byte induces the order of the longer suffixes from the order of the shorter,
   and the common prefix of two that become neighbours is the smallest one between them. A window
   at distance d repeats when a neighbour shares ``LENGTH - d`` bytes to the right. Suffixes that are
   alone leave the queue.
4. *Recursion.* A string that holds more than ``HOT`` different open contexts does not go to one task:
   its contexts are texts of their own, of at most ``2 LENGTH - GRAM`` bytes, and go through the same
   steps with a longer anchor string, half the way to ``LENGTH``. Sub-contexts inside the shared
   passage are equal and settled by counting; only those across its borders stay open, under many
   different strings. With anchors of ``LENGTH`` bytes every context is its own string, so it ends.

Contexts are compared by two 64-bit hashes together (anchor string and context).

Null texts are empty and lose nothing. Equal rows are documents like others and repeat each other.
Null doc_ids are ids of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import M1, M2, combine, mix, raw_bytes, slices, text_key
from panelspark.storage import cut_lineage, discard

LENGTH, GRAM, HOT = 400, 128, 512
BATCH = BLOCK = 1 << 19  # bytes of text a worker holds as some ten arrays of 64-bit numbers
SHOWN = 1 << 12  # contexts a worker holds as Python objects
LOW = (1 << 24) - 1
KEYS = ["_id", "_k1", "_k2"]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (eight at least) from every position, by doubling from eight bytes."""
    view = np.ndarray((max(0, len(data) - 7),), np.uint64, buffer=np.ascontiguousarray(data).data, strides=(1,))
    h = view * np.uint64(M1)
    h ^= h >> np.uint64(32)
    n = 8
    while n < gram:
        step = min(n, gram - n)  # the last two halves may overlap
        h = h[:-step] * np.uint64(M2) + h[step:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(M1)
        n += step
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def anchor_rows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, p1, p2, anchor (positions in ``data``), hash of the anchor's string and of the context."""
    h = gram_hashes(data, gram)
    at = np.arange(len(h), dtype=np.uint64)
    named = np.uint64(LOW) - (sliding_min((h & ~np.uint64(LOW)) | (np.uint64(LOW) - at), length - gram + 1) & np.uint64(LOW))
    ends = starts[1:]
    whole = ends - starts[:-1] >= length
    cuts = np.concatenate([[0], np.flatnonzero(named[1:] != named[:-1]) + 1, starts[:-1][whole], ends[whole] - length + 1])
    cuts = np.unique(cuts[cuts < len(named)])
    p1, p2 = cuts, np.append(cuts[1:], len(named)) - 1
    row = np.searchsorted(starts, p1, side="right") - 1
    keep = p2 + length <= ends[np.minimum(row, len(ends) - 1)]
    p1, p2, row = p1[keep], p2[keep], row[keep]
    anchor = named[p1].astype(np.int64)
    last = p2 + length - gram
    context = mix((p2 - p1).astype(np.uint64) * np.uint64(M1) + (anchor - p1).astype(np.uint64))
    for k in range(0, 2 * length, gram):
        inside = p1 + k < last
        context[inside] = combine(context[inside], h[p1[inside] + k])
    return row, p1, p2, anchor, h[anchor], combine(context, h[last])


def anchors(batches, length: int = LENGTH, gram: int = GRAM):
    names = [*KEYS, "p1", "p2", "at", "gram", "ctx"]
    for batch in slices(batches, "text", BATCH):
        data, starts = raw_bytes(batch.column("text"))
        for a in range(0, max(1, len(data) - length + 1), BLOCK):  # a long text makes several, and shares them with its neighbours
            part = data[a : a + BLOCK + length - 1]
            if len(part) < length:
                continue
            row, p1, p2, at, string, context = anchor_rows(part, np.clip(starts - a, 0, len(part)), length, gram)
            first = starts[row] - a
            keys = [batch.column(c).take(pa.array(row)) for c in KEYS]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(x - first, pa.int64()) for x in (p1, p2, at)] + [pa.array(x.view(np.int64)) for x in (string, context)],
                names=names)


def contexts(batches, length: int = LENGTH):
    """Bytes left of each anchor (nearest first) and right of it, ``SHOWN`` contexts at a time."""
    for batch in slices(batches, "text", BATCH):
        data, starts = raw_bytes(batch.column("text"))
        raw, found = memoryview(data), batch.column("found")
        edges = found.offsets.to_numpy()
        base, inner = np.repeat(starts[:-1], np.diff(edges)), found.values.slice(edges[0], edges[-1] - edges[0])
        for a in range(0, len(inner), SHOWN):
            some = inner.slice(a, SHOWN)
            p1, at, p2 = ((some.field(c).to_numpy() + base[a : a + SHOWN]).tolist() for c in ("p1", "at", "p2"))
            left = [bytes(raw[p:m])[::-1] for p, m in zip(p1, at, strict=True)]
            right = [bytes(raw[m : q + length]) for m, q in zip(at, p2, strict=True)]
            names = ["gram", "ctx", "n", "n_ctx"]
            yield pa.RecordBatch.from_arrays([*map(some.field, names), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                             names=[*names, "left", "right"])


def between(prefix: np.ndarray, chosen: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Common prefixes of ``chosen`` entries with their new predecessor; 0 where not ``joined``."""
    out = np.zeros(len(chosen), np.int64)
    to = np.flatnonzero(joined)
    if len(to):
        ends = np.stack([chosen[to - 1] + 1, chosen[to] + 1], axis=1).ravel()
        out[to] = np.minimum.reduceat(np.append(prefix, 0), ends)[::2]
    return out


def repeated(gram: np.ndarray, left: list, right: list, length: int = LENGTH, reach: int = LENGTH - GRAM) -> np.ndarray:
    """For contexts in the order of (gram, right): which distances d of an anchor hold a repeated window."""
    n = len(gram)
    flags = np.zeros((n, reach + 1), bool)
    right_size = np.fromiter(map(len, right), np.int64, n)
    far = np.fromiter(map(len, left), np.int64, n)
    matrix = np.array(right, f"S{length}").view(np.uint8).reshape(n, length)
    before = np.array(left, f"S{reach}").view(np.uint8).reshape(n, reach)
    differ = matrix[1:] != matrix[:-1]
    prefix = np.zeros(n, np.int64)
    prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    prefix[1:] = np.minimum(prefix[1:], np.minimum(right_size[1:], right_size[:-1]))
    group = np.cumsum(np.append(0, gram[1:] != gram[:-1]))
    prefix[np.flatnonzero(np.diff(group)) + 1] = 0
    member = np.arange(n)
    for d in range(reach + 1):
        if len(member) < 2:
            break
        hit = np.flatnonzero(prefix >= length - d)
        flags[member[hit], d] = True
        flags[member[hit - 1], d] = True
        if d == reach:
            break
        # a suffix stays in the queue while a longer window of its own can still find a partner
        best = np.maximum(prefix, np.append(prefix[1:], 0))
        chosen = np.flatnonzero((far[member] > d) & (best >= length - far[member]))
        if len(chosen) < 2:
            break
        key = group[chosen] * 256 + before[member[chosen], d]
        order = np.argsort(key, kind="stable")
        chosen, key = chosen[order], key[order]
        same = np.append(False, key[1:] == key[:-1])
        prefix = between(prefix, chosen, same)
        member, group = member[chosen], np.cumsum(~same) - 1
        paired = same | np.append(same[1:], False)
        # dropping suffixes that are alone moves no others apart
        prefix, member, group = prefix[paired], member[paired], group[paired]
    return flags


def induce(batches, length: int = LENGTH, reach: int = LENGTH - GRAM, most: int = 2 * SHOWN):
    """Stream groups off the sorted queue, ``most`` contexts at a time; a group is never cut."""
    def done(table: pa.Table) -> pa.RecordBatch:
        gram, ctx, n = (table.column(c).to_numpy() for c in ("gram", "ctx", "n"))
        flags = repeated(gram, table.column("left").to_pylist(), table.column("right").to_pylist(), length, reach)
        flags[n > 1] = False
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1] - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[row], ctx[row], a.astype(np.int64), b.astype(np.int64))],
                                          names=["gram", "ctx", "d1", "d2"])

    waiting: list = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= most:
            table = pa.Table.from_batches(waiting)
            gram = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram == gram[-1])[0])
            if cut:
                yield done(table.slice(0, cut))
                waiting = table.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield done(pa.Table.from_batches(waiting))


def same_row(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_k1"] == b["_k1"]) & (a["_k2"] == b["_k2"])


def as_texts(batches):
    """Contexts in the order of their bytes; one that occurs more than once makes two texts."""
    for batch in slices(batches, "right", BATCH):
        n = batch.column("n").to_numpy()
        copies = np.repeat(np.arange(len(n)), np.where(n > 1, 2, 1))
        second = np.append(False, copies[1:] == copies[:-1])[: len(copies)]
        texts = [left[::-1] + right for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("gram").take(pa.array(copies)), batch.column("ctx").take(pa.array(copies)),
                                          pa.array(second.astype(np.int64)), pa.array([texts[k] for k in copies], pa.binary())], names=[*KEYS, "text"])


def inner_runs(shown: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """(gram, ctx, d1, d2): distances whose windows repeat, found with longer anchor strings inside the contexts.

    A context that occurs more than once stands for two texts, so its windows count for the others.
    """
    # stored, so that a task has one worker at a time and the texts are made once
    texts = cut_lineage(shown.mapInArrow(as_texts, "_id long, _k1 long, _k2 long, text binary"), "hot_texts")
    spans = repeated_spans(texts, length, gram + (length - gram + 1) // 2, hot)
    discard(texts)
    each = spans.filter("_k2 = 0").select(F.col("_id").alias("gram"), F.col("_k1").alias("ctx"), F.explode("spans").alias("s"))
    far = shown.filter("n = 1").select("gram", "ctx", F.octet_length("left").alias("far"))
    return each.join(far, ["gram", "ctx"]).select(
        "gram", "ctx", (F.col("far") - F.col("s.b") + length).cast("long").alias("d1"), (F.col("far") - F.col("s.a")).cast("long").alias("d2"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``KEYS`` and ``spans`` for rows of ``KEYS`` and ``text`` (binary) that have any.

    Spans are byte ranges (a, b) to remove; all windows of ``length`` bytes from a to b - length repeat.
    """
    found = cut_lineage(rows.mapInArrow(
        lambda batches: anchors(batches, length, gram), "_id long, _k1 long, _k2 long, p1 long, p2 long, at long, gram long, ctx long"), "anchors")
    counts = found.groupBy("gram", "ctx").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "contexts")
    per_gram = counts.groupBy("gram").agg(F.count("*").alias("n_ctx"), F.sum("n").alias("_all")).filter("_all > 1")
    open_ = counts.join(per_gram.drop("_all"), "gram")
    known = cut_lineage(found.join(open_, ["gram", "ctx"]), "repeats")
    discard(found)
    discard(counts)

    several = known.filter("n_ctx > 1")
    one_each = several.filter("n = 1").unionByName(several.filter("n > 1").dropDuplicates(["gram", "ctx"]))
    per_doc = one_each.groupBy(*KEYS).agg(F.collect_list(F.struct("gram", "ctx", "n", "n_ctx", "p1", "p2", "at")).alias("found"))
    needed = rows.join(per_doc, same_row(rows, per_doc)).select("text", "found")
    shown = cut_lineage(needed.mapInArrow(
        lambda batches: contexts(batches, length), "gram long, ctx long, n long, n_ctx long, left binary, right binary"), "queue")

    queue = shown.filter(F.col("n_ctx") <= hot).repartition("gram").sortWithinPartitions("gram", "right")
    runs = queue.mapInArrow(lambda batches: induce(batches, length, length - gram), "gram long, ctx long, d1 long, d2 long")
    many = shown.filter(F.col("n_ctx") > hot)
    if gram < length and not many.isEmpty():
        runs = runs.unionByName(inner_runs(many, length, gram, hot))

    settled = known.filter("n > 1").select(*KEYS, F.col("p1").alias("a"), (F.col("p2") + length).alias("b"))
    induced = known.filter("n = 1 AND n_ctx > 1").join(runs, ["gram", "ctx"]).select(
        *KEYS, (F.col("at") - F.col("d2")).alias("a"), (F.col("at") - F.col("d1") + length).alias("b"))
    return settled.unionByName(induced).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in spans:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return out


def cut_spans(batches):
    for batch in slices(batches, "text", BATCH):
        kept, removed, runs = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, ranges = (text or "").encode(), merged(spans or [])
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(raw)], strict=True)))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(len(ranges))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rest"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            names=["_rest", "_kept", "_removed", "_runs"])


def cut_texts(batches):
    """The same with the kept bytes as text; bytes of characters that a cut has split go too."""
    for batch in cut_spans(batches):
        texts = [x.decode("utf-8", "ignore") for x in batch.column("_kept").to_pylist()]
        yield batch.set_column(1, "_kept", pa.array(texts, pa.string()))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, as_text: bool = False,
                    length: int = LENGTH, gram: int = GRAM, names: tuple[str, str, str] = ("_kept", "_removed", "_runs")) -> DataFrame:
    """All columns but ``text``, and under ``names`` what is left (bytes, or text), the bytes removed and their runs.

    Input columns with one of these names are left out.
    """
    rest = [c for c in docs.columns if c not in (text, *names)]
    base = docs.select(F.struct(*rest).alias("_rest"), F.col(doc_id).cast("long").alias("_id"),
                       F.col(text).cast("string").alias("text"))
    base = base.select("*", *text_key())
    spans = repeated_spans(base.select(*KEYS, F.col("text").cast("binary").alias("text")), length, gram, hot)
    kind = base.schema["_rest"].dataType.simpleString()
    joined = base.join(spans, same_row(base, spans), "left").select("_rest", "text", "spans")
    done = joined.mapInArrow(cut_texts if as_text else cut_spans, f"_rest {kind}, _kept {'string' if as_text else 'binary'}, _removed long, _runs long")
    return done.select(*[F.col("_rest")[c].alias(c) for c in rest], *[F.col(c).alias(n) for c, n in zip(("_kept", "_removed", "_runs"), names, strict=True)])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length("_kept") + F.col("_removed")).cast("long").alias("n_bytes"),
        F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same digests in plain Python, for tests."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for p in range(len(r) - length + 1):
            seen[r[p : p + length]] = seen.get(r[p : p + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p] += 1
                gone[min(p + length, len(r))] -= 1
        mask = np.cumsum(gone)[: len(r)] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~mask])
        runs = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        out.append((len(r), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
