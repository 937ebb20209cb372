"""Document fingerprints from improbable features.

Every ``WINDOW`` consecutive bytes of a text are a feature. Its rarity comes from the entropy of its
bytes: the corpus is counted once by entropy class, and the fewer windows a class has, the more
improbable are its features. In each run of ``SPAN`` neighbouring features the most improbable one
(the first of equals) gets a point; features with at least ``POINTS`` are selected. Their hashes go
into Bloom filters of ``BITS`` bits, four bits a feature; a filter that holds ``FILL`` features is
closed and the next one is chained to it, so a fingerprint grows with its text.

Two fingerprints are compared filter by filter: bits in common less those expected by chance, over
the same of the fuller filter; overlaps within three standard deviations of chance count as none.
Each filter of the shorter chain takes its best partner; the mean is weighted by bits.

A text's entropies are computed for all its windows at once: the bytes are sorted by value, which
gives the number of equal bytes within the window before and after every position, and with them
the change of the entropy sum from one window to the next, in integers.

Windows of little entropy (runs, blanks) say nothing and rank last. A text of under ``SHORT`` bytes,
or without a selected feature, has all its windows of ``NARROW`` bytes (itself, if shorter) instead. Null texts are empty; an empty text has
no filter. Equal texts have likeness 1, an empty and another text 0. Documents follow each other by
id, null ids first, rows of equal id by the hashes of their texts. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import M1, M2, mix, raw_bytes, slices, text_key, typed
from panelspark.storage import cut_lineage

WINDOW, SPAN, POINTS = 32, 48, 16
SHORT, NARROW = 128, 6
BITS, FILL, HASHES = 2048, 160, 4
CLASSES, LEAST = 1000, 300
BLOCK, BATCH = 1 << 16, 4 << 20  # a block is a power of two
UNIT = 1 << 20
#: n log2 n in integers, for n bytes of one value in a window
PART = np.array([round(n * math.log2(n) * UNIT) if n else 0 for n in range(WINDOW + 1)], np.int64)
STEP = np.diff(PART)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class 0..CLASSES of the entropy of the ``WINDOW`` bytes from every position."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint16)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW) + order
    low = np.searchsorted(key, key - (WINDOW - 1))  # the first equal byte at most a window back
    place = np.arange(n)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[order] = place - low
    after[order] = np.cumsum(np.bincount(low, minlength=n)) - place - 1
    change = STEP[before[WINDOW:]] - STEP[after[: n - WINDOW]]
    total = np.concatenate([[PART[np.bincount(data[:WINDOW])].sum()], change]).cumsum()
    return ((PART[WINDOW] - total) * CLASSES // PART[WINDOW]).astype(np.uint16)


def all_classes(data: np.ndarray) -> np.ndarray:
    """The same block by block."""
    parts = [entropy_classes(data[a : a + BLOCK + WINDOW - 1]) for a in range(0, max(1, len(data) - WINDOW + 1), BLOCK)]
    return np.concatenate(parts)


def histogram(batches):
    """One row per entropy class met by the task."""
    total = np.zeros(CLASSES + 1, np.int64)
    for batch in slices(batches, "text", BATCH):
        data, starts = raw_bytes(batch.column("text"))
        found = all_classes(data)
        inside = np.ones(len(found), bool)
        for end in starts[1:-1]:
            inside[max(0, end - WINDOW + 1) : end] = False
        total += np.bincount(found[inside], minlength=CLASSES + 1)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["class", "n"])


def precedence(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy class, the most improbable first; counted over all windows of all texts."""
    rows = docs.select("text").mapInArrow(histogram, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in rows:  # at most one row per class
        counts[r["class"]] = r["n"]
    low = np.arange(CLASSES + 1) < LEAST
    rank = np.empty(CLASSES + 1, np.int64)
    rank[np.lexsort([np.arange(CLASSES + 1), counts, low])] = np.arange(CLASSES + 1)
    return rank


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def selected(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the selected features of all texts, ascending."""
    ranked = rank[all_classes(data)]
    n, points = len(ranked), np.zeros(len(ranked), np.uint16)
    last = np.full(n, -1, np.int64)  # the last feature of the text that a feature starts in
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= WINDOW:
            last[a : b - WINDOW + 1] = b - WINDOW
    for a in range(0, n, BLOCK):
        part = ranked[a : a + BLOCK + SPAN - 1]
        if len(part) < SPAN:
            break
        winner = a + (sliding_min(part * (2 * BLOCK) + np.arange(len(part)), SPAN) & (2 * BLOCK - 1))
        first = a + np.arange(len(winner))
        winner = winner[first + SPAN - 1 <= last[first]]
        points[: winner[-1] + 1 if len(winner) else 0] += np.bincount(winner).astype(np.uint16) if len(winner) else 0
    return np.flatnonzero(points >= POINTS)


def window_hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` bytes from the positions ``at``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), np.uint64, buffer=padded.data, strides=(1,))
    h = np.full(len(at), width, np.uint64)
    for k in range(0, width, 8):
        block = view[at + k] & np.uint64((1 << 8 * min(8, width - k)) - 1)
        h = mix(h * np.uint64(M2) + block * np.uint64(M1))
    return h


def chained(hashes: np.ndarray) -> bytes:
    """Bloom filters of the different hashes in the order of their first places."""
    if not len(hashes):
        return b""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    bits = np.zeros((-(-len(hashes) // FILL), BITS), bool)
    for k in range(HASHES):
        bits[np.arange(len(hashes)) // FILL, (hashes >> np.uint64(12 * k)) % np.uint64(BITS)] = True
    return np.packbits(bits).tobytes()


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The filters of every text, end to end."""
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at = selected(data, starts, rank)
    hashes = window_hashes(data, at, WINDOW)
    edges = np.searchsorted(at, starts)
    return [chained(hashes[a:b] if a < b and len(raw) >= SHORT else of_short(raw)) for raw, a, b in zip(texts, edges[:-1], edges[1:], strict=True)]


def of_short(raw: bytes) -> np.ndarray:
    """All narrow windows of a text with few wide ones."""
    width = min(NARROW, len(raw))
    return window_hashes(np.frombuffer(raw, np.uint8), np.arange(len(raw) - width + 1 if raw else 0), width)


def likeness(x: bytes, y: bytes) -> float:
    """0 to 1; the same for either order."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    a, b = sorted((np.unpackbits(np.frombuffer(f, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for f in (x, y)), key=len)
    n, m, common = a.sum(axis=1).astype(float)[:, None], b.sum(axis=1).astype(float)[None, :], (a @ b.T).astype(float)
    chance = n * m / BITS
    noise = 3 * np.sqrt(chance * (1 - n / BITS) * (1 - m / BITS))
    score = np.where(common > chance + noise, (common - chance) / np.maximum(np.maximum(n, m) - chance, 1e-9), 0.0).clip(0, 1)
    best = (score.max(axis=1) * n[:, 0]).sum() / n.sum()
    if len(a) == len(b):
        best = (best + (score.max(axis=0) * m[0]).sum() / m.sum()) / 2
    return float(best)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


DONE, FIRST, LAST = 0, 1, 2
NAMES = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
SCHEMA = ", ".join(f"{n} {t}" for n, t in zip(NAMES, ["int", "int", "long", "long", "string", "binary", "binary", "double", "double", "string"], strict=True))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def pairs(rows: list[tuple], following: list[tuple], part: int, rank: np.ndarray) -> list[tuple]:
    """Result rows of documents (doc_id, text, filters) whose next documents are known."""
    changed = [edited(x[1], y[1]) for x, y in zip(rows, following, strict=True)]
    raws = [t.encode() for t in changed]
    return [(DONE, part, i, len(text), hashlib.sha256(raw).hexdigest(), own, new, likeness(own, new), likeness(own, after[2]), None)
            for (i, text, own), after, raw, new in zip(rows, following, raws, fingerprints(raws, rank), strict=True)]


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt to tasks by ranges of (doc_id, hash), so a document and its next one meet in one
    task; only the last document of a task has to find the first one of the next task that has any.
    """
    rows = typed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rank = precedence(rows)
    key = ["doc_id", "_k1", "_k2", "_spread"]  # the last one parts equal rows, whose order does not matter
    placed = rows.select("*", *text_key(), F.rand(1).alias("_spread")).repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")

    def made(batches):
        part, before = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text", BATCH):
            texts = batch.column("text").to_pylist()
            own = fingerprints([t.encode() for t in texts], rank)
            documents = list(zip(batch.column("doc_id").to_pylist(), texts, own, strict=True))
            if before is None:
                yield batch_of([(FIRST, part, documents[0][0], None, None, own[0], None, None, None, texts[0])])
            else:
                documents.insert(0, before)
            before = documents[-1]
            yield batch_of(pairs(documents[:-1], documents[1:], part, rank))
        if before is not None:
            yield batch_of([(LAST, part, before[0], None, None, before[2], None, None, None, before[1])])

    stored = cut_lineage(placed.mapInArrow(made, SCHEMA), "fingerprints")
    parts = sorted(r["part"] for r in stored.filter(F.col("kind") == FIRST).select("part").collect())  # one number per task
    spark = docs.sparkSession
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = stored.filter(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    first = stored.filter(F.col("kind") == FIRST).select(
        F.col("part").alias("next"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def borders(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row, after = (r["doc_id"], r["text"], r["fingerprint"]), (r["next_id"], r["next_text"], r["next_fingerprint"])
                yield batch_of(pairs([row], [after], r["part"], rank))

    rest = last.join(order, "part").join(first, "next").mapInArrow(borders, SCHEMA)
    done = stored.filter(F.col("kind") == DONE).unionByName(rest)
    shown = [F.translate(F.base64(c), "\r\n", "").alias(c) for c in ("fingerprint", "edited_fingerprint")]  # base64 without line ends
    return done.select("doc_id", "n_chars", "edited_sha256", *shown, "near_edited", "near_next")


def slow_classes(raw: bytes) -> list[int]:
    """Entropy classes window by window, for tests."""
    out = []
    for p in range(len(raw) - WINDOW + 1):
        counts = np.bincount(np.frombuffer(raw[p : p + WINDOW], np.uint8))
        out.append(int((PART[WINDOW] - sum(int(PART[c]) for c in counts)) * CLASSES // PART[WINDOW]))
    return out


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Ids, sizes, hashes and filters one document at a time, for tests; rows in the order of documents."""
    raws = [(t or "").encode() for _, t in rows]
    counts = np.zeros(CLASSES + 1, np.int64)
    for raw in raws:
        for c in slow_classes(raw):
            counts[c] += 1
    rank = sorted(range(CLASSES + 1), key=lambda c: (c < LEAST, counts[c], c))
    rank = {c: i for i, c in enumerate(rank)}

    def filters(raw):
        ranks, points = [rank[c] for c in slow_classes(raw)], {}
        for p in range(len(ranks) - SPAN + 1):
            w = min(range(p, p + SPAN), key=lambda q: (ranks[q], q))
            points[w] = points.get(w, 0) + 1
        at = [p for p in sorted(points) if points[p] >= POINTS]
        if not at or len(raw) < SHORT:
            return chained(of_short(raw))
        return chained(window_hashes(np.frombuffer(raw, np.uint8), np.array(at), WINDOW))

    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        changed = edited(text, after).encode()
        own, new = filters(text.encode()), filters(changed)
        out.append((i, len(text), hashlib.sha256(changed).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(new).decode(),
                    likeness(own, new), likeness(own, filters(after.encode()))))
    return out
