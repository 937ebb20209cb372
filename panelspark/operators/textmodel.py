"""A trained text classifier: hashed word n-grams and multinomial logistic regression.

Words (runs of letters and digits) and runs of other signs are hashed by Spark, in lower case; each of
them and each pair of neighbours names one of ``DIMENSIONS`` features, which a text has or has not.
Features are kept where their presence goes with the label: counts per (feature, class) are sums of
rows, and the G statistic of their table must exceed ``ASSOCIATION``. A training round sums gradients
over the stored texts: a task returns its sums in ``CHUNK`` wide pieces, pieces are added by place, and
what reaches the driver has the size of the model, whatever the number of texts. The driver takes
limited-memory quasi-Newton steps. Scoring uses the model as a broadcast and needs no shuffle.

Texts are whole. NULL and empty texts have no features and are scored by the bias alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.storage import cut_lineage

DIMENSIONS, CHUNK = 1 << 20, 1 << 12
HELD = 1 << 17  # list values that a worker handles at a time
ASSOCIATION, LEAST_TEXTS = 25.0, 5  # a feature's G statistic, and the texts that must have it
ROUNDS, MEMORY, PENALTY, ENOUGH = 25, 8, 1e-3, 1e-2
ODD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


@dataclass
class TextModel:
    classes: list[str]
    features: np.ndarray  # numbers of the kept features, ascending
    weights: np.ndarray  # [classes, kept features + 1], the last column is the bias
    dimensions: int


def word_hashes(text: str = "text"):
    """Array of 64-bit hashes, one a word or run of signs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s]+)"))
    return F.transform(words, lambda w: F.xxhash64(w))


def rows_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end and each row's start (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


def parts(batches, column: str):
    """Cut Arrow batches into runs of rows with about ``HELD`` values in the list column, one row at least."""
    for batch in batches:
        edges = np.flatnonzero(np.diff(rows_of(batch.column(column))[1][1:] // HELD)) + 1
        cuts = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def ngrams(hashes: np.ndarray, starts: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Different features of each text, and each text's start, for texts given as word hashes."""
    h, n = hashes.view(np.uint64), len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(starts))
    mixed = h[:-1] * ODD ^ (h[1:] >> np.uint64(7))
    pair = (mixed ^ (mixed >> np.uint64(29))) * ODD
    both = text[:-1] == text[1:]
    feature = (np.concatenate([h, pair[both]]) % np.uint64(dimensions)).astype(np.int64)
    cell = np.unique(np.concatenate([text, text[:-1][both]]) * dimensions + feature)
    text, feature = np.divmod(cell, dimensions)
    return feature.astype(np.int32), np.searchsorted(text, np.arange(n + 1))


def kept_only(feature: np.ndarray, edges: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features among ``kept``; the others are left out."""
    place = np.minimum(np.searchsorted(kept, feature), max(0, len(kept) - 1))
    hit = kept[place] == feature if len(kept) else np.zeros(len(feature), bool)
    return place[hit].astype(np.int32), np.append(0, np.cumsum(hit))[edges]


def listed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def with_features(labelled: DataFrame, dimensions: int) -> DataFrame:
    """Rows (y, f): class number and features of each text."""
    def run(batches):
        for batch in parts(batches, "_h"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), listed(*ngrams(*rows_of(batch.column("_h")), dimensions))], names=["y", "f"])

    return labelled.select("y", word_hashes("text").alias("_h")).mapInArrow(run, "y long, f array<int>")


def associated(stored: DataFrame, counts: list[int]) -> np.ndarray:
    """Features whose presence goes with the class; ``counts`` are texts per class."""
    held = stored.select("y", F.explode("f").alias("f")).groupBy("f").agg(
        F.count("*").cast("double").alias("n"), *[F.sum((F.col("y") == k).cast("double")).alias(f"n{k}") for k in range(len(counts))])
    whole, n = float(sum(counts)), F.col("n")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = F.lit(0.0)
    for k, m in enumerate(counts):
        c = F.col(f"n{k}")
        g = g + part(c, n * m / whole) + part(m - c, (whole - n) * m / whole)
    chosen = held.filter((n >= LEAST_TEXTS) & (2 * g > ASSOCIATION)).select("f").collect()  # at most one row per dimension
    return np.sort(np.array([r["f"] for r in chosen], np.int64))


def probabilities(weights: np.ndarray, f: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Class probabilities [texts, classes] for places of features."""
    n = len(edges) - 1
    text = np.repeat(np.arange(n), np.diff(edges))
    score = np.stack([np.bincount(text, w[f], minlength=n) + w[-1] for w in weights], axis=1)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def loss_and_gradient(stored: DataFrame, weights: np.ndarray, count: int) -> tuple[float, np.ndarray]:
    """Mean penalized log loss over the table (class y, places f) and its gradient, summed where the rows are."""
    shape, size = weights.shape, weights.size
    model = stored.sparkSession.sparkContext.broadcast(weights)  # as large as the model

    def partial(batches):
        total, loss = np.zeros(shape), 0.0
        for batch in parts(batches, "f"):
            (f, edges), y = rows_of(batch.column("f")), batch.column("y").to_numpy()
            p = probabilities(model.value, f, edges)
            at = np.arange(len(y))
            loss -= np.log(np.maximum(p[at, y], 1e-300)).sum()
            p[at, y] -= 1
            text = np.repeat(at, np.diff(edges))
            for k in range(shape[0]):
                total[k, :-1] += np.bincount(f, p[text, k], minlength=shape[1] - 1)
                total[k, -1] += p[:, k].sum()
        flat = np.append(total.ravel(), loss)
        edges = np.append(np.arange(0, len(flat), CHUNK), len(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges) - 1, dtype=np.int32)), listed(flat, edges)], names=["place", "s"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(rows_of(group.column("s").slice(i, 1))[0] for i in range(group.num_rows))
        return pa.table({"place": group.column("place").slice(0, 1), "s": listed(total, np.array([0, len(total)]))})

    sums = stored.mapInArrow(partial, "place int, s array<double>").groupBy("place").applyInArrow(added, "place int, s array<double>")
    flat = np.concatenate([np.array(r["s"]) for r in sorted(sums.collect(), key=lambda r: r["place"])])
    model.unpersist()
    return flat[size] / count + PENALTY / 2 * (weights**2).sum(), flat[:size].reshape(shape) / count + PENALTY * weights


def step_from(gradient: np.ndarray, moved: list, changed: list) -> np.ndarray:
    """Limited-memory quasi-Newton direction."""
    q, kept = gradient.copy(), []
    for s, y in zip(reversed(moved), reversed(changed), strict=True):
        a = (s * q).sum() / (s * y).sum()
        q -= a * y
        kept.append(a)
    if moved:
        q *= (moved[-1] * changed[-1]).sum() / (changed[-1] ** 2).sum()
    for s, y, a in zip(moved, changed, reversed(kept), strict=True):
        q += s * (a - (y * q).sum() / (s * y).sum())
    return -q


def train(labelled: DataFrame, label: str, text: str = "text", dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> TextModel | None:
    """Model of ``label`` from whole texts; None without labelled rows."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    shares = rows.groupBy("label").count().orderBy("label").collect()  # one row a class
    if not shares:
        return None
    classes, count = [r["label"] for r in shares], sum(r["count"] for r in shares)
    numbered = rows.withColumn("y", F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("long") - 1)
    raw = cut_lineage(with_features(numbered, dimensions), "text_features")
    kept = associated(raw, [r["count"] for r in shares])

    def narrowed(batches):
        for batch in parts(batches, "f"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), listed(*kept_only(*rows_of(batch.column("f")), kept))], names=["y", "f"])

    stored = cut_lineage(raw.mapInArrow(narrowed, "y long, f array<int>"), "kept_features")
    weights = np.zeros((len(classes), len(kept) + 1))
    weights[:, -1] = np.log([r["count"] / count for r in shares])
    loss, gradient = loss_and_gradient(stored, weights, count)
    moved: list = []
    changed: list = []
    for _ in range(rounds):
        direction = step_from(gradient, moved, changed)
        length = 1.0 if moved else min(1.0, 1 / max(np.abs(gradient).sum(), 1e-12))
        slope = (direction * gradient).sum()
        new = loss_and_gradient(stored, weights + length * direction, count)
        while new[0] > loss + 1e-4 * length * slope and length > 1e-3:
            length /= 4
            new = loss_and_gradient(stored, weights + length * direction, count)
        if new[0] >= loss:
            break
        s, y, before = length * direction, new[1] - gradient, loss
        weights, (loss, gradient) = weights + s, new
        if (s * y).sum() > 1e-12:
            moved, changed = [*moved, s][-MEMORY:], [*changed, y][-MEMORY:]
        if before - loss < ENOUGH * before:
            break
    return TextModel(classes, kept, weights, dimensions)


def classify(texts: DataFrame, model: TextModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``), ``sentiment_label`` and ``confidence_score`` (its probability); ties go to the first class by name.

    The kept columns travel through the workers, so a caller that needs no texts back should leave them out.
    """
    kept = [c for c in (texts.columns if keep is None else keep) if c not in ("sentiment_label", "confidence_score")]
    row = texts.select(F.struct(*kept).alias("_row"), F.col(text).cast("string").alias("_text"))
    kind = row.schema["_row"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(model)  # as large as the model

    def run(batches):
        for batch in parts(batches, "_h"):
            known = shared.value
            p = probabilities(known.weights, *kept_only(*ngrams(*rows_of(batch.column("_h")), known.dimensions), known.features))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([known.classes[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best])],
                                             names=["_row", "label", "p"])

    done = row.select("_row", word_hashes("_text").alias("_h")).mapInArrow(run, f"_row {kind}, label string, p double")
    return done.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("label").alias("sentiment_label"), F.col("p").alias("confidence_score"))
