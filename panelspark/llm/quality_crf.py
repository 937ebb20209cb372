"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score looks at its own features and at those of the
lines before and after it; a transition score ties neighbouring labels together. Forward-backward
gives each line's marginal probability of being good, and a document's quality is their mean,
weighted by line length. A monotone map then puts the cut that divides the training documents best
at ``CUT``.

Training takes at most ``SAMPLE`` labelled documents, the first by a hash of their id, of at most
``LONGEST`` characters each; every line takes its document's label. Scoring takes whole texts, each
in the task that read it; nothing is shuffled.

A null text is empty; an empty text has one empty line; repeated rows are scored alike; without any
labelled document all scores are 0.5. Labels other than 0 and 1, and labels of unknown documents,
are ignored. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import combine, raw_bytes, slices, word_hashes, words_of

SAMPLE, LONGEST, CUT, STEPS = 4000, 200_000, 0.7, 100
BATCH = 1 << 20

LOWER, UPPER, DIGIT, SPACE, STOP, COMMA, BANG, BAR, SYMBOL, QUOTE, FOREIGN = range(11)
CLASSES = np.full(256, SYMBOL, np.uint8)
CLASSES[128:] = FOREIGN
for _code, _chars in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, (9, 10, 11, 12, 13, 32)),
                      (STOP, b".?"), (COMMA, b",;:"), (BANG, b"!"), (BAR, b"|"), (QUOTE, b"'\"-()")):
    CLASSES[list(_chars)] = _code
SHARES = (0.01, 0.05, 0.15, 0.3, 0.5, 0.75, 0.95)
SIZES = (0.5, 1.5, 3.5, 8.5, 20.5, 60.5)
LETTERS = (2.0, 3.5, 4.5, 5.5, 7.0, 9.0, 14.0)


def line_features(data: np.ndarray, starts: np.ndarray):
    """Own features of every line (0/1 columns), its length in bytes and its document."""
    ends = starts[1:]
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([starts[:-1], breaks + 1])
    order = np.argsort(np.concatenate([starts[:-1] * 2, breaks * 2 + 3]), kind="stable")  # an empty text's line comes before the next text's
    begin = begin[order]
    doc = np.concatenate([np.arange(len(ends)), np.searchsorted(starts, breaks, side="right") - 1])[order]
    stop = np.append(begin[1:], len(data))
    stop = np.minimum(np.where(np.append(doc[1:] == doc[:-1], False), stop - 1, ends[doc]), ends[doc])
    size = stop - begin
    lines = len(begin)

    owner = np.repeat(np.arange(lines), np.append(begin[1:], len(data)) - begin)
    chars = np.bincount(owner * 16 + CLASSES[data], minlength=lines * 16).reshape(lines, 16)
    chars = chars.astype(np.float64)
    a, b, _ = words_of(data, starts)
    line = owner[a] if len(a) else np.zeros(0, np.int64)
    words = np.bincount(line, minlength=lines).astype(np.float64)
    names = word_hashes(data, a, b)
    again = np.zeros(len(a), bool)
    again[1:] = (names[1:] == names[:-1]) & (line[1:] == line[:-1])
    pair = np.sort((line.astype(np.uint64) << np.uint64(36)) | (names >> np.uint64(28)))
    first = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    distinct = np.bincount((pair[first] >> np.uint64(36)).astype(np.int64), minlength=lines)
    longest = np.bincount(line, weights=b - a, minlength=lines) / np.maximum(words, 1)
    nth = np.arange(len(a)) - np.searchsorted(line, line)
    running = np.append(np.uint64(0), np.cumsum(combine(names, nth.astype(np.uint64)), dtype=np.uint64))
    at = np.searchsorted(line, np.arange(lines + 1))
    whole = running[at[1:]] - running[at[:-1]]  # a line by its words and their places
    _, inverse, count = np.unique(combine(whole, doc.astype(np.uint64)), return_inverse=True, return_counts=True)

    per_word, letters = 1 / np.maximum(words, 1), np.maximum(chars[:, LOWER] + chars[:, UPPER] + chars[:, FOREIGN], 1)
    shares = [chars[:, UPPER] / letters, chars[:, DIGIT] / np.maximum(size, 1), chars[:, BANG] * per_word, chars[:, BAR] * per_word,
              chars[:, SYMBOL] * per_word, chars[:, QUOTE] * per_word, chars[:, STOP] * per_word, chars[:, COMMA] * per_word,
              np.bincount(line[again], minlength=lines) * per_word, 1 - distinct * per_word * (words > 0)]
    final = data[np.maximum(stop - 1, 0)] if len(data) else np.zeros(lines, np.uint8)
    flags = [CLASSES[final] == STOP, (count[inverse] > 1) & (size > 0), size == 0]
    made = [x > t for x in shares for t in SHARES] + [words > t for t in SIZES] + [longest > t for t in LETTERS] + flags
    return np.stack(made, axis=1).astype(np.float32), size.astype(np.float64), doc


def emissions(own: np.ndarray, doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of the good label per line: a constant, own features, those of the line before and after."""
    inside = doc[1:] == doc[:-1]
    parts = own @ weights[1:].reshape(3, -1).T.astype(np.float32)
    out = weights[0] + parts[:, 0].astype(np.float64)
    out[1:] += parts[:-1, 1] * inside
    out[:-1] += parts[1:, 2] * inside
    return out


def gradient(own: np.ndarray, doc: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Transpose of ``emissions``."""
    inside = doc[1:] == doc[:-1]
    sent = np.zeros((len(own), 3), np.float32)
    sent[:, 0] = residual
    sent[:-1, 1] = residual[1:] * inside
    sent[1:, 2] = residual[:-1] * inside
    return np.append(residual.sum(), (own.T @ sent).T.ravel())


@dataclass
class Chain:
    """Weights of the good label's score, transition scores [from, to], and the final map."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def marginals(score: np.ndarray, doc: np.ndarray, moves: np.ndarray):
    """P(good) per line, and the expected number of each transition, by forward-backward."""
    n_docs = int(doc[-1]) + 1 if len(doc) else 0
    first = np.searchsorted(doc, np.arange(n_docs))
    size = np.append(first[1:], len(doc)) - first
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    step, emit = np.exp(moves), np.stack([np.zeros(len(score)), score], axis=1)
    emit = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    longest = int(size[0]) if n_docs else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # documents with at least t + 1 lines
    for t in range(longest):
        at = first[: live[t]] + t
        x = emit[at] * (ahead[at - 1] @ step) if t else emit[at]
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        at, going = first[: live[t]] + t, live[t + 1] if t + 1 < longest else 0
        back[at[going:]] = 1.0
        if going:
            on = at[:going]
            x = emit[on + 1] * back[on + 1]
            y = x @ step.T
            both = ahead[on][:, :, None] * step[None] * x[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[on] = y / y.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), expected


def document_scores(p: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    weight = size + 1
    return np.bincount(doc, weights=p * weight, minlength=n_docs) / np.maximum(np.bincount(doc, weights=weight, minlength=n_docs), 1e-9)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def training_lines(texts: list[str]):
    """``line_features`` of many texts, about ``BATCH`` bytes at a time to keep the driver small."""
    parts, at = [], 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for piece in slices([batch], "text", BATCH):
        own, size, doc = line_features(*raw_bytes(piece.column("text")))
        parts.append((own, size, doc + at))
        at += piece.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam on full batches; lines carry their document's label."""
    own, size, doc = training_lines(texts)
    y = np.asarray(labels, np.float64)
    line_y = y[doc]
    n_docs = len(texts)
    share = 1 / np.bincount(doc, minlength=n_docs)[doc]  # every document counts once, long or short
    inside = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (inside & (line_y[1:] == label)).sum()
    theta = np.zeros(1 + 3 * own.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        p, expected = marginals(emissions(own, doc, theta[:-4]), doc, theta[-4:].reshape(2, 2))
        grad = np.concatenate([gradient(own, doc, (p - line_y) * share) / n_docs, (expected - seen).ravel() / max(1, inside.sum())]) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    chain = Chain(theta[:-4], theta[-4:].reshape(2, 2))
    z = logit(document_scores(marginals(emissions(own, doc, chain.weights), doc, chain.moves)[0], size, doc, n_docs))
    order = np.argsort(z)
    wrong = np.append(0, np.cumsum(y[order])) + np.append(np.cumsum((1 - y[order])[::-1])[::-1], 0)  # cut before the i-th
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    low, high = z[order][max(i - 1, 0)], z[order][min(i, len(z) - 1)]
    chain.slope = 0.5
    chain.shift = float(np.log(CUT / (1 - CUT)) - chain.slope * (low + high) / 2)
    return chain


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").filter(F.char_length("text") <= LONGEST)
    one = F.min(F.struct(F.xxhash64("text").alias("_hash"), "text"))["text"].alias("text")  # of the rows with one doc_id
    rows = sorted(rows.groupBy("doc_id", "quality").agg(one).collect(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def text_scores(data: np.ndarray, starts: np.ndarray, chain: Chain | None) -> np.ndarray:
    n = len(starts) - 1
    if chain is None:
        return np.full(n, 0.5)
    own, size, doc = line_features(data, starts)
    z = chain.slope * logit(document_scores(marginals(emissions(own, doc, chain.weights), doc, chain.moves)[0], size, doc, n)) + chain.shift
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, chain: Chain | None, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``. Only the text goes to the worker, and only the score comes back."""
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            batch = pa.RecordBatch.from_arrays([array], names=["text"])
            parts = [text_scores(*raw_bytes(piece.column("text")), chain) for piece in slices([batch], "text", BATCH)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    once = F.arrow_udf(scored, "double").asNondeterministic()  # else a filter on the score would make it again
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], once(F.col(text).cast("string")).alias(out))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    chain = train(docs, labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_body"))

    def scored(batches):  # texts do not come back from the worker
        for batch in slices(batches, "_body", BATCH):
            done = text_scores(*raw_bytes(batch.column("_body")), chain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(done)], names=["doc_id", "score"])

    return narrow.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
