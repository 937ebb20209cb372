"""Repeated word windows by recompression.

A round of recompression names runs of equal symbols and then neighbouring pairs: a bit of each
name makes it a left or a right symbol, and every left-right pair becomes one new symbol. Names are
64-bit hashes of what they stand for, so all tasks give the same name to the same run or pair
without a dictionary. Inside equal windows the symbols are equal, but for those at the rim whose run
or pair may reach outside; these are popped round by round. Symbols left after the last round that
leaves any are the consistent interior. The smallest of them is the window's anchor, and windows in
a row that share it form one entry: the words known to surround the anchor (its gram) and all words
that these windows cover (its context). A window without interior is its own anchor.

Spark rounds then tell, over all documents:

1. for every gram and context, the smallest doc_id that has it. A context known to a smaller
   document settles all its windows; a gram that only one context has settles them the other way.
2. for the windows of the other entries, the borders of repeats, the same by the window's 13 words.

A window is removed when its words also start in a document with a smaller doc_id.

Null and empty texts have no words. Rows with equal doc_id do not repeat each other; a null doc_id
counts as larger than any other. Extra columns are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.batches import answered, bucket_count, sent, store, told, unpacked
from panelspark.llm.common import combine, mix, raw_bytes, word_hashes, words_of

WINDOW, ROUNDS = 13, 2
BATCH, BLOCK = 3 << 20, 1 << 23
INDEX = (1 << 24) - 1


class Level:
    """Symbols of one level: names, first word (one more than symbols) and document."""

    def __init__(self, names, first, doc):
        self.names, self.first, self.doc = names, first, doc

    def grouped(self, joins: np.ndarray, name) -> tuple[Level, np.ndarray]:
        """Next level, where symbols with ``joins`` are one with the symbol before; and each symbol's place there."""
        starts = np.flatnonzero(~joins)
        sizes = np.diff(np.append(starts, len(joins)))
        return Level(name(starts, sizes), np.append(self.first[:-1][starts], self.first[-1]), self.doc[starts]), np.cumsum(~joins) - 1

    def runs(self):
        same = np.zeros(len(self.names), bool)
        same[1:] = (self.names[1:] == self.names[:-1]) & (self.doc[1:] == self.doc[:-1])
        return self.grouped(same, lambda at, size: combine(self.names[at], size.astype(np.uint64)))

    def pairs(self):
        left = (self.names & np.uint64(1)).astype(bool)
        second = np.zeros(len(self.names), bool)
        second[1:] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])

        def name(at, size):
            out = self.names[at].copy()
            two = size == 2
            out[two] = combine(out[two], self.names[at[two] + 1])
            return mix(out + np.uint64(1))
        return (*self.grouped(second, name), left)


def window_hashes(words: np.ndarray) -> np.ndarray:
    two = combine(words[:-1], words[1:])
    four = combine(two[:-2], two[2:])
    eight = combine(four[:-4], four[4:])
    return combine(combine(eight[:-5], four[8:-1]), words[12:])


def entries(words: np.ndarray, doc: np.ndarray):
    """Per entry: first and last window, gram, context; and the hash of every window (by its first word)."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    p = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    hashes = window_hashes(words)
    if not len(p):
        return p, p, hashes[:0], hashes[:0], hashes
    at, length, level_of = p.copy(), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    level = Level(words, np.arange(len(words) + 1), doc)
    low, high = p.copy(), p + WINDOW  # interior, as symbols of the level
    for depth in range(1, ROUNDS + 1):
        live = np.flatnonzero(high > low)
        run, place = level.runs()
        a, b = place[low[live]] + 1, place[high[live] - 1]  # the runs at both rims go
        level, place, left = run.pairs()
        left = np.append(left, [False, False])
        ok = b > a
        a = a + (ok & ~left[a])  # a right symbol may be one with what is popped before it
        ok = b > a
        b = b - (ok & left[b - 1])  # a left symbol with what is popped after it
        ok = b > a
        place = np.append(place, [len(level.names)] * 2)
        low, high = np.zeros_like(low), np.zeros_like(high)
        low[live[ok]], high[live[ok]] = place[a[ok]], place[b[ok]]
        live = np.flatnonzero(high > low)
        order = (mix(level.names) & ~np.uint64(INDEX)) | np.arange(len(level.names), dtype=np.uint64)
        size = high[live] - low[live]
        best, least, span = np.empty(len(live), np.uint64), order, 1
        while span < WINDOW:
            here = np.flatnonzero((size >= span) & (size < 2 * span))
            best[here] = np.minimum(least[low[live[here]]], least[high[live[here]] - span])
            least = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0]
            span *= 2
        chosen = (best & np.uint64(INDEX)).astype(np.int64)
        at[live] = level.first[chosen]
        length[live], level_of[live] = level.first[chosen + 1] - level.first[chosen], depth
    start = np.ones(len(p), bool)
    start[1:] = (at[1:] != at[:-1]) | (level_of[1:] != level_of[:-1]) | (p[1:] != p[:-1] + 1) | (level_of[1:] == 0)
    i = np.flatnonzero(start)
    first, last = p[i], p[np.append(i[1:], len(p)) - 1]
    level_of, at, length = level_of[i], at[i], length[i]
    alone = level_of == 0
    begin, end = np.where(alone, first, at - level_of), np.where(alone, first + WINDOW, at + length + level_of)
    gram = mix(((end - begin) * 8 + level_of).astype(np.uint64))
    todo, k = np.arange(len(gram)), 0
    while len(todo):
        gram[todo] = combine(gram[todo], words[begin[todo] + k])
        k += 1
        todo = todo[begin[todo] + k < end[todo]]
    context = combine(combine(hashes[first], hashes[last]), ((last - first) * 32 + at - first).astype(np.uint64))
    return first, last, gram, context, hashes


class Parsed:
    """One batch: its rows, words, entries, and the combined keys to look up.

    Of equal (gram, context) the entry of the smallest document speaks for all.
    """

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        data, starts = raw_bytes(rows.column("_text"))
        begin, end, self.doc = words_of(data, starts)
        self.words = word_hashes(data, begin, end)
        ids = rows.column("_order").to_numpy(zero_copy_only=False)
        made = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3]
        for a in range(0, max(1, len(self.words) - WINDOW + 1), BLOCK):  # blocks only in very long texts
            part = slice(a, a + BLOCK + WINDOW - 1)
            first, last, gram, context, hashes = entries(self.words[part], self.doc[part])
            made.append([first + a, last + a, gram, context, hashes[: BLOCK]])
        self.first, self.last, self.gram, self.context, self.hashes = (np.concatenate(x) for x in zip(*made, strict=True))
        self.owner = ids[self.doc[self.first]] if len(self.first) else np.zeros(0, np.int64)
        self.keys, self.speaker = combined([self.gram, self.context], self.owner)

    def open_windows(self, states: np.ndarray):
        """Settled entries, and windows of open ones: position, combined keys, index among them."""
        state = states[self.speaker] if len(self.speaker) else np.zeros(0, np.uint8)
        settled = (state == 2) | (self.owner > self.keys[-1][self.speaker].view(np.int64))
        i = np.flatnonzero((state == 1) & ~settled)
        size = self.last[i] - self.first[i] + 1
        where = np.repeat(self.first[i] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        owner = np.repeat(self.owner[i], size)
        keys, speaker = combined([self.hashes[where]], owner)
        return settled, where, owner, keys, speaker


def combined(columns: list[np.ndarray], owner: np.ndarray):
    """Unique sorted keys with their smallest owner as the last column, and each entry's index there."""
    if not len(owner):
        return [np.zeros(0, np.uint64)] * (len(columns) + 1), np.zeros(0, np.int64)
    order = np.lexsort([owner, *columns[::-1]])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    kept = order[new]
    return [*(c[kept] for c in columns), owner[kept].view(np.uint64)], index


def entry_states(gram: np.ndarray, context: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """2: the context is in a smaller document; 1: its gram has several contexts and documents; else 0."""
    owner = owner.view(np.int64)
    order = np.lexsort([owner, context, gram])
    g, c, o = gram[order], context[order], owner[order]
    new_g = np.append(True, g[1:] != g[:-1])
    new_c = new_g | np.append(True, c[1:] != c[:-1])
    at_c, at_g = np.flatnonzero(new_c), np.flatnonzero(new_g)
    in_c, in_g = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
    contexts = np.bincount(in_g[at_c])
    several = (contexts > 1) & (np.minimum.reduceat(o, at_g) < np.maximum.reduceat(o, at_g))
    state = np.where(o > o[at_c][in_c], 2, several[in_g].astype(np.int64))
    out = np.empty(len(order), np.uint8)
    out[order] = state
    return out


def window_states(window: np.ndarray, owner: np.ndarray) -> np.ndarray:
    owner = owner.view(np.int64)
    order = np.lexsort([owner, window])
    new = np.append(True, window[order][1:] != window[order][:-1])
    out = np.empty(len(order), np.uint8)
    out[order] = owner[order] > owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but ``text``, and ``_words``, ``_removed`` and ``_kept`` (kept words joined by a space).

    Input columns with one of these names are left out.
    """
    rest = [c for c in docs.columns if c not in (text, "_words", "_removed", "_kept")]
    rows = docs.select(F.struct(*rest).alias("_rest"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("_order"),
                       F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_rest"].dataType.simpleString()
    buckets = bucket_count(docs)
    stored = store(rows, "_text", BATCH)

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield row, Parsed(unpacked(row["payload"]))

    def first_keys(batches):
        for row, parsed in each(batches):
            yield sent(row["batch"], parsed.keys, buckets)

    def window_keys(batches):
        for row, parsed in each(batches):
            yield sent(row["batch"], parsed.open_windows(told(row["answers"]))[3], buckets)

    def finished(batches):
        for row, parsed in each(batches):
            settled, where, owner, keys, speaker = parsed.open_windows(told(row["answers"]))
            state = told(row["answers2"])
            again = where[(state[speaker] == 1) | (owner > keys[-1][speaker].view(np.int64))] if len(where) else where
            cover = np.zeros(len(parsed.words) + WINDOW + 1, np.int64)
            np.add.at(cover, parsed.first[settled], 1)
            np.add.at(cover, parsed.last[settled] + WINDOW, -1)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            keep = np.cumsum(cover)[: len(parsed.words)] == 0
            n = parsed.rows.num_rows
            edges = np.searchsorted(parsed.doc, np.arange(n + 1))
            texts = []
            for i, x in enumerate(parsed.rows.column("_text").to_pylist()):
                own, words = keep[edges[i] : edges[i + 1]], (x or "").encode().split()
                texts.append(b" ".join(words if own.all() else [words[j] for j in np.flatnonzero(own)]))
            removed = np.bincount(parsed.doc[~keep], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [parsed.rows.column("_rest"), pa.array(np.diff(edges)), pa.array(removed), pa.array(texts, pa.binary())],
                names=["_rest", "_words", "_removed", "_kept"])

    key_rows = "batch long, bucket int, keys binary"
    answers = answered(stored.mapInArrow(first_keys, key_rows), 3, entry_states)
    known = stored.join(answers, "batch", "left")
    answers2 = answered(known.mapInArrow(window_keys, key_rows), 2, window_states).withColumnRenamed("answers", "answers2")
    done = known.join(answers2, "batch", "left").mapInArrow(finished, f"_rest {kind}, _words long, _removed long, _kept binary")
    return done.select(*[F.col("_rest")[c].alias(c) for c in rest], "_words", "_removed", "_kept")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same digests in plain Python, for tests."""
    split = [((1 << 63) - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, words), (shown, _) in zip(split, rows, strict=True):
        gone = set()
        for p in range(len(words) - window + 1):
            if least[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((shown, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
