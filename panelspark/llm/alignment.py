"""Alignment of two tokenizers by hash sets of cumulative ends.

Both token lists of a text spell the same bytes. Each becomes a dictionary from the byte offset at
which a token ends to the token's place; the offsets in both dictionaries, sorted, slice the two id
lists into groups. All pairs of tokens within a group are linked.

A text is first cut at single spaces between characters that are not white space. Neither
vocabulary has a token across such a cut and neither tokenizer looks across it, so both lists end a
token there and the groups of a text are those of its units, end to end. A batch of texts aligns each
of its different units once; runs of units lie end to end under one pair of dictionaries, and the
links of a slice are expanded by numbers of rows in arrays.

The count of an id pair is the number of documents that hold it linked. A batch names each of its
pairs once, with the number of its documents that hold it, so a pair that every document holds
crosses the network once a batch. Sums come back to the batches that named the pair.

Texts that are null, empty, or that one of the vocabularies cannot spell (the second has no token
for U+2581, which it takes for a space) have no tokens: zeros and no groups. Long texts are whole.
Equal rows are documents of their own, also for the counts. An empty table gives an empty result.
Columns of the input stay, but for those that share a name with a column of the result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.batches import packed, unpacked
from panelspark.llm.common import slices
from panelspark.storage import cut_lineage

BATCH, RUN, LARGE = 4 << 20, 4096, 1 << 12
#: Python's white space and the one character that older tables count as such.
CUT = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
SPACED = re.compile("[\\s᠎] | [\\s᠎]")
#: Characters for which all regular expression libraries agree on letter, number and white space.
PLAIN = re.compile("[\t\n\r -~À-ɏ]*")
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def key_of(a, b):
    return a << 32 | b


def common_ends(size_a: list[int], size_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the groups in two token lists that spell the same bytes (one more than groups)."""
    ends_a = dict(zip(accumulate(size_a), count(1)))
    ends_b = dict(zip(accumulate(size_b), count(1)))
    common = sorted(ends_a.keys() & ends_b.keys())
    return np.array([0, *map(ends_a.__getitem__, common)]), np.array([0, *map(ends_b.__getitem__, common)])


def links_of(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number, pair key and multiplicity of all links; a large group is expanded over its different ids only."""
    na, nb = np.diff(to_a), np.diff(to_b)
    n = np.where(na * nb > LARGE, 0, na * nb)
    group = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    key = key_of(a[to_a[group] + place // np.maximum(nb[group], 1)], b[to_b[group] + place % np.maximum(nb[group], 1)])
    parts = [(group, key, np.ones(len(key), np.int64))]
    for g in np.flatnonzero(n < na * nb):
        (x, times), (y, more) = (np.unique(v, return_counts=True) for v in (a[to_a[g] : to_a[g + 1]], b[to_b[g] : to_b[g + 1]]))
        key = key_of(x[:, None], y[None, :]).ravel()
        parts.append((np.full(len(key), g), key, (times[:, None] * more[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class Units:
    """Alignments of many units: counts of tokens and groups, shown groups, and links unit after unit."""

    def __init__(self, n_a, n_b, n_groups, shown, unit, key, times):
        self.n_a, self.n_b, self.n_groups, self.shown = n_a, n_b, n_groups, shown
        order = np.argsort(unit, kind="stable")
        self.key, self.times = key[order], times[order]
        self.edges = np.searchsorted(unit[order], np.arange(len(n_a) + 1))


class Aligner:
    """Both tokenizers, without special tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # strings of special tokens are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the first file writes as themselves
        names = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printed)}
        model = json.load(open(byte_path, encoding="utf-8"))["model"]
        raw = {token: bytes(map(names.__getitem__, token)) for token in model["vocab"] if all(c in names for c in token)}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = raw.get(token, token.encode())
        # merges in the order of ids, as the faster library takes them; then both libraries merge alike
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        special = {t["content"] for t in json.load(open(byte_path, encoding="utf-8"))["added_tokens"]}
        ranks = {raw[t]: n for t, n in model["vocab"].items() if t not in special}
        in_order = merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b):
            raise ValueError("a piece of the second vocabulary spans words")
        self.size_a, self.size_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.ids)], object)  # ids and what follows them

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and PLAIN.fullmatch(t) is not None for t in texts]
        full = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        fast = self.fast and self.fast.encode_ordinary
        return [fast(" " + t) if p else next(full).ids for t, p in zip(texts, plain, strict=True)]

    def spelled(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def good(self, texts: list[str], ids: list) -> np.ndarray:
        """Which texts both lists spell; one look at all of them end to end settles most."""
        raws = [b" " + t.encode() for t in texts]
        size, whole = [*map(len, raws)], b"".join(raws)
        for k, tokens in ((0, self.bytes_a), (1, self.bytes_b)):
            flat = list(map(tokens.__getitem__, chain.from_iterable(x[k] for x in ids)))
            ends = np.append(0, np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))))[np.cumsum([len(x[k]) for x in ids])]
            if b"".join(flat) != whole or (ends != np.cumsum(size)).any():
                return np.fromiter((self.spelled(t, *x) for t, x in zip(texts, ids, strict=True)), bool, len(texts))
        return np.ones(len(texts), bool)

    def aligned(self, texts: list[str]) -> tuple[Units, np.ndarray]:
        """Alignments, and which of the texts both vocabularies can spell; the others have no tokens."""
        ids = list(zip(self.ids_a(texts), self.b.encode(texts, num_threads=1), strict=True))
        good = np.concatenate([np.zeros(0, bool), *[self.good(texts[k : k + RUN], ids[k : k + RUN]) for k in range(0, len(ids), RUN)]])
        ids = [x if ok else ([], []) for x, ok in zip(ids, good.tolist(), strict=True)]
        n_a, n_b = (np.fromiter((len(x[k]) for x in ids), np.int64, len(ids)) for k in (0, 1))
        groups, shown, links = [], [], []
        for k in range(0, len(ids), RUN):
            flat = [list(chain.from_iterable(x[j] for x in ids[k : k + RUN])) for j in (0, 1)]
            a, b = (np.array(x, np.int64) for x in flat)
            to_a, to_b = common_ends([*map(self.size_a.__getitem__, flat[0])], [*map(self.size_b.__getitem__, flat[1])])
            last = np.cumsum(n_a[k : k + RUN])  # a unit ends where a group ends
            first_group = np.append(0, np.searchsorted(to_a, last))
            groups.append(np.diff(first_group))
            shown += self.shown(a, b, to_a, to_b, first_group)
            group, key, times = links_of(a, b, to_a, to_b)
            links.append((k + np.searchsorted(first_group, group, side="right") - 1, key, times))
        nothing = np.zeros(0, np.int64)
        unit, key, times = (np.concatenate([nothing, *c]) for c in (zip(*links, strict=True) if links else [[]] * 3))
        return Units(n_a, n_b, np.concatenate([nothing, *groups]), shown, unit, key, times), good

    def shown(self, a, b, to_a, to_b, first_group) -> list[str]:
        """``a1,a2|b1;a3|b2`` for each unit."""
        na, nb = np.diff(to_a), np.diff(to_b)
        group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a[1:] - 1], last_b[to_b[1:] - 1] = 1, 2
        parts = np.empty(len(a) + len(b), object)  # tokens of the second list follow those of the first, group by group
        parts[np.arange(len(a)) + to_b[group_a]] = self.written[a + last_a * self.ids]
        parts[np.arange(len(b)) + to_a[group_b + 1]] = self.written[b + last_b * self.ids]
        parts, at = parts.tolist(), (to_a + to_b)[first_group].tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        return CUT.split(text) if SPACED.search(text) or text[0] == " " else text.split(" ")


@functools.cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def sums(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, where, values)
    return out


def spread(edges: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs ``chosen`` of an array cut by ``edges``: number of the choice, and place in the array."""
    size = np.diff(edges)[chosen]
    at = np.repeat(np.arange(len(chosen)), size)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + edges[chosen][at]


def linked_batch(texts: list[str | None], align: Aligner) -> tuple[list, pa.RecordBatch, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups and groups of all texts; their links; the different pairs sorted; in how many texts each is linked.

    Links are one row (place, times) per text: places among the pairs, and how often each is linked.
    """
    cut = [align.units(t) for t in texts]
    different = list(dict.fromkeys(chain.from_iterable(cut)))
    known, good = align.aligned(different)
    number = dict(zip(different, count()))
    if not good.all():  # only the whole text can tell whether its bytes differ
        bad = {u for u, ok in zip(different, good.tolist(), strict=True) if not ok}
        whole = list(dict.fromkeys(t for t, units in zip(texts, cut, strict=True) if not bad.isdisjoint(units)))
        extra, fine = align.aligned(whole)
        place = {t: len(different) + i for i, (t, ok) in enumerate(zip(whole, fine.tolist(), strict=True)) if ok}
        doc_units = [[*map(number.__getitem__, units)] if bad.isdisjoint(units) else [place[t]] if t in place else [] for t, units in zip(texts, cut, strict=True)]
        known = joined(known, extra)
    else:
        doc_units = [[*map(number.__getitem__, units)] for units in cut]
    n, size = len(texts), np.fromiter(map(len, doc_units), np.int64, len(texts))
    doc, unit = np.repeat(np.arange(n), size), np.fromiter(chain.from_iterable(doc_units), np.int64, size.sum())
    shown = [";".join(map(known.shown.__getitem__, units)) for units in doc_units]

    keys, place = np.unique(known.key, return_inverse=True)
    cell, times = np.unique(doc * max(1, len(known.n_a)) + unit, return_counts=True)
    cell_doc, cell_unit = np.divmod(cell, max(1, len(known.n_a)))
    at, link = spread(known.edges, cell_unit)
    cell, where = np.unique(cell_doc[at] * max(1, len(keys)) + place[link], return_inverse=True)  # document after document
    linked = sums(where, times[at] * known.times[link], len(cell))
    doc_of, place = np.divmod(cell, max(1, len(keys)))
    ends = np.searchsorted(doc_of, np.arange(n + 1)).astype(np.int32)
    links = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(linked))], names=["place", "times"])
    return [*(sums(doc, x[unit], n) for x in (known.n_a, known.n_b, known.n_groups)), shown], links, keys, np.bincount(place, minlength=len(keys))


def joined(x: Units, y: Units) -> Units:
    unit = np.concatenate([np.repeat(np.arange(len(x.n_a)), np.diff(x.edges)), len(x.n_a) + np.repeat(np.arange(len(y.n_a)), np.diff(y.edges))])
    both = [np.concatenate([getattr(x, c), getattr(y, c)]) for c in ("n_a", "n_b", "n_groups")]
    return Units(*both, x.shown + y.shown, unit, np.concatenate([x.key, y.key]), np.concatenate([x.times, y.times]))


def rest_of(docs: DataFrame, text: str) -> tuple[list[str], DataFrame, str]:
    """The columns to keep, rows (_rest, _text), and the type of ``_rest``."""
    rest = [c for c in docs.columns if c != text and c not in RESULT]
    rows = docs.select(F.struct(*rest).alias("_rest") if rest else F.struct(F.lit(0)).alias("_rest"), F.col(text).cast("string").alias("_text"))
    return rest, rows, rows.schema["_rest"].dataType.simpleString()


def stored_batches(rows: DataFrame, kind: str, byte_path: str, piece_path: str, hashed: bool) -> DataFrame:
    """A table with a row for each text (batch, i, _rest, n_a, n_b, n_groups, groups) and one for each batch (batch, links, pairs, held).

    With ``hashed``, groups are the SHA-256 of their text.
    """
    def made(batches):
        align, task = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 20
        for n, part in enumerate(slices(batches, "_text", BATCH)):
            (n_a, n_b, n_groups, shown), links, keys, held = linked_batch(part.column("_text").to_pylist(), align)
            if hashed:
                shown = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
            m, names = part.num_rows, ["batch", "i", "_rest", *RESULT[:3], "groups", "links", "pairs", "held"]
            none = [pa.nulls(m, t) for t in (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task + n)), pa.array(np.arange(m, dtype=np.int32)), part.column("_rest"),
                                              *map(pa.array, (n_a, n_b, n_groups)), pa.array(shown, pa.string()), *none], names=names)
            none = [pa.nulls(1, t) for t in (pa.int32(), part.column("_rest").type, *[pa.int64()] * 3, pa.string())]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (keys, held)]
            yield pa.RecordBatch.from_arrays([pa.array([task + n]), *none, pa.array([packed(links)], pa.binary()), *whole], names=names)

    schema = f"batch long, i int, _rest {kind}, n_a long, n_b long, n_groups long, groups string, links binary, pairs array<long>, held array<long>"
    return cut_lineage(rows.mapInArrow(made, schema), "aligned")


def counted(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (batch, pair, held) and (pair, count)."""
    named = stored.filter("links IS NOT NULL").select("batch", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("held").alias("held"))))
    return named, named.groupBy("pair").agg(F.sum("held").alias("count"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``a``, ``b`` and ``docs``, the number of documents that hold the pair linked."""
    _, rows, kind = rest_of(docs, text)
    counts = counted(stored_batches(rows, kind, byte_path, piece_path, True))[1]
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), F.col("count").alias("docs"))


def linked_sums(batches):
    """Per text its links, those with the highest count of their first id, and the sum of counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            links = unpacked(batch.column("links")[k].as_py())
            held, best = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) if batch.column(c)[k].is_valid else np.zeros(0, np.int64)
                          for c in ("counts", "best"))
            place, times = (links.column(c).flatten().to_numpy() for c in ("place", "times"))
            n = links.num_rows
            doc = np.repeat(np.arange(n), links.column("place").value_lengths().to_numpy())
            total = [sums(doc, x, n) for x in (times, times * best[place], times * held[place])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("batch")[k].as_py())), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, total)],
                                             names=["batch", "i", *RESULT[3:6]])


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", hashed: bool = False) -> DataFrame:
    """All columns but ``text``, and n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of the first tokenizer, of the second, group by group;
    with ``hashed``, it is the SHA-256 of that text ('' without tokens).
    """
    rest, rows, kind = rest_of(docs, text)
    stored = stored_batches(rows, kind, byte_path, piece_path, hashed)
    named, counts = counted(stored)
    counts = cut_lineage(counts, "pairs")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    told = counts.withColumn("a", F.shiftright("pair", 32)).join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = named.select("batch", "pair").join(told, "pair").groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("s"))  # a batch's pairs, in their order
    answers = answers.select("batch", F.transform("s", lambda x: x["count"]).alias("counts"), F.transform("s", lambda x: x["best"]).alias("best"))
    links = stored.filter("links IS NOT NULL").select("batch", "links").join(answers, "batch", "left")
    totals = links.mapInArrow(linked_sums, "batch long, i int, n_links long, n_best long, count_sum long")
    done = stored.filter("links IS NULL").drop("links", "pairs", "held").join(totals, ["batch", "i"])
    return done.select(*[F.col("_rest")[c].alias(c) for c in rest], *RESULT)


def digests(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document: doc_id, the counts, and the SHA-256 of its groups ('' without tokens)."""
    done = aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), byte_path, piece_path, hashed=True)
    return done.select("doc_id", *RESULT[:-1], F.col("groups").alias("groups_sha256"))


def brute_force(rows: list[tuple], byte_path: str, piece_path: str) -> list[tuple]:
    """The same digests from whole texts, byte by byte, for tests."""
    tools, found = Aligner(byte_path, piece_path), []
    for _, text in rows:
        ids = [tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)] if text else [[], []]
        groups: list[tuple] = []
        if text and all(b"".join(tokens[i] for i in x) == b" " + text.encode() for x, tokens in zip(ids, (tools.bytes_a, tools.bytes_b), strict=True)):
            a, b, i, j = 0, 0, 0, 0
            group: tuple = ([], [])
            while i < len(ids[0]) or j < len(ids[1]):
                if a <= b and i < len(ids[0]):
                    group[0].append(ids[0][i])
                    a += len(tools.bytes_a[ids[0][i]])
                    i += 1
                else:
                    group[1].append(ids[1][j])
                    b += len(tools.bytes_b[ids[1][j]])
                    j += 1
                if a == b:
                    groups.append(group)
                    group = ([], [])
        found.append(groups)
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in found]
    held = Counter(pair for pairs in links for pair in set(pairs))
    most: dict[int, int] = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs),
             sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs),
             hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else "")
            for (i, _), groups, pairs in zip(rows, found, links, strict=True)]
