"""Operators on texts against brute force, libraries and held-out labels."""

import base64
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import byte_bpe, near_dedup, packing, quality_crf, substring_dedup, suffix_dedup
from panelspark.llm.common import components, raw_bytes

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_rows(library, rows):
    out = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_byte_bpe(documents, edge_rows, library, monkeypatch, segment):
    monkeypatch.setattr(byte_bpe, "SEGMENT", segment)
    got = byte_bpe.digests(documents(edge_rows), RANKS, public_tokenizers.PATTERN)
    assert same(rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), bpe_rows(library, edge_rows))


def test_byte_bpe_tree(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF", 16)
    monoid, rnd = byte_bpe.Monoid(RANKS, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice("ab  \n\t'sé9! 日x\x1c\xa0\u2003") for _ in range(rnd.randint(0, 300)))
        ids = monoid.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert monoid.decode(ids) == text.encode()


def test_byte_bpe_sends_every_text_through_the_tree(library, monkeypatch):
    monoid, rnd, joins, roots = byte_bpe.Monoid(RANKS, public_tokenizers.PATTERN), random.Random(5), [], []
    join, root = byte_bpe.Monoid.join, byte_bpe.Monoid.root
    monkeypatch.setattr(byte_bpe.Monoid, "join", lambda self, a, b: joins.append(1) or join(self, a, b))
    monkeypatch.setattr(byte_bpe.Monoid, "root", lambda self, element: roots.append(1) or root(self, element))
    texts = ["".join(rnd.choice("ab  \n\t'sé9! 日x") for _ in range(n)) for n in (0, 1, 30, 1000, 3000, 16_384)]
    for text in texts:
        assert np.frombuffer(monoid.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(roots) == len(texts) and len(joins) >= 16


def test_byte_bpe_keeps_columns(documents):
    got = byte_bpe.encode(documents([(1, "a b"), (2, None)]), RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_rest", "_k1", "batch", "spans", "ids"]
    assert {r["doc_id"]: len(r["ids"]) for r in got.collect()}[2] == 0


# ---- packing


def test_word_ids(edge_rows, spark, sf):
    own, full = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    odd = ["ΑΣ İstanbul ÀÉÎ áb ﬁ 日本語 it'sx ''s 123", "x<|startoftext|>y", "a b c\x85d"]
    for text in [t or "" for _, t in edge_rows] + odd + [t for _, t in texts_of(spark, sf)[:60]]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


def check_packing(rows, got, capacity=packing.CAPACITY):
    full, want = Tokenizer.from_file(WORDS), []
    for i, t in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for n, a in enumerate(range(0, len(ids), capacity))]
    assert same([tuple(r[:5]) for r in got], want)
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(fill) <= 1.25 * total / capacity + 2


def test_packing(documents, edge_rows):
    check_packing(edge_rows, packing.pack(documents(edge_rows), WORDS).collect())


def test_packing_of_sf(spark, sf):
    check_packing(texts_of(spark, sf), packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), WORDS).collect())


def test_plan():
    rnd = random.Random(5)
    for _ in range(60):
        counts = {rnd.randint(1, 2048): rnd.randint(1, 400) for _ in range(rnd.randint(1, 80))}
        slots, placed, fill = packing.plan(counts), Counter(), defaultdict(list)
        for length, rank, n, first, per, offset in slots:
            assert rank == placed[length]
            placed[length] += n
            for j in range(n):
                fill[first + j // per].append((offset + j % per * length, length))
        assert placed == counts
        for places in fill.values():
            ends = 0
            for offset, length in sorted(places):
                assert offset == ends
                ends += length
            assert ends <= 2048
    # runs of bins, not bins: a plan does not grow with the number of documents
    assert len(packing.plan({700: 10**9, 300: 10**9, 50: 10**9})) < 20


# ---- suffix-array dedup


COLUMNS5 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute5(rows):
    return [(i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force([t for _, t in rows]), strict=True)]


def digests5(got):
    return [(r["doc_id"], len(r["_kept"]) + r["_removed"], r["_removed"], r["_runs"], hashlib.sha256(r["_kept"]).hexdigest()) for r in got.collect()]


@pytest.mark.parametrize("hot,length,gram", [(suffix_dedup.HOT, 400, 128), (0, 400, 128), (2, 400, 128), (1, 230, 64), (suffix_dedup.HOT, 230, 80)])
def test_suffix_dedup(documents, edge_rows, hot, length, gram):
    got = suffix_dedup.without_repeats(documents(edge_rows), hot=hot, length=length, gram=gram)
    want = [(i, *x) for (i, _), x in zip(edge_rows, suffix_dedup.brute_force([t for _, t in edge_rows], length), strict=True)]
    assert same(digests5(got), want)


def test_a_hot_string_is_refined_by_longer_anchors(documents):
    """One passage in many texts, longer and shorter than the window, with borders of all kinds; contexts of a third are alike."""
    rnd = random.Random(11)
    draw = lambda n, of="abcdefghij ": "".join(rnd.choice(of) for _ in range(n))
    long, short = draw(470), draw(370)
    rows = [(i, draw(rnd.randint(0, 40), "xy" if i % 3 else "x") + (long if i % 2 else short) + draw(rnd.randint(0, 40), "pq" if i % 3 else "p")) for i in range(120)]
    want = brute5(rows)
    assert sum(r[2] > 0 for r in want) > 60
    for hot in (0, 3, 40):
        assert same(digests5(suffix_dedup.without_repeats(documents(rows), hot=hot)), want), hot


def test_suffix_dedup_takes_columns_of_its_own_names(documents):
    docs = documents([(1, "a" * 500), (2, "b")]).withColumnRenamed("lang", "_kept").withColumnRenamed("source", "_removed").withColumnRenamed("spans", "_runs")
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == [c for c in docs.columns if c not in ("text", "_kept", "_removed", "_runs")] + ["_kept", "_removed", "_runs"]
    assert sorted(r["_removed"] for r in got.collect()) == [0, 500]


def test_suffix_dedup_of_sf(spark, sf):
    rows = texts_of(spark, sf)
    got = suffix_dedup.digests(spark.read.parquet(f"{sf}/documents.parquet"))
    assert same(rows_of(got, *COLUMNS5), brute5(rows))


def test_suffix_dedup_blocks(monkeypatch):
    """A text longer than a block gives the same anchors' windows as in one block."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    batch = pa.RecordBatch.from_pydict({"_id": [1], "_k1": [0], "_k2": [0], "text": [text]})
    rows = pa.Table.from_batches(list(suffix_dedup.anchors([batch]))).to_pylist()
    assert sorted(p for r in rows for p in range(r["p1"], r["p2"] + 1)) == list(range(len(text) - 399))


def test_suffix_dedup_blocks_of_several_texts(monkeypatch):
    """Texts that share a slice with one longer than a block keep all windows under their own keys."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    shared = [None if i == 5 else long[i : i + i * 60] for i in range(20)]
    for texts in ([long, *shared], [*shared, long], [*shared, long, *shared, long + "é"]):
        batch = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_k1": [0] * len(texts), "_k2": [0] * len(texts), "text": texts})
        for block in (700, 1500, 8 << 20):
            monkeypatch.setattr(suffix_dedup, "BLOCK", block)
            rows = pa.Table.from_batches(list(suffix_dedup.anchors([batch]))).to_pylist()
            seen = sorted((r["_id"], p) for r in rows for p in range(r["p1"], r["p2"] + 1))
            assert seen == [(i, p) for i, t in enumerate(texts) for p in range(len((t or "").encode()) - 399)]
            assert all(r["p1"] <= r["at"] <= r["p1"] + 272 and r["p2"] <= r["at"] for r in rows)


def test_suffix_dedup_of_long_and_short_texts_in_one_batch(documents):
    """Short texts behind one of more than a block; the long one repeats itself, which keeps the brute force small."""
    rnd = random.Random(3)
    draw = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    period, passage = draw(3000), draw(900)
    long = draw(500) + passage + period * (suffix_dedup.BLOCK // 3000 + 100) + passage[:450] + draw(50)
    short = [(i, draw(rnd.randint(0, 80)) + passage[rnd.randint(0, 200) : rnd.randint(500, 900)] + draw(80)) for i in range(1, 40)]
    rows = [(0, long), *short]
    got = suffix_dedup.without_repeats(documents(rows).coalesce(1).sortWithinPartitions("doc_id")).collect()
    done = [(r["doc_id"], len(r["_kept"]) + r["_removed"], r["_removed"], r["_runs"], hashlib.sha256(r["_kept"]).hexdigest()) for r in got]
    assert same(done, brute5(rows))


def test_suffix_dedup_workers_hold_little():
    """A worker's arrays and contexts have a size of their own, whatever an Arrow batch holds."""
    rnd = np.random.default_rng(4)
    texts = [bytes(x) for x in rnd.integers(97, 123, (1500, 4000), np.uint8)]
    ids = {k: [i if k == "_id" else 0 for i in range(len(texts))] for k in suffix_dedup.KEYS}
    batch = pa.RecordBatch.from_pydict({**ids, "text": texts})
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix_dedup.anchors([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1500 and peak < 100e6

    found = [[{"gram": i, "ctx": k, "n": 1, "n_ctx": 2, "p1": k, "p2": k + 3, "at": k + 20} for k in range(0, 300, 4)] for i in range(len(texts))]
    kind = "gram ctx n n_ctx p1 p2 at".split()
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in kind])))], names=["text", "found"]).slice(7)
    parts = list(suffix_dedup.contexts([batch]))
    assert max(p.num_rows for p in parts) <= suffix_dedup.SHOWN
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(x["gram"], x["ctx"], 1, 2, t[x["p1"] : x["at"]][::-1], t[x["at"] : x["p2"] + 400]) for t, f in zip(texts[7:], found[7:], strict=True) for x in f]


def test_suffix_dedup_tasks_run_one_worker_at_a_time(documents, monkeypatch):
    """No stored table comes from two Python steps in a row, which would hold two workers per core."""
    plans, write = [], suffix_dedup.cut_lineage

    def watched(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")))
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "cut_lineage", watched)
    passage = random.Random(5).randbytes(300).hex()
    texts = [(i, f"{i * 7919 % 1009:04d}" * 40 + passage + f"{i * 104729 % 1013:04d}" * 40) for i in range(12)]
    got = rows_of(suffix_dedup.without_repeats(documents(texts), hot=2), "doc_id", "_kept")
    assert got == rows_of(suffix_dedup.without_repeats(documents(texts)), "doc_id", "_kept")
    assert sum(name == "anchors" for name, _ in plans) > 2 and max(n for _, n in plans) == 1


def test_all_suffixes_leave_the_queue_at_once():
    gram = np.array([1, 1, 2, 2])
    same = [b"x" * 130 + bytes([i]) * 100 for i in (1, 2, 1, 2)]
    assert not suffix_dedup.repeated(gram, [b"", b"ab", b"", b""], same).any()
    assert not suffix_dedup.repeated(gram[:1], [b""], same[:1]).any()
    whole = [b"x" * 400, b"x" * 400]
    assert suffix_dedup.repeated(gram[:2], [b"a", b"b"], whole)[:, :2].tolist() == [[True, False], [True, False]]


def test_induced_order_with_shuffled_borders(documents):
    """Many texts that share a passage with different neighbours: every border is found exactly."""
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(700))
    rows = [(i, "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) + passage[rnd.randint(0, 150) : rnd.randint(540, 700)]
             + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    for hot in (10**6, 0):
        assert same(digests5(suffix_dedup.without_repeats(documents(rows), hot=hot)), brute5(rows))


# ---- substring dedup


COLUMNS8 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup(documents, edge_rows):
    assert same(rows_of(substring_dedup.digests(documents(edge_rows)), *COLUMNS8), substring_dedup.brute_force(edge_rows))


def test_substring_dedup_of_sf(spark, sf):
    got = substring_dedup.digests(spark.read.parquet(f"{sf}/documents.parquet"))
    assert same(rows_of(got, *COLUMNS8), substring_dedup.brute_force(texts_of(spark, sf)))


def test_substring_dedup_of_few_words(documents):
    """Runs and pairs at every border: texts over two words, many equal ids."""
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 15), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80)))) for _ in range(60)]
    assert same(rows_of(substring_dedup.digests(documents(rows)), *COLUMNS8), substring_dedup.brute_force(rows))


# ---- near-dedup


def brute2(rows):
    owner, hashes = near_dedup.strips(*raw_bytes(pa.array([t for _, t in rows], pa.string())))
    at = np.searchsorted(owner, np.arange(len(rows) + 1))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if n >= near_dedup.THRESHOLD * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), near_dedup.LAST), near_dedup.LAST if d is None else d)
    return [(d, None if least[find(i)] == near_dedup.LAST else least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("chunk", [near_dedup.CHUNK, 3])
def test_near_dedup_of_sf(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    got = near_dedup.document_classes(spark.read.parquet(f"{sf}/documents.parquet"))
    assert same(rows_of(got, "doc_id", "class_id"), brute2(texts_of(spark, sf)))


def test_near_dedup_of_edges(documents, edge_rows):
    got = near_dedup.document_classes(documents(edge_rows)).collect()
    assert same([(r["doc_id"], r["class_id"]) for r in got], brute2(edge_rows))
    classes = [r["class_id"] for r in got]
    alone = len({c for c in classes if c is not None}) + classes.count(None)  # each null class here is one row
    assert sum(r["kept"] for r in got) == alone < len(edge_rows)
    kept = near_dedup.keep_one(documents(edge_rows))
    assert kept.columns == documents([]).columns and kept.count() == alone


def test_near_dedup_chain_and_mixed_buckets(documents):
    """Near copies of near copies, and texts that share a passage but are not alike."""
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = words[5:] + [f"n{rnd.randint(0, 10**6)}" for _ in range(5)]
    common = [f"c{k}" for k in range(150)]
    rows += [(100 + i, " ".join(common + [f"u{i}_{k}" for k in range(100)])) for i in range(25)]
    got = near_dedup.document_classes(documents(rows))
    assert same(rows_of(got, "doc_id", "class_id"), brute2(rows))


def test_blocks_verify_pairs_of_unlike_signatures(monkeypatch):
    """A pair over the threshold is linked whatever its signatures say; one below it is not."""
    monkeypatch.setattr(near_dedup, "FLAT", 150)
    sets = [np.arange(100), np.arange(5, 105), np.arange(30, 130), np.arange(500, 600), np.arange(500, 581)]
    sig = [np.full(near_dedup.SIZE, k, "<u4").tobytes() for k in range(len(sets))]
    n = len(sets)
    for i, j, side in ((0, 0, [0] * n), (-1, 0, [1, 0, 0, 1, 0])):
        group = pa.table({"bucket": [1] * n, "i": [i] * n, "j": [j] * n, "side": side, "rid": list(range(n)), "root": list(range(n)),
                          "sig": sig, "set": [x.astype("<u4").tobytes() for x in sets]})
        links = near_dedup.near_links(group).to_pylist()
        assert [sorted(r.values()) for r in links] == [[0, 1], [3, 4]]


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join(base[:250] + [f"x{i}" for i in range(50)]), " ".join(base + base)]
    owner, hashes = near_dedup.strips(*raw_bytes(pa.array(texts)))
    many = [near_dedup.signatures(owner, hashes + np.uint64(rnd.getrandbits(60)), 3) for _ in range(20)]
    sets = [set(hashes[owner == i].tolist()) for i in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(np.mean([(s[i] == s[j]).mean() for s in many]) - true) < 0.03


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in parent.items() if any(a != b and n in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- quality


def test_quality_on_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_crf.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    known = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([g["predicted"] == y for g, y in known]) >= 0.97
    good, bad = ([g["score"] for g, y in known if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.98


def test_quality_edges(documents, edge_rows, spark):
    docs = documents(edge_rows)
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (16, 0, 0), (19, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_crf.scores(docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    unknown = quality_crf.scores(docs, labels.filter("false")).collect()
    assert {r["score"] for r in unknown} == {0.5}
    assert quality_crf.score(docs, None).columns == [*docs.columns, "score"]


def test_quality_sends_texts_alone_and_scores_once(documents, spark):
    docs = documents([(i, f"Line {i} is here.\nAnd another | one {i}!") for i in range(50)]).withColumnRenamed("lang", "lang.of")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    chain = quality_crf.train(docs, labels)
    done = quality_crf.score(docs, chain).filter("score >= 0")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert rows_of(done, "doc_id", "score") == rows_of(quality_crf.scores(docs, labels), "doc_id", "score")
    assert done.columns == [*docs.columns, "score"] and {r["lang.of"] for r in done.collect()} == {"en"}


def test_training_texts_of_repeated_ids(documents, monkeypatch):
    """One text per sampled label, the same one in any order, however often a doc_id is repeated."""
    monkeypatch.setattr(quality_crf, "fit", lambda texts, y: list(zip(texts, y, strict=True)))
    docs = documents([(1, f"text {i}") for i in range(200)] + [(i, f"only {i}") for i in range(2, 30)])
    labels = docs.select("doc_id", (F.col("doc_id") > 1).cast("int").alias("quality"))
    got = quality_crf.train(docs.coalesce(1).orderBy("doc_id", "text"), labels, 100)
    assert got == quality_crf.train(docs.coalesce(1).orderBy(F.desc("doc_id"), F.desc("text")), labels, 100)
    assert sorted(t for t, y in got if y) == sorted(f"only {i}" for i in range(2, 30) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert sum(1 - y for _, y in got) == 1


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(0)
    score, moves, doc = rnd.normal(size=7), rnd.normal(size=(2, 2)), np.array([0, 0, 0, 1, 2, 2, 2])
    p, expected = quality_crf.marginals(score, doc, moves)
    total = np.zeros((2, 2))
    for d in range(3):
        own = np.flatnonzero(doc == d)
        weight, good, pairs = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for code in range(2 ** len(own)):
            y = [(code >> k) & 1 for k in range(len(own))]
            w = np.exp(sum(score[i] * v for i, v in zip(own, y, strict=True)) + sum(moves[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
            weight += w
            good += w * np.array(y)
            for a, b in zip(y[:-1], y[1:], strict=True):
                pairs[a, b] += w
        assert np.allclose(p[own], good / weight)
        total += pairs / weight
    assert np.allclose(expected, total)


# ---- empty tables


def test_empty_tables(documents, spark):
    none = documents([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert byte_bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, WORDS).count() == 0
    assert suffix_dedup.digests(none).count() == 0
    assert substring_dedup.digests(none).count() == 0
    assert near_dedup.document_classes(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0
    assert quality_crf.scores(none, labels).count() == 0
