"""Tokenizer alignment, centroid clustering and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from panelspark.llm import alignment, centroids, fingerprints, queries
from tests.llm.test_documents import rows_of, same, texts_of
from tests.oracle import compare, duck

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [(30, "x ▁y"), (31, "a  b   c "), (32, " lead"), (33, "<s> <unk> <0x41> </s>"), (34, "\x00\x1c ᠎ q​﻿"), (35, "日本 語\n\n\n\n x　y"),
       (36, "ﬁ Ǻ é"), (37, "\U0001f600\U0001f601 \U0001f468‍\U0001f469 ok"), (38, "   "), (39, "a b   c"), (40, "'s 's' don't")]


@pytest.mark.parametrize("batch", [4 << 20, 2000])
def test_alignment(documents, edge_rows, monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH", batch)
    rows = edge_rows + ODD
    assert same(rows_of(alignment.digests(documents(rows), A, B), *COLUMNS), alignment.brute_force(rows, A, B))


def test_alignment_of_sf(spark, sf):
    got = rows_of(queries.QUERIES["op13_tokenizer_alignment"](spark, sf), *COLUMNS)
    assert same(got, alignment.brute_force(texts_of(spark, sf), A, B))


def random_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "b ", "  ", "\n", "\t ", " é", "日", "▁", "1", "! ", " x", "\x1c", "\xa0", "\u180e", "'s", "ß", "ñ5", "×", "ǅ", "word ", " The", "ᾠ", "\u0301"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_alignment_units_cut_where_both_tokenizers_do(monkeypatch):
    """Units of texts give what whole texts give, also where runs of units are short."""
    monkeypatch.setattr(alignment, "RUN", 3)
    align, texts = alignment.Aligner(A, B), random_texts(4, 400)
    (_, _, n_groups, shown), found, keys, _ = alignment.linked_batch(texts, align)
    whole, good = align.aligned(texts)
    for i, text in enumerate(texts):
        ok = good[i] and text
        assert shown[i] == (whole.shown[i] if ok else ""), repr(text)
        assert n_groups[i] == (whole.n_groups[i] if ok else 0)
        links = dict(zip((keys[k] for k in found.column("place")[i].as_py()), found.column("times")[i].as_py(), strict=True))
        run = slice(whole.edges[i], whole.edges[i + 1])
        assert links == ({k: int(whole.times[run][whole.key[run] == k].sum()) for k in set(whole.key[run].tolist())} if ok else {})


def test_the_faster_library_gives_the_same_ids():
    align = alignment.Aligner(A, B)
    assert align.fast is not None and all(align.fast.encode_single_token(x) == i for i, x in enumerate(align.bytes_a[:50256]))
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xC0, 0x250))]
    texts = [x + c + y for c in chars for x, y in (("", ""), ("a", "a"), ("1", "1"), (" ", " "), ("!", "!"), ("'", "s"), ("\n", "\n"), ("é", "ß"))]
    rnd = random.Random(9)
    texts += ["".join(rnd.choice(chars) for _ in range(40)) for _ in range(500)]
    assert all(alignment.PLAIN.fullmatch(t) for t in texts)
    want = [x.ids for x in align.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert align.ids_a(texts) == want


def test_large_groups_are_not_expanded_pair_by_pair():
    a, b = np.array([9] + [1] * 50_000 + [2]), np.array([8] + [3] * 60_000)
    _, key, times = alignment.links_of(a, b, np.array([0, 1, 50_002]), np.array([0, 1, 60_001]))
    k = alignment.key_of
    assert dict(zip(key.tolist(), times.tolist(), strict=True)) == {k(9, 8): 1, k(1, 3): 50_000 * 60_000, k(2, 3): 60_000}


def test_alignment_keeps_columns_and_counts_documents(documents):
    docs = documents([(1, "one two"), (2, "one one"), (2, "one one"), (3, None)]).withColumnRenamed("batch", "n_a").withColumnRenamed("spans", "groups")
    got = alignment.aligned(docs, A, B)
    assert got.columns == [c for c in docs.columns if c not in ("text", "n_a", "groups")] + alignment.RESULT
    assert {r["doc_id"]: r["groups"] for r in got.collect()}[3] == ""
    counts = {(r["a"], r["b"]): r["docs"] for r in alignment.pair_counts(docs, A, B).collect()}
    tools = alignment.Aligner(A, B)
    pair = lambda t: (tools.a.encode(t, add_special_tokens=False).ids[0], tools.b.encode(t.strip())[0])
    assert counts == {pair(" one"): 3, pair(" two"): 1}


# ---- centroid clustering


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x string, n int").repartition(3)


def made(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64)) * 2
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 64)) * rng.choice([0.0, 0.1, 1.0], (n, 1))
    return [(i, np.float32(v).tolist()) for i, v in enumerate(x)]


ODD_VECTORS = [(900, None), (901, [1.0] * 63), (902, [float("nan")] + [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("inf")] * 64),
               (905, [1.0] * 65), (906, []), (907, [1e30] * 64)]


@pytest.mark.parametrize("rows", [made(300), made(300)[:5], [(i, [0.5] * 64) for i in range(40)], [(7, v) for _, v in made(30)] + [(None, [2.0] * 64), (8, [0.0] * 64)]])
def test_centroids(spark, rows):
    got = rows_of(centroids.digests(vectors(spark, rows + ODD_VECTORS)), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert same(got, centroids.brute_force(rows))


def test_centroids_without_vectors(spark):
    assert centroids.digests(vectors(spark, [])).count() == 0
    assert centroids.digests(vectors(spark, ODD_VECTORS)).count() == 0
    assert centroids.digests(vectors(spark, [(None, [1.0] * 64)])).count() == 0


def test_centroids_in_sql(spark, sf):
    n, m, diff, sample = compare(queries.QUERIES["op11_centroid_clustering"](spark, sf), duck(sf), queries.ORACLES["op11_centroid_clustering"])
    assert (n, diff) == (m, 0) and n > 0, sample


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.int64(rng.normal(size=(2000, 8)) * 40) + rng.integers(0, 6, (2000, 1)) * 500
    pivots = x[:10]
    bounds = centroids.Bounds(pivots + rng.integers(-30, 30, pivots.shape), pivots)
    cached = np.stack([centroids.squared(x, p) for p in pivots], axis=1)
    exact = np.stack([centroids.squared(x, c) for c in bounds.centroids])
    low = np.stack([bounds.lower(np.sqrt(cached.astype(float)), k) for k in range(10)])
    assert (low <= exact).all()
    cluster, distance = bounds.assign(x, cached)
    assert (cluster == exact.argmin(axis=0)).all() and (distance == exact.min(axis=0)).all()
    assert bounds.measured < 0.5 * exact.size


def test_bounds_are_safe_where_ptolemy_is_an_equality():
    """Points on one line make the bound exact; rounding must not lift it above the distance."""
    x = (np.arange(3000, dtype=np.int64)[:, None] * 40_503 + 12_345) * np.ones(64, np.int64)
    pivots, centres = x[[0, 2999]], x[::100] + 7
    bounds = centroids.Bounds(centres, pivots)
    cached = np.stack([centroids.squared(x, p) for p in pivots], axis=1)
    exact = np.stack([centroids.squared(x, c) for c in centres])
    cluster, distance = bounds.assign(x, cached)
    assert (cluster == exact.argmin(axis=0)).all() and (distance == exact.min(axis=0)).all()


# ---- fingerprints


def ordered(rows):
    """Rows as the operator orders them; ties of equal ids must hold equal texts here."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


FINGERPRINT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("batch,block", [(4 << 20, 1 << 16), (300, 128)])
def test_fingerprints(documents, edge_rows, monkeypatch, batch, block):
    monkeypatch.setattr(fingerprints, "BATCH", batch)
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rows = [(i, t if t is None else t[:6000]) for i, t in edge_rows if i is not None] + [(None, "no id, but a text that is longer than one window of the others")]
    got = rows_of(fingerprints.digests(documents(rows)), *FINGERPRINT)
    assert same(got, fingerprints.brute_force(ordered(rows)))


def test_fingerprints_of_sf(spark, sf):
    rows = texts_of(spark, sf)
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_fingerprints"](spark, sf).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    near, other = (np.array([got[i][c] for i, _ in rows]) for c in ("near_edited", "near_next"))
    assert (near >= 0).all() and (near <= 1).all() and (other <= 1).all()
    assert (near[:, None] > other[None, :]).mean() > 0.97 and np.median(near) > 0.6 and np.median(other) < 0.05


def test_equal_rows_are_spread_over_tasks(documents, spark):
    rows = [(5, "the same words again and again")] * 400 + [(i, f"text number {i}") for i in range(6, 100)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = rows_of(fingerprints.digests(documents(rows)), *FINGERPRINT)
    finally:
        spark.conf.set(key, before)
    assert same(got, fingerprints.brute_force(rows))


def test_fingerprints_of_few_documents(documents):
    assert fingerprints.digests(documents([])).count() == 0
    one = fingerprints.digests(documents([(5, "only one")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"only oon").hexdigest()
    blank = fingerprints.digests(documents([(5, None), (6, "")])).collect()
    assert {(r["n_chars"], r["fingerprint"], r["near_next"]) for r in blank} == {(0, "", 1.0)}


def test_likeness():
    rng, rank = random.Random(1), np.arange(fingerprints.CLASSES + 1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = text(9000), text(9000)
    x, y, z = fingerprints.fingerprints([a.encode(), b.encode(), (a[: len(a) // 2] + b[len(b) // 2 :]).encode()], rank)
    assert fingerprints.likeness(x, x) == 1 and fingerprints.likeness(x, y) < 0.05
    assert 0.35 < fingerprints.likeness(x, z) < 0.65 and fingerprints.likeness(x, z) == fingerprints.likeness(z, x)


def test_entropy_classes():
    rng = np.random.default_rng(0)
    for size in (0, 31, 32, 33, 500):
        raw = rng.integers(0, 6, size).astype(np.uint8)
        assert fingerprints.entropy_classes(raw).tolist() == fingerprints.slow_classes(raw.tobytes())
