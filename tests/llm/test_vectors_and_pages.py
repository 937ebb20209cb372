"""Operators on vectors and pages."""

import base64
import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import ann, cover_tree, queries, url_filters, warc
from panelspark.llm.vectors import places
from tests.oracle import compare, duck


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string")


ODD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7),
       (905, [1.0, 2.0]), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    made = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 8)) * rng.choice([0.02, 0.3, 0.8], (500, 1))
    made[100:160] = made[100]  # equal vectors
    made[160:220] = made[160] + rng.normal(size=(60, 8)) * 1e-3
    return [(int(i), np.float32(v).tolist()) for i, v in enumerate(made)]


def brute_links(rows):
    ids = [i for i, v in rows]
    x = cover_tree.unit(np.array([v for _, v in rows], float))
    near = x @ x.T >= cover_tree.COSINE
    np.fill_diagonal(near, False)
    root = np.array(ids)
    for _ in range(len(ids)):
        new = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
        if (new == root).all():
            break
        root = new
    return {i: (int(n), int(r), i == int(r)) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}


@pytest.mark.parametrize("block", [cover_tree.BLOCK, 40])
def test_cover_tree(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    got = cover_tree.linked(vectors(spark, clustered + [clustered[3]] + ODD)).collect()
    want = brute_links(clustered) | {i: (0, i, True) for i, _ in ODD}
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(found)
    assert {k: v for k, v in found.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_cover_tree_counts_tight_nodes_without_opening():
    rng = np.random.default_rng(3)
    x = cover_tree.unit(np.ones(16) + rng.normal(size=(400, 16)) * 1e-3)
    dual = cover_tree.Dual(x, np.ones(400, np.int64), 0.9)
    dual.exact = lambda *_: pytest.fail("opened")
    top = cover_tree.nodes(x, np.arange(400), 0)
    assert len(top) == 1
    dual.inside(top[0])
    assert (dual.links == 399).all()


def test_cover_tree_compares_few_vectors_without_clusters():
    """Wide nodes of a few members are opened once per block; before, all their members met those of all others."""
    rng = np.random.default_rng(5)
    x = cover_tree.unit(rng.normal(size=(3000, 64)) + 1.2 * rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)])
    seen = {}
    for name, top in (("wide", cover_tree.nodes(x, np.arange(3000), 0)), ("opened", cover_tree.tops(x, 0.9))):
        dual, seen[name] = cover_tree.Dual(x, np.ones(3000, np.int64), 0.9), 0
        def exact(i, j, name=name, plain=dual.exact):
            seen[name] += len(i)
            plain(i, j)
        dual.exact = exact
        for node in top:
            dual.inside(node)
        dual.cross(top, top)
        assert (dual.links == (x @ x.T >= 0.9).sum(axis=1) - 1).all()
    assert seen["opened"] < 3000 and seen["wide"] > 100 * seen["opened"]


def test_cover_tree_reads_blocks_where_they_are_stored(spark, clustered, monkeypatch):
    """Pairs of blocks meet without an exchange; before, a block was sent once per block it met. Signed zeros are equal."""
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    plans, cut = {}, cover_tree.cut_lineage

    def kept(df, name="cut"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(cover_tree, "cut_lineage", kept)
    zeros = [(600 + i, [z, 1.0, z, 2.0, z, -3.0, z, 0.5]) for i, z in enumerate((0.0, -0.0, -0.0, 1e-30))]
    got = cover_tree.linked(vectors(spark, clustered + zeros)).collect()
    assert "CartesianProduct" in plans["links"] and "FlatMapGroupsInArrow" not in plans["links"]
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_links(clustered + zeros)


@pytest.mark.parametrize("decay", [0.0, 0.05])
def test_cover_tree_front_loses_no_link(decay):
    """Centres are screened by some components and the length of the rest; links and forests are those of all components."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 64)) * np.exp(-decay * np.arange(64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x[600:900] = x[:300] + rng.normal(size=(300, 64)) * rng.choice([0.02, 0.1, 0.16], (300, 1)) * np.abs(x[:300]).mean()
    x[900:1000] = x[900] + rng.normal(size=(100, 64)) * 1e-3
    x = cover_tree.unit(x)
    front, sides = cover_tree.Front(x, 0.9), []
    assert front.size < 64
    for part in (slice(0, 700), slice(700, 1200)):
        top, ids = cover_tree.tops(x[part], 0.9), np.arange(part.start, part.stop)
        order = np.concatenate([t.members for t in top])
        sides.append((ids[order], np.ones(len(ids), np.int64), x[part][order], np.array([len(t.members) for t in top]), np.array([t.radius for t in top])))
    near = x @ x.T >= 0.9
    for some, own in ((sides, near[:700, 700:]), (sides[:1], near[:700, :700] & ~np.eye(700, dtype=bool))):
        dual = cover_tree.Dual(x, np.ones(len(x), np.int64), 0.9, front)
        assert dual.front.shape[1] == front.size + 1
        got = cover_tree.compared(some, 0.9, front).to_pydict()
        links = dict(zip(got["vec_id"], got["links"], strict=True))
        want = np.concatenate([own.sum(axis=1), own.sum(axis=0)]) if len(some) == 2 else own.sum(axis=1)
        assert links == {i: int(n) for i, n in enumerate(want) if n}


def test_places():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 64, 1000, 1003):
        for share in (0, 0.002, 0.1, 0.9):
            mask = rng.random(n) < share
            assert places(mask).tolist() == np.flatnonzero(mask).tolist()


def test_empty_vectors(spark):
    assert cover_tree.linked(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, []), "vec_id % 20 = 0").count() == 0
    assert ann.search(vectors(spark, ODD), "vec_id % 20 = 0").count() == 0
    assert {r["component_id"] for r in cover_tree.linked(vectors(spark, ODD[:3])).collect()} == {900, 901, 902}


def exact_search(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        score = (x * x[ids == q][0]).sum(axis=1)
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
    return out


@pytest.mark.parametrize("chunk", [ann.CHUNK, 7])
def test_ann(spark, clustered, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "LEAF", 16)
    got = ann.search(vectors(spark, clustered + [clustered[0]] + ODD), "vec_id % 20 = 0").collect()
    want, found = exact_search(clustered), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {i: np.array(v, float) for i, v in clustered}
    for q, rows in found.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - (scores[q] * scores[i]).sum()) < 1e-12 for i, s in rows)


def test_ann_recall_on_a_whole_table_without_clusters(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, found = exact_search(rows), {}
    for r in queries.QUERIES["op1_ann"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for i, _ in want[q]}) for q in want)
    assert found.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_ann_of_equal_vectors_takes_small_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    got = ann.search(vectors(spark, rows), "vec_id = 40").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20)) and [r["rank"] for r in got] == list(range(1, 21))
    assert ann.search(vectors(spark, rows[:3]), "vec_id = 0").count() == 2


def test_ann_screens_tiles_of_queries_and_vectors(monkeypatch):
    """One product per leaf and tile of queries, not one per leaf and query; ties, own ids, equal and nearly equal vectors."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[200:500] = x[200]
    x[600:900] = x[600] + np.float32(1e-7) * rng.normal(size=(300, 16)).astype(np.float32)
    ids, leaf = rng.permutation(3000).astype(np.int64), np.sort(rng.integers(0, 30, 3000))
    asked = np.concatenate([np.arange(180, 220), np.arange(590, 620), np.arange(2000, 2300)])
    visits = rng.random((len(asked), 30)) < 0.5
    calls, screen = [], ann.Best.screen
    monkeypatch.setattr(ann.Best, "screen", lambda self, block, a, b, who: (calls.append(len(who)), screen(self, block, a, b, who))[1])
    monkeypatch.setattr(ann, "WAITING", 500)
    best = ann.Best(x[asked], ids[asked], np.full(len(asked), -np.inf), 20)
    for a, b in ((0, 1000), (1000, 3000)):
        best.meet(ann.Block(x[a:b], ids[a:b], leaf[a:b]), lambda part: np.flatnonzero(visits[:, part]))
    assert len(calls) <= 32 and sum(calls) >= visits.sum()
    found = best.batch().to_pydict()
    want = []
    for q, seen in zip(asked, visits, strict=True):
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        own = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q] and seen[leaf[i]]][:20]
        want += [(int(ids[q]), int(ids[i]), float(score[i]), int(leaf[i])) for i in own]
    assert sorted(zip(*(found[c] for c in ("query_id", "vec_id", "score", "leaf")), strict=True)) == sorted(want)


@pytest.mark.parametrize("scale", [1e-100, 1e100])
def test_ann_of_numbers_beyond_single_precision(spark, clustered, scale):
    rows = [(i, [c * scale * (1 + i % 7) for c in v]) for i, v in clustered]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    found, want = {}, exact_search(rows)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert sum(len(set(found[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_ann_exchanges_a_vector_once(spark, clustered, monkeypatch):
    """Queries of all teams meet a block of vectors where it is stored; before, each vector was sent once per team."""
    monkeypatch.setattr(ann, "CHUNK", 10)
    found = ann.search(vectors(spark, clustered), "vec_id % 2 = 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan
    assert found.count() == 250 * 20


@pytest.mark.parametrize("name", ["op3_cover_tree", "op4_url_filters", "op7_warc"])
def test_oracle(spark, sf, name):
    n, m, diff, sample = compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name])
    assert (n, diff) == (m, 0), sample


# ---- WARC


def page_rows():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    rnd = random.Random(6)
    rows = [(i, f"http://h{i}.example.com/ä b", f"<p>{rnd.random()}</p>" * rnd.randint(0, 200)) for i in range(60)]
    rows += [(100 + i, None, "same" * 50) for i in range(20)] + [(90, "u", "same" * 50), (90, "u", "same" * 50)]
    rows += [(200, "u\r\nX: y", fake), (201, "u", "a" + fake * 40), (202, "u", "WARC/1.1\r\n"), (203, "u", None), (204, "u", ""), (None, "u", "no id"), (None, "u", "")]
    return rows + [(205, "u", "é" * 9000), (206, "u", "\r\n\r\n"), (207, "u", "x" * 70_000), (208, "u", "lone\nWARC/1.1")]


def want_pages(rows, least):
    first = {}
    for i, _, html in rows:
        h = html or ""
        if len(h.encode()) >= least:
            first[h] = min(first.get(h, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for i, _, html in rows:
        h = html or ""
        f = first.get(h)
        again = f is not None and f != (1 << 63) and f != i
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((i, len(h.encode()), digest, "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split,least", [("128m", 0), ("2k", 0), ("300", 200)])
def test_warc(spark, split, least):
    """Separators inside payloads, also where files are cut into many splits."""
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((tuple(r) for r in warc.round_trip(pages, least).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want_pages(page_rows(), least)


def test_warc_empty_and_broken(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(i, "u", f"p{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"))
    part = next((tmp_path / "a").glob("part-*"))
    raw = part.read_bytes()
    assert raw.count(b"WARC/1.1\r\n") == 5
    (tmp_path / "b").mkdir()
    starts = [i for i in range(len(raw)) if raw.startswith(b"WARC/1.1\r\n", i)]
    (tmp_path / "b" / "cut.warc").write_bytes(raw[: starts[4] - 5])  # ends inside the fourth record
    (tmp_path / "b" / "end.warc").write_bytes(raw[starts[4] : -5])
    (tmp_path / "b" / "gap.warc").write_bytes(raw[starts[0] : starts[1]] + b"lost" + raw[starts[1] : starts[2]])  # the chain ends at the gap
    whole = [raw[a:b].split(b"<urn:page:")[1].split(b">")[0] for a, b in zip(starts[:3], starts[1:4], strict=True)]
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path / "b")).collect()) == sorted(int(x) for x in [*whole, whole[0]])


# ---- URL filters


def test_url_filters(spark):
    day = datetime.date
    captures = spark.createDataFrame([
        (1, "https://a.b.example.com/x/y", day(2024, 1, 1), "k"), (2, "https://a.b.example.com/x/y", day(2024, 1, 10), "k"),
        (3, "https://a.b.example.com/x/y", day(2024, 1, 20), "k"), (4, "http://A.B.EXAMPLE.com:80/X", day(2024, 1, 10), "k"),
        (5, "http://c.example.com/", day(2024, 1, 10), "k"), (6, None, day(2024, 1, 10), "k"), (7, "not a url", day(2024, 1, 10), "k"),
        (8, "http://u@b.example.com/z", None, "k"), (9, "http://b.example.com", day(2024, 2, 1), "k"), (9, "http://b.example.com", day(2024, 2, 1), "k"),
        (10, "http://notb.example.com/", day(2024, 1, 10), "k"),
    ], "page_id long, url string, fetched date, pattern string")
    entries = spark.createDataFrame([
        ("b.example.com", "abuse", "block", day(2024, 1, 5)), ("b.example.com", "abuse", "remove", day(2024, 1, 15)),
        ("B.example.com", "abuse", "block", day(2024, 1, 25)), ("a.b.example.com/x", "review", "allow", day(2024, 1, 18)),
        ("c.example.com", "abuse", "block", day(2024, 1, 10)), ("c.example.com", "abuse", "remove", day(2024, 1, 10)),
        ("c.example.com", "review", "allow", day(2024, 1, 1)), (None, "abuse", "block", day(2024, 1, 1)), ("x.example.com", "abuse", "wrong", day(2024, 1, 1)),
    ], "pattern string, list_name string, action string, since date")
    got = url_filters.evaluate(captures, entries)
    assert got.columns == ["page_id", "url", "fetched", "decision", "pattern", "list_name", "since"]
    want = [(1, "none"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "none"), (7, "none"), (8, "none"), (9, "block"), (9, "block"), (10, "none")]
    assert sorted((r["page_id"], r["decision"]) for r in got.collect()) == want
    assert url_filters.evaluate(captures.filter("false"), entries).count() == 0
    assert {r["decision"] for r in url_filters.evaluate(captures, entries.filter("false")).collect()} == {"none"}


def test_url_filters_stay_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op4_url_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
