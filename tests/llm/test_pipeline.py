"""The pipeline against brute force, stage by stage, and the registration of the package."""

import importlib
import random
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from panelspark.llm import near_dedup, queries, quality_crf, substring_dedup
from panelspark.storage import application_dir, children
from tests.llm.test_documents import brute2, check_packing, texts_of


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = quality_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = quality_crf.score(docs, chain).orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in scored if r["score"] >= quality_crf.CUT]
    assert 0 < len(rows) < len(scored)
    rows = [(i, t) for (i, t), (_, c) in zip(rows, brute2(rows), strict=True) if i == c]
    rows = [(i, cut(t, [u for _, u in rows])) for i, t in rows]
    check_packing(rows, corpus_pipeline.run(spark, sf).collect())


def cut(text, texts, cache={}):  # noqa: B006
    n, key = corpus_pipeline.PASSAGE, id(texts[0])
    if key not in cache:
        seen = {}
        for t in texts:
            raw = t.encode()
            for p in range(len(raw) - n + 1):
                seen[raw[p : p + n]] = seen.get(raw[p : p + n], 0) + 1
        cache.clear()
        cache[key] = seen
    raw, seen = text.encode(), cache[key]
    gone = set()
    for p in range(len(raw) - n + 1):
        if seen[raw[p : p + n]] > 1:
            gone.update(range(p, p + n))
    return bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")


def test_stages_return_document_columns(spark, documents, edge_rows):
    docs = documents(edge_rows)
    assert near_dedup.keep_one(docs).schema == docs.schema
    done = corpus_pipeline.repeated_passages(spark, docs, "")
    assert done.columns == docs.columns and done.count() == len(edge_rows)


def test_stages_keep_columns_that_have_names_of_their_own(spark, documents, edge_rows, sf):
    docs = documents(edge_rows).withColumnsRenamed({"lang": "_kept", "source": "_removed", "spans": "_quality", "batch": "_runs"})
    done = corpus_pipeline.repeated_passages(spark, docs, "")
    assert done.schema == docs.schema and {r["_kept"] for r in done.collect()} == {"en"} and {r["_quality"] for r in done.collect()} == {"s"}
    assert corpus_pipeline.quality(spark, docs, sf).schema == docs.schema
    assert near_dedup.keep_one(docs).schema == docs.schema
    clash = docs.withColumnsRenamed({"_kept": "_words"})
    assert sorted(substring_dedup.without_repeats(clash).columns) == sorted([c for c in clash.columns if c not in ("text", "_words", "_removed")] + ["_words", "_removed", "_kept"])


@pytest.mark.parametrize("words,least", [(range(51, 61), 0.97), (range(61, 81), 1.0), (range(81, 121), 1.0)])
def test_planted_passages_go_and_clean_documents_stay(spark, documents, words, least):
    """Random passages of over 50 words in two documents each, by length class; the words are as long as those of the corpus."""
    rnd = random.Random(words[0])
    sizes = [len(w) for _, t in texts_of(spark, "/root/testdata/sf0.001")[:50] for w in t.split()]
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.choice(sizes))) for _ in range(n))
    planted = [text(rnd.choice(words)) for _ in range(40)]
    rows = [(2 * i + k, f"{text(60)} {p} {text(60)}") for i, p in enumerate(planted) for k in (0, 1)]
    clean = [(1000 + i, text(200)) for i in range(40)]
    done = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, documents(rows + clean), "").collect()}
    caught = sum(p not in done[2 * i] and p not in done[2 * i + 1] for i, p in enumerate(planted))
    assert caught >= least * len(planted)
    assert all(done[i] == t for i, t in clean)


def test_run_frees_the_tables_of_its_stages(spark, sf):
    there = set(children(spark, application_dir(spark)))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [p.rsplit("/", 1)[1] for p in children(spark, application_dir(spark)) if p not in there]
    assert len(left) == 1 and left[0].startswith("pipeline-pack")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry_without_the_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("panelspark.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("panelspark.llm")
    monkeypatch.setitem(sys.modules, "panelspark.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    assert "pipeline" not in bare.queries() and "select_candidates" in bare.queries() and "op4_url_filters" not in bare.oracle_sql()


CONTRACT = {
    "op1_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_cover_tree": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_quality_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op13_tokenizer_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


def test_query_columns(spark, sf):
    for name, columns in CONTRACT.items():
        df = queries.QUERIES[name](spark, sf)
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == columns, name
