"""One query per operator of this package, over the whole table it is made for."""

from __future__ import annotations

import public_tokenizers

from panelspark.llm import alignment, ann, byte_bpe, centroids, cover_tree, fingerprints, near_dedup, packing, quality_crf, substring_dedup, suffix_dedup, url_filters, warc
from panelspark.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_byte_bpe")
def byte_bpe_digests(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


@query("op5_suffix_dedup")
def suffix_dedup_digests(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("op10_quality_crf")
def quality_scores(spark, sf_dir):
    return quality_crf.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_substring_dedup")
def substring_dedup_digests(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query("op2_near_dedup")
def near_dedup_classes(spark, sf_dir):
    return near_dedup.document_classes(table(spark, sf_dir, "documents"))


@query("op7_warc", warc.ORACLE)
def warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op1_ann")
def ann_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op3_cover_tree", cover_tree.ORACLE)
def cover_tree_links(spark, sf_dir):
    return cover_tree.linked(table(spark, sf_dir, "embeddings"))


@query("op4_url_filters", url_filters.ORACLE)
def url_filter_decisions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filters.evaluate(url_filters.dated(pages), url_filters.entries_of(pages))


@query("op11_centroid_clustering", centroids.ORACLE)
def centroid_clusters(spark, sf_dir):
    return centroids.digests(table(spark, sf_dir, "embeddings"))


@query("op12_fingerprints")
def document_fingerprints(spark, sf_dir):
    return fingerprints.digests(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
