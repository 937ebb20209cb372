import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()), StructField("_rest", StringType()),
                   StructField("_k1", IntegerType()), StructField("batch", IntegerType()), StructField("spans", StringType())])
SENTENCE = "Of all the harbours on this coast only the northern one keeps its lamps lit through the winter storms and fog"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables with columns whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "r", 1, None, "s") for i, t in rows], DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows, ties, repeats inside a text and across texts."""
    passage = " ".join(f"{w}{i}" for i in range(6) for w in SENTENCE.split())
    words = " ".join(f"w{(i * i * 7919) % 100003}x{i}" for i in range(12000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three four"), (6, "one two three four"), (7, passage), (7, passage),
        (8, "Here begins " + passage + " and ends"), (9, passage[:399]), (10, passage[:400]), (11, "é" * 900), (12, "ab" * 1000),
        (13, "x" * 50_000), (14, words), (15, words[:60_000] + " tail " + passage), (16, "the " * 40), (17, "q " + "the " * 30 + "z"),
        (None, passage + " null id"), (None, "another null id " + SENTENCE), (18, "日本語 " * 300), (-5, SENTENCE + " " + SENTENCE),
        (19, "line one is here.\n" * 80), (20, "tab\tand\x0bvertical\x0cfeed\rreturn" * 30), (21, "<|endoftext|> it's DON'T \x1c x"),
    ]
