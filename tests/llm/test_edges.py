"""Empty tables and very long texts, for every operator on documents and for the pipeline."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixture
from tillwatch.llm import credentials, decontaminate, licenses, lines, mixing, neardup, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id string, text string"


def digests(spark, docs, labels, benchmark):
    return {
        "op1": licenses.license_digest(docs),
        "op3": toxicity.toxic_digest(docs, labels),
        "op4": neardup.group_digest(docs),
        "op6": lines.line_digest(docs),
        "op7": decontaminate.leak_digest(docs, benchmark),
        "op8": mixing.mix_digest(docs),
        "op9": quality.quality_digest(docs, labels),
        "op10": credentials.secret_digest(docs),
    }


def test_empty_tables(spark):
    docs = spark.createDataFrame([], fixture.SCHEMA)
    labels, benchmark = spark.createDataFrame([], LABELS), spark.createDataFrame([], BENCHMARK)
    for name, out in digests(spark, docs, labels, benchmark).items():
        assert out.collect() == [], name


@pytest.fixture(scope="module")
def long_docs(spark):
    import random

    rng = random.Random(14)
    texts = [
        "a" * 300_000,
        " ".join(fixture.babble(rng, 60_000)),
        "\n".join(" ".join(fixture.babble(rng, 6)) for _ in range(8000)),
        "\n" * 200_000,
        ("word " * 5 + "\n") * 8000,
        "a.B3/" * 60_000,
        None,
        "",
    ]
    rows = [(i, t, "en", "s", 1, 1, "w", "c", 2, "f", "s", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, fixture.SCHEMA).repartition(4).cache()


def test_very_long_texts(spark, long_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0)], LABELS)
    window = long_docs.where("doc_id = 1").select(F.substring_index("text", " ", 30)).first()[0]
    benchmark = spark.createDataFrame([("i", window), ("j", "word word")], BENCHMARK)
    for name, out in digests(spark, long_docs, labels, benchmark).items():
        start = time.perf_counter()
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) == set(range(8)), name
        assert time.perf_counter() - start < 120, name
        if name == "op6":
            assert rows[4]["n_removed"] == 7999 and rows[3]["n_removed"] == 0
        if name == "op7":
            assert rows[1]["n_hit"] >= 30 and rows[4]["n_hit"] == 40_000 and rows[0]["n_hit"] == 0
        if name == "op8":
            assert rows[1]["size"] == 60_000 and rows[0]["size"] == 1 and rows[3]["size"] == 0


def write(tables, folder):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"documents": docs, "labels": spark.createDataFrame([], LABELS), "benchmark": spark.createDataFrame([], BENCHMARK)}
    out = corpus_pipeline.run(spark, write(tables, tmp_path))
    assert out.collect() == [] and set(docs.columns) < set(out.columns)
