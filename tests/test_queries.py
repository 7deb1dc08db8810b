"""Every registered query on empty tables, and on tables with doubled rows and extra columns that clash with the engine's own."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = [
    "observations", "video_cards", "meme_records", "annotations", "creation_examples", "generation_responses", "documents", "events", "orders", "lineitem", "split_fractions", "language_samples", "context_windows",
]
#: Small tables of a fixed content, which stay as they are.
FIXED = {"split_fractions", "language_samples", "context_windows"}
#: Queries of one row whatever the input, and those that list small files or fixed tables.
ALWAYS = {"src_binary", "src_json_strict", "src_sqlite", "ex_summarize", "snk_multi", "src_jsonl2"}
CORE = sorted(n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit()) or n == "p7_found")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        (df if t in FIXED else df.where("false")).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """Some rows of every table twice, all their strings null in a third copy, and extra columns."""
    d = str(tmp_path_factory.mktemp("dirty"))
    for t in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        if t not in FIXED:
            some = df.limit(60)
            nulls = some.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.dataType.typeName() in ("string", "array", "struct") else F.col(f.name) for f in df.schema])
            df = some.unionByName(some).unionByName(nulls)
            df = df.withColumn("rank", F.lit("x")).withColumn("n", F.lit("x")).withColumn("root", F.lit("x")).withColumn("reason", F.lit("x"))
        df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", CORE)
def test_empty_tables_give_empty_results(spark, empty, name):
    n = entry.queries()[name](spark, empty).count()
    assert n == 0 or name in ALWAYS


@pytest.mark.parametrize("name", CORE)
def test_nulls_repeated_rows_and_extra_columns(spark, dirty, name):
    assert entry.queries()[name](spark, dirty).count() >= 0
