"""Queries over whole tables."""

import hashlib
import re

import duckdb
import pytest
from compare import duck, rows

from pyspark.sql import functions as F

from tracelode import schema as S
from tracelode.functions import text as X
from tracelode.plans.catalog import QUERIES, SQL


def duck_folder(path, *tables):
    """DuckDB over tables that Spark has written."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con


def test_sclc_normalizes_every_page(spark, sf):
    got = rows(QUERIES["sclc_normalize"](spark, sf).toPandas())
    want = rows(duck(sf).execute(SQL["sclc_normalize"]).df())
    assert len(got[1]) == spark.read.parquet(f"{sf}/pages.parquet").count() > 0
    assert got == want


def test_sclc_of_accents(spark, tmp_path):
    pages = [(0, "http://a.b/é", "<p>años à https://é.org/ü 10.0.0.1:80 ñ</p>"), (1, "x", "plain /etc/passwd"), (2, "y", "Ünder C:\\Users\\x\\é.exe")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def brute(t):
        for mark, pattern in X.SCLC:
            t = re.sub(pattern, mark, t, flags=re.ASCII)
        return t

    got = {r.page_id: (r.digest, r.url) for r in QUERIES["sclc_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.md5(brute(h).encode()).hexdigest(), brute(u)) for i, u, h in pages}


@pytest.mark.parametrize("name", ["tfidf_cosine", "pair_features", "baseline_score", "evidence_classes", "idf_shared"])
def test_all_pairs_are_scored(spark, sf, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    want = rows(duck(sf).execute(SQL[name]).df())
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert len(got[1]) == n * (n - 1) // 2 > 0
    assert got == want


def test_every_document_is_sketched(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["minhash_signature"](spark, sf)
    assert got.count() == docs.where(F.lower("text").rlike("[a-z0-9_]")).count() > 0


def test_estimates_round_halves_as_sql(spark, tmp_path):
    """Pairs 141 ids apart have a gap whose half lies between two decimals: 2.72265, as a double a little less."""
    items = [(i, f"word{i} word{i % 7} more") for i in (2, 12, 17, 143, 153, 158)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got, want = rows(QUERIES["pair_estimates"](spark, str(tmp_path)).toPandas()), rows(duck_folder(tmp_path, "benchmark").execute(SQL["pair_estimates"]).df())
    assert any("-2.7226" in str(r) for r in got[1])
    assert got == want


def test_search_gives_every_hit(spark, tmp_path):
    n = S.RESULT_CAP + 50
    hit = F.struct(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("login").alias("event_type"), F.timestamp_micros(F.col("id")).alias("ts"), F.lit(21.5).alias("value"), F.lit('{"k": 7}').alias("props"))
    spark.range(n).select(hit.alias("x")).select("x.*").write.parquet(str(tmp_path / "events.parquet"))
    got, want = rows(QUERIES["search_substring_mask"](spark, str(tmp_path)).toPandas()), rows(duck_folder(tmp_path, "events").execute(SQL["search_substring_mask"]).df())
    assert len(got[1]) == n
    assert got == want
