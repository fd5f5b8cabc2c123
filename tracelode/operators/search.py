"""Search over sealed and live events: literal, trigram and BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import has_tags, tokenize, trigrams
from ..plans.sqlgate import check_filter


def all_events(sealed: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Sealed and live events in one frame; columns that one lacks are filled, tags with 0."""
    if live is not None:
        live = live.withColumn("_source", F.lit("live"))
    rows = sealed.withColumn("_source", F.lit("sealed"))
    rows = rows if live is None else rows.unionByName(live, allowMissingColumns=True)
    return rows.withColumn("flux_tags", F.coalesce("flux_tags", F.lit(0).cast("long")) if "flux_tags" in rows.columns else F.lit(0).cast("long"))


def split_query(query: str) -> list[str]:
    """Parts of a query between punctuation, longest first; an empty list is an invalid query."""
    return sorted({p for p in re.split(r"[^\w]+", query) if p}, key=lambda p: (-len(p), p))


def _checked(query: str, limit: int | None) -> None:
    if not query or not split_query(query) and not query.strip():
        raise ValueError("empty query")
    if limit is not None and not 1 <= limit <= S.RESULT_CAP:
        raise ValueError(f"limit must be 1 to {S.RESULT_CAP}")


def search(events: DataFrame, query: str, where: str | Column | None = None, mask: int | None = None, limit: int | None = 1000, text: str = "raw", order: str = "event_hash") -> DataFrame:
    """Events whose text holds the literal query, a filter and a tag mask; the first by ``order``, or all without a limit.

    The filter and the mask reach the scan; a ``ts`` column of text is compared as a time.
    """
    _checked(query, limit)
    rows = events.where(F.contains(F.col(text), F.lit(query)))
    if mask is not None:
        rows = rows.where(has_tags(F.col("flux_tags"), mask))
    if where is not None:
        given = rows
        if "ts" in rows.columns and dict(rows.dtypes)["ts"] == "string":
            rows = rows.withColumn("__ts_text", F.col("ts")).withColumn("ts", F.to_timestamp("ts"))
        rows = rows.where(F.expr(check_filter(events.sparkSession, where)) if isinstance(where, str) else where)
        if "__ts_text" in rows.columns:
            rows = rows.withColumn("ts", F.col("__ts_text")).select(*given.columns)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def trigram_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Postings ``tri, id``."""
    return docs.select(F.col(id_col).alias("id"), F.explode(trigrams(F.col(text))).alias("tri"))


def grams_of(query: str) -> list[str]:
    """Distinct trigrams of a lower-cased query."""
    return sorted({query[i : i + 3] for i in range(len(query) - 2)})


def trigram_search(docs: DataFrame, postings: DataFrame, query: str, id_col: str, text: str) -> DataFrame:
    """Case-insensitive literal search: ids in all postings of the query's trigrams, then verified.

    A query shorter than a trigram scans. The query's grams are a fixed list, so the filter on the
    postings is pushed down.
    """
    q = query.lower()
    hit = F.contains(F.lower(F.col(text)), F.lit(q))
    if len(q) < 3:
        return docs.where(hit)
    grams = grams_of(q)
    ids = postings.where(F.col("tri").isin(*grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(F.col("id").alias(id_col))
    return docs.join(ids, id_col, "left_semi").where(hit)


def bm25_index(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings ``term, id, tf`` and lengths ``id, len``."""
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text)).alias("tokens"))
    postings = tokens.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return postings, tokens.select("id", F.size("tokens").cast("long").alias("len"))


def bm25(postings: DataFrame, lengths: DataFrame, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` under statistics of the whole collection, best first, ties by id.

    The query's terms filter the postings before anything is joined; corpus totals are one row.
    """
    terms = sorted(set(re.findall(r"[a-z0-9_]+(?:/[a-z0-9_.:-]+)?", query.lower())))
    if not terms:
        raise ValueError("empty query")
    hits = postings.where(F.col("term").isin(*terms))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(totals))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), "id")
    return out if limit is None else out.limit(limit)


def hybrid(sealed_scores: DataFrame, live: DataFrame, query: str, limit: int, text: str = "raw", id_col: str = "event_hash") -> DataFrame:
    """Scores of indexed events, and 0.5 for live ones that hold the literal; one order for both."""
    rows = live.where(F.contains(F.col(text), F.lit(query))).select(F.col(id_col).alias("id"), F.lit(0.5).alias("score"))
    return sealed_scores.select("id", "score").unionByName(rows).orderBy(F.col("score").desc(), "id").limit(limit)
