"""What the caches of a service mean as work on a query log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip

QUERY_TTL_SECONDS = 1800
RERANK_TTL_SECONDS = 10800


def _json_text(col: Column) -> Column:
    """A value as JSON with no ASCII escaping."""
    return F.regexp_extract(F.to_json(F.struct(col.alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)


def query_key(query: Column, kb_id: Column, config_id: Column) -> Column:
    """md5 over canonical JSON (sorted keys) of the lower-cased, trimmed query, the base and the configuration."""
    body = F.concat(
        F.lit('{"config_id": '),
        _json_text(config_id.cast("string")),
        F.lit(', "knowledge_base_id": '),
        _json_text(kb_id.cast("string")),
        F.lit(', "query": '),
        _json_text(strip(F.lower(query))),
        F.lit("}"),
    )
    return F.md5(body.cast("binary"))


def rerank_key(query: Column, chunk_ids: Column, model: str) -> Column:
    """md5 over canonical JSON of the query, the sorted chunk ids and the model."""
    ids = F.array_sort(chunk_ids.cast("array<string>"))
    listed = F.array_join(F.transform(ids, _json_text), ", ")
    body = F.concat(
        F.lit('{"chunk_ids": ['),
        listed,
        F.lit(f'], "model": "{model}", "query": '),
        _json_text(strip(F.lower(query))),
        F.lit("}"),
    )
    return F.md5(body.cast("binary"))


def hit_stats(log: DataFrame, keys: list[str] | None = None, hit: str = "hit") -> DataFrame:
    """Hits, misses and hit rate in percent (2 places, 0 for an empty log)."""
    is_hit = F.coalesce(F.col(hit), F.lit(False))
    counted = log.groupBy(*(keys or [])).agg(
        F.count_if(is_hit).alias("hit_count"), F.count_if(~is_hit).alias("miss_count")
    )
    total = F.col("hit_count") + F.col("miss_count")
    rate = F.when(total > 0, F.round(F.col("hit_count") / total * 100, 2)).otherwise(0.0)
    return counted.withColumn("hit_rate", rate)


def log_summary(query_log: DataFrame, rerank_log: DataFrame) -> DataFrame:
    """One row over both logs: requests, hit rates, distinct entries and saved calls."""
    both = query_log.select(F.lit("query").alias("log"), "key", "hit").unionByName(
        rerank_log.select(F.lit("rerank").alias("log"), "key", "hit")
    )
    per_key = both.groupBy("log", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).alias("hits"))
    is_query = F.col("log") == "query"

    def total(cond, col):
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))

    sums = per_key.agg(
        total(is_query, "n").alias("total_query_requests"),
        total(~is_query, "n").alias("total_rerank_requests"),
        total(is_query, "hits").alias("query_saves"),
        total(~is_query, "hits").alias("rerank_saves"),
        F.count(F.lit(1)).alias("total_entries"),
    )

    def rate(hits, n):
        return F.when(F.col(n) > 0, F.round(F.col(hits) / F.col(n) * 100, 2)).otherwise(0.0)

    return sums.withColumn("query_hit_rate", rate("query_saves", "total_query_requests")).withColumn(
        "rerank_hit_rate", rate("rerank_saves", "total_rerank_requests")
    )


def retrieve_once(requests: DataFrame, run: Callable[[DataFrame], DataFrame], key: Column) -> DataFrame:
    """Run ``run`` on one request per key and give its rows to every request with that key.

    ``run`` takes requests (query_id, ...) and returns rows with query_id.
    """
    keyed = requests.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min("query_id").alias("_first"))
    lead = requests.join(first.select(F.col("_first").alias("query_id")), "query_id", "left_semi")
    found = run(lead).withColumnRenamed("query_id", "_first")
    return keyed.select("query_id", "_key").join(first, "_key").join(found, "_first").drop("_key", "_first")
