"""A table of fetched responses: looked up by URL, fresh for a limited time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, url string, body string, fetched_at timestamp"


def key_of(url: Column) -> Column:
    return F.sha2(url, 256)


def fresh(cache: DataFrame, urls: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Cached bodies of (url) rows that are not older than the limit; a limit of 0 reads none.
    The URL itself is compared as well, so equal keys of different URLs do no harm. Of several
    answers to a URL the latest counts."""
    young = cache.where(F.lit(ttl_seconds > 0) & (F.col("fetched_at") >= now - F.make_interval(secs=F.lit(ttl_seconds))))
    last = young.groupBy("key", "url").agg(F.max_by("body", "fetched_at").alias("body"), F.max("fetched_at").alias("fetched_at"))
    return urls.withColumn("key", key_of(F.col("url"))).join(last, ["key", "url"])


def misses(cache: DataFrame, urls: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """URLs that have to be fetched; their number is the cache's miss counter."""
    return urls.select("url").distinct().join(fresh(cache, urls.select("url").distinct(), now, ttl_seconds).select("url"), "url", "left_anti")


def stored(rows: DataFrame, now: Column) -> DataFrame:
    """Rows (url, body) as the cache keeps them."""
    return rows.select(key_of(F.col("url")).alias("key"), "url", "body", now.alias("fetched_at"))


def write(rows: DataFrame, now: Column, path: str) -> None:
    """Add rows (url, body) to the cache; files appear together when the job commits."""
    stored(rows, now).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
