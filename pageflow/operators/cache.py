"""The translation cache as a keyed table: target_lang, source, translated, ts. Times are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.config import CACHE_DAYS, CACHE_ENTRIES

KEY = ["target_lang", "source"]


def _age_limit(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def lookup(requests: DataFrame, cache: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """requests (target_lang, source, ...) with translated: null where the cache has none, or one strictly older than ``days``."""
    live = cache.where(F.col("ts") >= _age_limit(as_of, days)).select(*KEY, "translated")
    return requests.join(live, KEY, "left")


def misses(requests: DataFrame, cache: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Distinct requests without a live entry: the work list."""
    live = cache.where(F.col("ts") >= _age_limit(as_of, days)).select(*KEY)
    return requests.select(*KEY).distinct().join(live, KEY, "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each key; of equal times the new one's. Written to a new path, it replaces the cache."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("translated", "ts"), F.struct("ts", "_new", "translated"))
    # an aggregate, not a window: it combines on the map side, and a much-rewritten key is no long partition
    return both.groupBy(*KEY).agg(newest.alias("e")).select(*KEY, "e.translated", "e.ts")


def evict(cache: DataFrame, as_of: Column, days: int = CACHE_DAYS, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Drop what is ``days`` old or older, then the oldest beyond ``entries``.

    A cache is bounded by ``entries``, and so are the sorted rows: each partition gives its newest, and they meet once.
    """
    young = cache.where(F.col("ts") > _age_limit(as_of, days))
    return young.orderBy(F.desc("ts"), F.desc("target_lang"), F.desc("source")).limit(entries)


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def hit_counts(looked_up: DataFrame) -> DataFrame:
    hit = F.col("translated").isNotNull()
    return looked_up.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))

