"""Public suffixes as a table, and hosts split by the longest one they end with."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def icann_rules() -> list[str]:
    """The ICANN section of the public suffix list that a jar of Spark's HTTP client holds."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in [*glob.glob(f"{home}/jars/httpclient*.jar"), *glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/httpclient*.jar")]:
        with zipfile.ZipFile(jar) as z:
            if "mozilla/public-suffix-list.txt" in z.namelist():
                text = z.read("mozilla/public-suffix-list.txt").decode()
                part = text.partition("===BEGIN ICANN DOMAINS===")[2].partition("===END ICANN DOMAINS===")[0]
                return [x.strip() for x in part.splitlines() if x.strip() and not x.startswith("//")]
    return []


def suffix_rules(df: DataFrame) -> DataFrame:
    """suffix, kind (plain, wildcard, exception): a few thousand rows, a list of fixed size."""
    rows = [(r.lstrip("!").removeprefix("*."), "exception" if r[0] == "!" else "wildcard" if r.startswith("*.") else "plain") for r in icann_rules()]
    return df.sparkSession.createDataFrame(rows, "suffix string, kind string")


def split_hosts(hosts: DataFrame, host: str = "host") -> DataFrame:
    """hosts with entity (the label before the suffix), suffix and subdomain; nulls for addresses and single labels.

    Every tail of a host is looked up in the list by one join; the longest rule wins, an exception over all, and the last
    label counts as a suffix of its own where no rule fits.
    """
    distinct = hosts.select(F.col(host).alias("h")).distinct()
    labels = F.split("h", "\\.")
    n = F.size(labels)
    good = distinct.where((n >= 2) & ~F.col("h").rlike("^[0-9.]+\\z|:|\\.\\.|^\\.|\\.\\z"))
    tails = good.select("h", labels.alias("l"), F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("tail", F.array_join(F.slice("l", n - F.col("k") + 1, F.col("k")), "."))
    # the list has a fixed size
    hit = tails.join(F.broadcast(suffix_rules(hosts)), F.col("tail") == F.col("suffix"), "left")
    reach = F.when(F.col("kind") == "plain", F.col("k")).when(F.col("kind") == "wildcard", F.least(F.col("k") + 1, F.size("l"))).when(F.col("kind") == "exception", F.lit(100) + F.col("k") - 1)
    by = hit.groupBy("h", "l").agg(F.max(reach).alias("reach"))
    k = F.coalesce(F.when(F.col("reach") >= 100, F.col("reach") - 100).otherwise(F.col("reach")), F.lit(1))
    cut = by.withColumn("k", k).where(F.col("k") < F.size("l"))
    m = F.size("l") - F.col("k")
    parts = cut.select("h", F.get("l", m - 1).alias("entity"), F.array_join(F.slice("l", m + 1, F.col("k")), ".").alias("suffix"), F.array_join(F.slice("l", F.lit(1), m - 1), ".").alias("subdomain"))
    return hosts.join(parts, hosts[host] == parts["h"], "left").drop("h")


def entity_of(head: Column) -> Column:
    return F.element_at(F.split(head, "\\."), -1)
