"""Matching of site rules with hosts and paths: an equi-join on the site's name, the rest as residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.session import materialise, ship
from pageflow.functions.html import valid_selector
from pageflow.sources.rules import is_regex, path_expression
from pageflow.sources.suffixes import entity_of, split_hosts


#: Rules up to this many are broadcast; a longer list is joined by Spark's own choice.
BROADCAST_RULES = 50_000


def parse_patterns(rules: DataFrame) -> DataFrame:
    """rules with p_entity, p_subdomain (`*`: any), p_suffix (null: any), valid_path and valid_selector. Patterns without a site go.

    Rules whose selector cannot be compiled are marked here (``where("not valid_selector")`` tells them); they match no element.
    """
    ship(rules.sparkSession)
    d = F.col("domain")
    any_sub, any_suffix = d.startswith("*."), d.endswith(".*")
    rest = F.when(any_sub, F.substring(d, F.lit(3), F.length(d))).otherwise(d)
    head = F.when(any_suffix, F.substring(rest, F.lit(1), F.length(rest) - 2))
    split = split_hosts(rules.withColumn("_rest", F.when(~any_suffix, rest)).withColumn("_head", head), "_rest")
    entity = F.when(F.col("_head").isNotNull(), entity_of(F.col("_head"))).otherwise(F.col("entity"))
    before = F.regexp_extract("_head", "^(.*)\\.[^.]*\\z", 1)
    subdomain = F.when(any_sub, "*").when(F.col("_head").isNotNull(), before).otherwise(F.col("subdomain"))
    out = split.select(*rules.columns, entity.alias("p_entity"), subdomain.alias("p_subdomain"), F.when(~any_suffix, F.col("suffix")).alias("p_suffix"), path_expression(F.col("path_pattern")).alias("path_regex"), F.udf(valid_selector, "boolean")(F.col("selector")).alias("valid_selector"))
    valid_path = ~F.coalesce(is_regex(F.col("path_pattern")), F.lit(False)) | F.col("path_regex").isNotNull()
    return out.withColumn("valid_path", valid_path).where(F.coalesce(F.col("p_entity") != "", F.lit(False)))


def subdomain_matches(pattern: Column, subdomain: Column) -> Column:
    return F.when(pattern == "*", True).when(pattern == "", subdomain == "").otherwise((subdomain == pattern) | subdomain.endswith(F.concat(F.lit("."), pattern)))


def path_matches(pattern: Column, regex: Column, path: Column) -> Column:
    """No pattern always; in slashes a regular expression (regex, null: a broken one, never); else a substring."""
    return F.when(pattern.isNull(), True).when(is_regex(pattern), F.coalesce(F.rlike(path, regex), F.lit(False))).otherwise(F.contains(path, pattern))


def loaded(rules: DataFrame) -> DataFrame:
    """Parsed rules as a written table: they are configuration, parsed once, and their number is known then."""
    table = materialise(parse_patterns(rules), "rules")
    return F.broadcast(table) if table.count() <= BROADCAST_RULES else table


def match_hosts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, ...) joined with the rules of their site, by its name; the other conditions are residual."""
    rules = loaded(rules)
    hosts = split_hosts(pages, "host").where("entity is not null")
    on = (hosts["entity"] == rules["p_entity"]) & (rules["p_suffix"].isNull() | (rules["p_suffix"] == hosts["suffix"])) & subdomain_matches(rules["p_subdomain"], hosts["subdomain"])
    return hosts.join(rules, on).select(*pages.columns, "rule_id", "type", "path_pattern", "selector", "path_regex")


def match_paths(matched: DataFrame) -> DataFrame:
    """Rows of match_hosts whose rule holds for the page's path."""
    return matched.where(path_matches(F.col("path_pattern"), F.col("path_regex"), F.col("path")))


def selectors(matched: DataFrame, key: list[str]) -> DataFrame:
    """key, skip and include: the selectors of a page in the rules' order."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("rule_id", "selector")))), lambda x: x["selector"])
    return matched.groupBy(*key).agg(of("exclude").alias("skip"), of("include").alias("include"))


def place_selectors(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, skip, include of the places (host, path) that rules hold for. Each is matched once, however many pages share it."""
    return selectors(match_paths(match_hosts(places.select("host", "path").distinct(), rules)), ["host", "path"])


def page_selectors(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, skip, include of every row of pages."""
    found = place_selectors(pages, rules)
    return pages.join(found, ["host", "path"], "left").select("page_id", F.coalesce("skip", F.array().cast("array<string>")).alias("skip"), F.coalesce("include", F.array().cast("array<string>")).alias("include"))
