"""Blocks as rows: outermost ones, processed ones, aligned results, the bilingual table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions.text import layout, result_status


def ancestors(path: Column) -> Column:
    """The paths above a node's path."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k - 1), "/")))


def outermost(candidates: DataFrame) -> DataFrame:
    """Candidates (page_id, node_path) that no other candidate of the page contains: an equi-join on ancestor paths."""
    own = candidates.select("page_id", "node_path").distinct()
    inner = own.select("page_id", "node_path", F.explode(ancestors(F.col("node_path"))).alias("above"))
    contained = inner.join(own.withColumnRenamed("node_path", "above"), ["page_id", "above"]).select("page_id", "node_path")
    return candidates.join(contained, ["page_id", "node_path"], "left_anti")


def unprocessed(candidates: DataFrame, processed: DataFrame) -> DataFrame:
    """Candidates that are not processed themselves and stand under nothing processed."""
    marks = processed.select("page_id", F.col("node_path").alias("at")).distinct()
    places = candidates.select("page_id", "node_path", F.explode(F.concat(ancestors(F.col("node_path")), F.array("node_path"))).alias("at"))
    done = places.join(marks, ["page_id", "at"], "left_semi").select("page_id", "node_path")
    return candidates.join(done, ["page_id", "node_path"], "left_anti")


def apply_results(blocks: DataFrame, translated: str = "translated") -> DataFrame:
    """page_id, block_ord, source, translated, status, layout of blocks with their results."""
    out, error = F.col(translated), F.col("error") if "error" in blocks.columns else None
    place = F.when((layout(F.col("text")) == "break") & F.coalesce("tail_block", F.lit(False)), "after_block").otherwise(layout(F.col("text")))
    return blocks.select("page_id", "block_ord", F.col("text").alias("source"), out.alias("translated"), result_status(F.col("text"), out, error).alias("status"), place.alias("layout"))


def marked(processed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The processed nodes (page_id, node_path) after these blocks have been sent."""
    return processed.select("page_id", "node_path").unionByName(blocks.select("page_id", "node_path")).distinct()


def cleared(processed: DataFrame, roots: DataFrame) -> DataFrame:
    """The processed nodes after everything at and below some roots has been undone; nodes of shadow trees lie below their hosts."""
    return unprocessed(processed, roots)


def appended(queued: DataFrame, added: DataFrame, processed: DataFrame) -> DataFrame:
    """Queued blocks and newly extracted ones: of a node's the first to come (queued, then by block_ord), none that is processed
    or stands under a processed or another queued one."""
    both = queued.withColumn("_late", F.lit(0)).unionByName(added.withColumn("_late", F.lit(1)))
    first = F.min_by(F.struct(*queued.columns), F.struct("_late", "block_ord"))
    rows = both.groupBy(F.col("page_id").alias("_page"), F.col("node_path").alias("_path")).agg(first.alias("b")).select("b.*")
    return outermost(unprocessed(rows, processed))


def reread(batches: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Batches (key, text, ...) as they leave: a node's text is the newest one in state, not that of the time it was queued."""
    newest = state.select(*key, F.col("text").alias("_now"))
    return batches.join(newest, key, "left").withColumn("text", F.when(F.coalesce("_now", F.lit("")) != "", F.col("_now")).otherwise(F.col("text"))).drop("_now")


def recheck(sent: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """What is to be done with sent nodes (key, text) whose newest text in state (key, text, keeps_lines) differs.

    action: segment (the new text has blank lines that count, so the node is extracted anew) or translate.
    """
    now = state.select(*key, F.col("text").alias("new_text"), "keeps_lines")
    changed = sent.join(now, key).where(F.col("text") != F.col("new_text"))
    return changed.withColumn("action", F.when(F.col("keeps_lines") & F.col("new_text").rlike("\\n[^\\S\\n]*\\n"), "segment").otherwise("translate")).drop("keeps_lines")


def moved(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Results (page_id, node_path, target_path, before_path) whose place in the newest blocks is another, with that place as to_target and to_before."""
    now = blocks.select("page_id", "node_path", F.col("target_path").alias("to_target"), F.col("before_path").alias("to_before"))
    return placed.join(now, ["page_id", "node_path"]).where(~F.col("target_path").eqNullSafe(F.col("to_target")))


def visible(blocks: DataFrame, top: Column, bottom: Column, height: Column) -> DataFrame:
    """Blocks that overlap the screen or the one below it."""
    return blocks.where((bottom > 0) & (top < height * 2))


def current_only(responses: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Responses whose source is still the newest text of their node; others are stale."""
    return responses.join(state.select(*key, F.col("text").alias("source")).distinct(), [*key, "source"], "left_semi")
