"""The incremental half as Structured Streaming: newest text per node, debounced rechecks, batch windows, tab states.

State is keyed, so it is partitioned; every form has a batch twin that gives the same final rows, which tests compare.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pageflow.config import RULE_HOURS
from pageflow.functions.text import is_pdf_url, utf16_length, utrim
from pageflow.operators.batching import fold_in_order
from pageflow.operators.extract import RESULT_CLASS
from pageflow.streaming.stateful import Batches, on_stream


def newest_text(mutations: DataFrame, key: list[str]) -> DataFrame:
    """The newest version of each node, whatever the order of arrival: an aggregation in update mode (batch: the same)."""
    return mutations.groupBy(*key).agg(F.max("version").alias("version"), F.max_by("text", F.struct("version", "text")).alias("text"))


def debounced(events: DataFrame, key: list[str], gap: str, delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """One firing for each burst of events: a burst ends when nothing came for ``gap``. Bursts as session windows."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.session_window(F.col(ts), gap)
    return rows.groupBy(*key, w.alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("fire_ts"), "n")


def first_anchored(events: DataFrame, key: list[str], window_ms: int, size: int | None = None, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with batch_id: a batch opens with its first event and closes window_ms later, or with its size-th event.

    The windows are unaligned and not extended. Batch form: one ordered fold for each key.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("batch_id", T.IntegerType())])

    def fold(state, pdf: pd.DataFrame):
        batch, opened, held = state or (-1, None, 0)
        times, ids = pdf[ts], []
        for t in (times if times.dtype.kind != "M" else times.astype("datetime64[us]")).astype("int64").tolist():
            if opened is None or t - opened >= window_ms * 1000 or size is not None and held >= size:
                batch, opened, held = batch + 1, t, 0
            ids.append(batch)
            held += 1
        return (batch, opened, held), pdf.assign(batch_id=np.array(ids, np.int32))

    return fold_in_order(events, key, [ts, order], schema, fold)


def stream_batches(requests: DataFrame, size: int, window_ms: int, chars: int | None = None) -> DataFrame:
    """Streaming batches of requests (lang, seq, text), by the clock: lang, seq, text, batch_id.

    A batch leaves when it has ``size`` texts, before a text with which it would have over ``chars`` UTF-16 units, or window_ms
    after its first text, however many come until then.
    """
    return on_stream(requests.select("lang", "seq", "text"), Batches(size, window_ms, chars), ["lang"], None, "seq")


def tab_states(events: DataFrame, starts: list[str], stops: list[str]) -> DataFrame:
    """user_id, active, since, n: the state of each tab after its last event that starts or stops it.

    A reload, a PDF and the tab's end stop it like the user does: give their event types as stops.
    """
    e = events.where(F.col("event_type").isin([*starts, *stops]))
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("n")).select("user_id", F.col("l.event_type").isin(starts).alias("active"), F.col("l.ts").alias("since"), "n")


def navigation_stops(navigations: DataFrame) -> DataFrame:
    """Navigations (user_id, event_id, ts, url, kind) as events of tabs: ``reload`` and ``pdf`` stop a tab, ``open`` leaves it as it is."""
    kind = F.when(F.col("kind") == "close", "close").when(F.col("kind") == "reload", "reload").when(is_pdf_url(F.col("url")), "pdf").otherwise("open")
    return navigations.select("user_id", "event_id", "ts", kind.alias("event_type"))


def delayed(events: DataFrame, ms: int, ts: str = "ts") -> DataFrame:
    """events with fire_ts: each takes effect ms later."""
    return events.withColumn("fire_ts", F.col(ts) + F.make_dt_interval(secs=F.lit(ms / 1000)))


def mutations(records: DataFrame, result_class: str = RESULT_CLASS) -> tuple[DataFrame, DataFrame]:
    """Mutation records (page_id, node_path, kind, under, classes, ...) as nodes to check again and added nodes to extract.

    ``under`` is the path of the processed node that the record's target stands in, or null. Records of results are no
    mutations of the page.
    """
    own = F.array_contains(F.split(F.coalesce("classes", F.lit("")), "\\s+"), result_class)
    rows = records.where(~own)
    again = rows.where("under is not null").select("page_id", F.col("under").alias("node_path")).distinct()
    return again, rows.where("kind = 'added' and under is null")


def refresh_due(last: Column, now: Column, hours: int = RULE_HOURS) -> Column:
    """Whether rules that were read at ``last`` (null: never) are to be read again."""
    return F.coalesce(now - F.make_dt_interval(hours=F.lit(hours)) >= last, F.lit(True))


def scroll_direction(events: DataFrame, key: str, up: str, down: str, latch_ms: int = 200) -> DataFrame:
    """Down events that count: later than latch_ms after the last up event of the key. Up events always do."""
    by = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_up = F.max(F.when(F.col("event_type") == up, F.col("ts"))).over(by)
    rows = events.where(F.col("event_type").isin(up, down)).withColumn("last_up", last_up)
    return rows.withColumn("direction", F.when(F.col("event_type") == up, "up").when(F.col("last_up").isNull() | (F.col("ts") > F.col("last_up") + F.make_dt_interval(secs=F.lit(latch_ms / 1000))), "down").otherwise("up"))


def late_content(added: DataFrame) -> DataFrame:
    """Added nodes without a block that call for another scan: more than 20 characters of text, no loader, script or style."""
    return added.where((F.col("n_blocks") == 0) & (utf16_length(utrim(F.col("text"))) > 20) & ~F.col("tag").isin("script", "style", "link", "noscript") & ~F.coalesce(F.col("is_loader"), F.lit(False)))


def first_seen(events: DataFrame, key: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Events whose key was not seen before: by state on arrival, which a stream keeps ``within`` a watermark.

    So a stream may give a key again after that time, and the table form does not; FirstSeen forgets alike in both.
    """
    if events.isStreaming:
        return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
