"""Machines with deadlines: by hand, and streams by event time against the same rows as a table."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageflow.streaming import incremental, stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, kind string, node string, text string, translated string, keeps_lines boolean, seq long, id long, lang string"


def play(machine, rows):
    """Rows (ms, {...}) in order of time, and their output, the ends of waits included."""
    s, out = machine.start(), []
    for ms, r in rows:
        out += machine.until(s, ms * 1000) + machine.row(s, r, ms * 1000)
    return out + machine.until(s, None), s


def test_a_batch_leaves_at_its_first_texts_deadline():
    rows = [(ms, {"seq": ms, "text": "x"}) for ms in range(0, 15_000, 1500)]
    out, _ = play(stateful.Batches(20, 2500), rows)
    assert [(i, b) for i, _, b in out] == [(ms, ms // 3000) for ms, _ in rows]  # two each: the second does not move the deadline


def test_batches_by_size_and_units():
    rows = [(0, {"seq": i, "text": t}) for i, t in enumerate(["a" * 5, "b" * 5, "c", "d" * 20, "😀" * 4, None])]
    out, s = play(stateful.Batches(2, 50, 10), rows)
    assert [b for _, _, b in out] == [0, 0, 1, 2, 3, 3] and s["seqs"] == []


def test_queues_by_direction():
    q = stateful.Queues(50, 300, 200)
    seen, up, down = (lambda i: {"kind": "seen", "id": i}), {"kind": "up", "id": None}, {"kind": "down", "id": None}
    rows = [(0, seen(1)), (40, seen(2)), (60, seen(3)), (100, up), (101, seen(4)), (250, down), (251, seen(5)), (540, up), (830, seen(6)), (1500, down), (1501, seen(7))]
    out, s = play(q, rows)
    # 1, 2: 50 ms after the first; the scroll down within 200 ms of the last one up does not count; each push moves the queue up
    assert out == [(1, "down", 50_000), (2, "down", 50_000), (3, "down", 110_000), (4, "up", 1_130_000), (5, "up", 1_130_000), (6, "up", 1_130_000), (7, "down", 1_551_000)]
    assert play(q, [(0, up), (1, seen(1)), (2, {"kind": "close", "id": None})]) == ([], q.start())


def test_a_late_answer_is_not_placed():
    """A node grows while its first text is asked for: the answer to that text comes last and is dropped."""
    m = stateful.Rechecks(300)
    r = lambda kind, text=None, translated=None, keeps=False: {"node": "li", "kind": kind, "text": text, "translated": translated, "keeps_lines": keeps}
    out, _ = play(m, [(0, r("sent", "part")), (100, r("changed", "part and")), (200, r("changed", "part and rest")), (600, r("answer", "part and rest", "[x] all")), (4000, r("answer", "part", "[x] part"))])
    assert out == [("li", "translate", "part", None, 0), ("li", "translate", "part and rest", None, 500_000), ("li", "place", "part and rest", "[x] all", 600_000)]


def test_growth_before_the_request_counts():
    m = stateful.Rechecks(300)
    r = lambda kind, text: {"node": "li", "kind": kind, "text": text, "translated": None, "keeps_lines": False}
    assert play(m, [(0, r("changed", "whole")), (900, r("sent", "wh"))])[0] == [("li", "translate", "whole", None, 900_000)]
    # changed and back within the wait: nothing to do
    assert len(play(m, [(0, r("sent", "a")), (10, r("changed", "b")), (20, r("changed", "a"))])[0]) == 1


def test_blank_lines_retract_and_gone_nodes_leave_no_state():
    m = stateful.Rechecks(300)
    r = lambda node, kind, text=None, keeps=True: {"node": node, "kind": kind, "text": text, "translated": None, "keeps_lines": keeps}
    out, s = play(m, [(0, r("a", "sent", "x")), (0, r("b", "sent", "y")), (10, r("a", "changed", "x\n \ny")), (10, r("b", "changed", "y\n\nz", False)), (900, r("b", "removed"))])
    assert [(o[0], o[1], o[2]) for o in out] == [("a", "translate", "x"), ("b", "translate", "y"), ("a", "retract", "x"), ("b", "translate", "y\n\nz"), ("b", "retract", "y\n\nz")]
    assert m.idle(s)


def test_tabs_and_first_seen():
    out, s = play(stateful.Tabs(), [(0, {"kind": "stop", "lang": None}), (1, {"kind": "start", "lang": "fr"}), (2, {"kind": "start", "lang": "fr"}), (3, {"kind": "start", "lang": "de"}), (4, {"kind": "close", "lang": None})])
    assert out == [(True, "fr", 1000), (True, "de", 3000), (False, None, 4000)] and s == stateful.Tabs().start()
    out, s = play(stateful.FirstSeen(100), [(0, {"kind": "x", "id": 1}), (99, {"kind": "x", "id": 2}), (100, {"kind": "x", "id": 3}), (120, {"kind": "close", "id": 4}), (121, {"kind": "x", "id": 5})])
    assert out == [(1,), (3,), (5,)] and s == {"at": None}


@pytest.fixture(scope="module")
def history(spark, sf):
    """Rows for every machine, of the users of the events table; some share a time."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 4 = 0")
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 11 == 0, "close").when(k % 11 == 1, "removed").when(k % 3 == 0, "sent").when(k % 3 == 1, "changed").otherwise("answer")
    rows = e.select(
        "user_id", "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.concat(F.lit("/"), (k % 2).cast("string")).alias("node"),
        F.concat(F.lit("t"), (k % 4).cast("string"), F.when(k % 5 == 0, "\n \nx").otherwise("")).alias("text"), F.lit("T").alias("translated"), (u % 8 == 0).alias("keeps_lines"), k.alias("seq"), k.alias("id"), F.when(k % 2 == 0, "fr").otherwise("de").alias("lang"),
    )
    out = rows.unionByName(rows.where("event_id % 9 = 0").withColumns({"user_id": F.lit(None).cast("long")})).toPandas()
    return out


def frame(spark, pdf):
    return spark.createDataFrame([(None if r.user_id is None or r.user_id != r.user_id else int(r.user_id), r.event_id, r.ts.to_pydatetime(), *r[3:]) for r in pdf.itertuples(index=False)], SCHEMA)


HOUR = 3_600_000
CASES = {
    "batches": (stateful.Batches(3, 30 * HOUR, 12), {}),
    "queues": (stateful.Queues(20 * HOUR, 50 * HOUR, 20 * HOUR), {"sent": "up", "changed": "down", "answer": "seen", "removed": "seen"}),
    "rechecks": (stateful.Rechecks(30 * HOUR), {}),
    "tabs": (stateful.Tabs(), {"sent": "start", "changed": "start"}),
    "seen": (stateful.FirstSeen(48 * HOUR), {}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_stream_gives_the_tables_rows(spark, history, tmp_path, name):
    """Files hold stretches of time, their rows shuffled, each file overlapping the next one; a last row moves the watermark."""
    machine, kinds = CASES[name]
    rows = history.assign(kind=history["kind"].map(lambda k: kinds.get(k, k))).sort_values("ts")
    part = (rows["ts"].rank(pct=True) * 3).astype(int).clip(upper=2)
    part = part.where(rows["event_id"] % 6 != 0, (part + 1).clip(upper=2))  # some rows come a file late
    for i in range(3):
        one = rows[part == i].sample(frac=1, random_state=i)
        frame(spark, one).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    end = [(-1, -1, rows["ts"].max().to_pydatetime() + timedelta(days=9000), "close", "/", "", "", False, -1, -1, "fr")]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.on_stream(stream, machine, ["user_id"], delay="1000 days")
    q = out.writeStream.outputMode("append").format("memory").queryName(f"m_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    want = stateful.over_table(frame(spark, rows), machine, ["user_id"])
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    got = key(spark.table(f"m_{name}").where("coalesce(user_id, 0) <> -1"))
    assert len(got) > 20 and got == key(want)


def test_a_table_as_played_by_hand(spark, history):
    machine = CASES["rechecks"][0]
    got = sorted(map(repr, (tuple(r) for r in stateful.over_table(frame(spark, history), machine, ["user_id"]).collect())))
    want = []
    for user, rows in history.assign(user_id=history["user_id"].fillna(-5)).groupby("user_id"):
        played = [(int(r.ts.timestamp() * 1000), r._asdict()) for r in rows.sort_values(["ts", "event_id"]).itertuples(index=False)]
        want += [(None if user == -5 else int(user), *o) for o in play(machine, played)[0]]
    assert got == sorted(map(repr, want))


def test_an_empty_table(spark):
    assert stateful.over_table(spark.createDataFrame([], SCHEMA), stateful.Queues(), ["user_id"]).collect() == []


def test_steady_arrivals_by_the_clock(spark, tmp_path):
    """A text every second, a window of 2.5 seconds: batches leave while texts keep coming, and hold what came in their window."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load().selectExpr("'de' as lang", "value as seq", "cast(value as string) as text")
    q = incremental.stream_batches(stream, 100, 2500).writeStream.outputMode("append").format("memory").queryName("steady").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 90
    while time.time() < end and spark.table("steady").agg(F.max("batch_id")).first()[0] in (None, 0):
        time.sleep(0.5)
    got = spark.table("steady").groupBy("batch_id").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("batch_id").collect()
    q.stop()
    assert len(got) >= 2 and got[0]["a"] == 0
    assert all(r["b"] - r["a"] + 1 == r["n"] for r in got) and all(y["a"] == x["b"] + 1 for x, y in zip(got, got[1:]))
