"""Keyed operators with deadlines: small machines, run by one stateful processor over a stream or in order over a table.

A machine has a state, takes a key's rows in the order of time, and may have a deadline. On a stream by event time, rows wait
in list state until the watermark has passed them, so their order of arrival does not matter; deadlines fire as the watermark
passes them. By processing time, rows count as they come and timers fire by the clock. Over a table, rows of a key are
sorted and streamed through a task. All give the same rows, which tests compare; what a watermark drops is missing.

A deadline fires before a row of the same time. State is dropped as soon as a machine has nothing to remember.
Times are microseconds. Null times are dropped, null keys are a key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from pageflow.session import ship

#: Rows that a task holds before it hands them on.
ROWS = 10_000


def units(text: str | None) -> int:
    return len((text or "").encode("utf-16-le", "surrogatepass")) // 2


class Machine:
    """state and output: DDL of what is kept and of what comes out. Both methods change the state s and give rows of output."""

    state: str
    output: str

    def start(self) -> dict:
        raise NotImplementedError

    def row(self, s: dict, r: dict, t: int) -> list[tuple]:
        raise NotImplementedError

    def due(self, s: dict) -> int | None:
        """When the state wants to be looked at again."""
        return None

    def fire(self, s: dict, t: int) -> list[tuple]:
        return []

    def idle(self, s: dict) -> bool:
        """Nothing to remember."""
        return s == self.start()

    def until(self, s: dict, t: int | None) -> list[tuple]:
        """Fire what is due by t, or all."""
        out = []
        while (d := self.due(s)) is not None and (t is None or d <= t):
            out += self.fire(s, d)
        return out


class Batches(Machine):
    """Requests (seq, text) in batches: one leaves with its size-th text, before a text with which it would have over ``chars``
    UTF-16 units, or window_ms after its first. Later texts do not move the deadline."""

    state = "number int, opened long, units long, seqs array<long>, texts array<string>"
    output = "seq long, text string, batch_id int"

    def __init__(self, size: int, window_ms: int, chars: int | None = None):
        self.size, self.window, self.chars = size, window_ms * 1000, chars

    def start(self):
        return {"number": 0, "opened": None, "units": 0, "seqs": [], "texts": []}

    def _leave(self, s):
        out = [(i, x, s["number"]) for i, x in zip(s["seqs"], s["texts"])]
        s.update(self.start(), number=s["number"] + 1)
        return out

    def row(self, s, r, t):
        n, out = units(r["text"]), []
        if s["seqs"] and self.chars is not None and s["units"] + n > self.chars:
            out = self._leave(s)
        if not s["seqs"]:
            s["opened"] = t
        s.update(units=s["units"] + n, seqs=[*s["seqs"], r["seq"]], texts=[*s["texts"], r["text"]])
        return out + self._leave(s) if len(s["seqs"]) >= self.size else out

    def due(self, s):
        return s["opened"] + self.window if s["seqs"] else None

    def fire(self, s, t):
        return self._leave(s)


class Queues(Machine):
    """Blocks that come in sight (kind seen, id) wait in one of two queues, by the direction of scrolling (kinds up, down).

    The queue down leaves down_ms after its first block. The queue up leaves up_ms after the last block of any queue came in
    sight or the last scroll upwards: each pushes its deadline on. A scroll down counts latch_ms after the last one up. What
    waits when the page is closed (kind close) is gone, and its state with it.
    """

    state = "up boolean, last_up long, down_ids array<long>, down_at long, up_ids array<long>, up_at long"
    output = "id long, queue string, fire_t long"

    def __init__(self, down_ms: int = 50, up_ms: int = 300, latch_ms: int = 200):
        self.down_wait, self.up_wait, self.latch = down_ms * 1000, up_ms * 1000, latch_ms * 1000

    def start(self):
        return {"up": False, "last_up": None, "down_ids": [], "down_at": None, "up_ids": [], "up_at": None}

    def row(self, s, r, t):
        if r["kind"] == "close":
            s.update(self.start())
        elif r["kind"] == "up":
            s.update(up=True, last_up=t)
        elif r["kind"] == "down":
            if s["last_up"] is None or t - s["last_up"] > self.latch:
                s["up"] = False
        elif s["up"]:
            s["up_ids"] = [*s["up_ids"], r["id"]]
        else:
            s.update(down_ids=[*s["down_ids"], r["id"]], down_at=s["down_at"] if s["down_ids"] else t)
        if s["up_ids"] and (s["up"] or r["kind"] == "seen"):
            s["up_at"] = t
        return []

    def _deadlines(self, s):
        return [(s[f"{q}_at"] + wait, q) for q, wait in (("down", self.down_wait), ("up", self.up_wait)) if s[f"{q}_ids"]]

    def due(self, s):
        return min(self._deadlines(s))[0] if s["down_ids"] or s["up_ids"] else None

    def fire(self, s, t):
        q = min(self._deadlines(s))[1]
        out = [(i, q, t) for i in s[f"{q}_ids"]]
        s.update({f"{q}_ids": [], f"{q}_at": None})
        return out


class Rechecks(Machine):
    """The nodes of a page over time. Rows: node, kind, text, translated, keeps_lines.

    sent: the node is asked for, with its newest text (changes before count). changed: its text is another; gap_ms after the
    page's last change, all changed nodes that were sent are looked at, and those whose text differs from what was sent are
    asked for again (``translate``), or, where blank lines count, retracted and cut anew (``retract``). answer: a translation of
    ``text``; it is placed (``place``) only while that is what the node was last asked for with. removed: the node is
    forgotten and what was placed is retracted. A page whose nodes are all gone has no state.
    """

    state = "nodes array<string>, sent array<string>, now array<string>, waits array<boolean>, splits array<boolean>, at long"
    output = "node string, action string, text string, translated string, t long"
    #: Fixed value: a blank line.
    BLANK = r"\n[^\S\n]*\n"

    def __init__(self, gap_ms: int = 300):
        self.gap = gap_ms * 1000

    def start(self):
        return {"nodes": [], "sent": [], "now": [], "waits": [], "splits": [], "at": None}

    def row(self, s, r, t):
        node, kind, out = r["node"], r["kind"], []
        i = s["nodes"].index(node) if node in s["nodes"] else -1
        if kind in ("sent", "changed") and i < 0:
            for c, x in (("nodes", node), ("sent", None), ("now", None), ("waits", False), ("splits", False)):
                s[c] = [*s[c], x]
            i = len(s["nodes"]) - 1
        if kind == "sent":
            s["sent"][i] = s["now"][i] if s["now"][i] is not None else r["text"]
            s["now"][i] = s["sent"][i]
            out = [(node, "translate", s["sent"][i], None, t)]
        elif kind == "changed":
            s["now"][i], s["splits"][i] = r["text"], bool(r["keeps_lines"]) and bool(re.search(self.BLANK, r["text"] or ""))
            if s["sent"][i] is not None:
                s["waits"][i], s["at"] = True, t
        elif kind == "answer" and i >= 0 and s["sent"][i] == r["text"]:
            out = [(node, "place", r["text"], r["translated"], t)]
        elif kind == "removed" and i >= 0:
            if s["sent"][i] is not None:
                out = [(node, "retract", s["sent"][i], None, t)]
            self._forget(s, i)
        return out

    def _forget(self, s, i):
        for c in ("nodes", "sent", "now", "waits", "splits"):
            s[c] = [x for k, x in enumerate(s[c]) if k != i]
        if not any(s["waits"]):
            s["at"] = None

    def due(self, s):
        return s["at"] + self.gap if s["at"] is not None else None

    def fire(self, s, t):
        out, gone = [], []
        for i, node in enumerate(s["nodes"]):
            if s["waits"][i]:
                s["waits"][i] = False
                if s["now"][i] != s["sent"][i]:
                    if s["splits"][i]:
                        out.append((node, "retract", s["sent"][i], None, t))
                        gone.append(i)
                    else:
                        s["sent"][i] = s["now"][i]
                        out.append((node, "translate", s["now"][i], None, t))
        for i in reversed(gone):
            self._forget(s, i)
        s["at"] = None
        return out


class Tabs(Machine):
    """Whether a tab is being translated: rows of kind start (lang), and stop, reload, pdf or close, which end it and its state.

    Out come changes only. A start while it runs changes the language.
    """

    state = "lang string, since long"
    output = "active boolean, lang string, since long"

    def start(self):
        return {"lang": None, "since": None}

    def row(self, s, r, t):
        if r["kind"] == "start":
            if s["lang"] == r["lang"]:
                return []
            s.update(lang=r["lang"], since=t)
        elif s["lang"] is None:
            return []
        else:
            s.update(self.start())
        return [(s["lang"] is not None, s["lang"], t)]


class FirstSeen(Machine):
    """Rows (id, kind) that are the first of their key, or the first since it was forgotten: keep_ms after that first row, or by a row of kind close."""

    state = "at long"
    output = "id long"

    def __init__(self, keep_ms: int):
        self.keep = keep_ms * 1000

    def start(self):
        return {"at": None}

    def row(self, s, r, t):
        if r["kind"] == "close":
            s["at"] = None
        elif s["at"] is None:
            s["at"] = t
            return [(r["id"],)]
        return []

    def due(self, s):
        return s["at"] + self.keep if s["at"] is not None else None

    def fire(self, s, t):
        s["at"] = None
        return []


def _fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _plain(x):
    """Arrays of state and of pandas as lists."""
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray" else None if x is pd.NaT or isinstance(x, float) and x != x else x.item() if hasattr(x, "item") else x


def _records(pdf: pd.DataFrame) -> list[dict]:
    return [{c: _plain(v) for c, v in zip(pdf.columns, r)} for r in pdf.itertuples(index=False, name=None)]


def _frame(rows: Iterable[tuple], schema: T.StructType) -> pd.DataFrame:
    rows = list(rows)
    kinds = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.BooleanType(): "boolean"}
    return pd.DataFrame({f.name: pd.array([r[i] for r in rows], dtype=kinds[f.dataType]) if f.dataType in kinds else pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema.fields)})


class _Processor(StatefulProcessor):
    """A machine on a stream. Rows have t and order beside the machine's own columns."""

    def __init__(self, machine: Machine, columns: T.StructType, out: T.StructType, by_event: bool):
        # parsed here: a worker has no session to parse with
        self.machine, self.columns, self.schema, self.by_event = machine, columns, out, by_event
        self.state = _fields(machine.state)

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)
        self.waiting = handle.getListState("waiting", self.columns)
        self.names = [f.name for f in self.state.fields]

    def _load(self) -> dict:
        if not self.kept.exists():
            return self.machine.start()
        return dict(zip(self.names, map(_plain, self.kept.get())))

    def _save(self, s: dict, before: int | None) -> None:
        if self.machine.idle(s):
            self.kept.clear()
        else:
            self.kept.update(tuple(s[n] for n in self.names))
        due = self.machine.due(s)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            if due is not None:
                self.handle.registerTimer(-(-due // 1000))

    def _run(self, key: tuple, rows: list[dict], now: int) -> Iterator[pd.DataFrame]:
        s = self._load()
        before, out = self.machine.due(s), []
        for r in sorted(rows, key=lambda r: (r["t"], r["ord"])):
            out += self.machine.until(s, r["t"]) + self.machine.row(s, r, r["t"])
        out += self.machine.until(s, now)
        self._save(s, before)
        yield _frame(((*key, *o) for o in out), self.schema)

    def handleInputRows(self, key, rows, timerValues):
        new = [r for pdf in rows for r in _records(pdf)]
        if not self.by_event:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._run(key, [{**r, "t": now} for r in new], now)
            return
        names = [f.name for f in self.columns.fields]
        self.waiting.appendList([tuple(r[n] for n in names) for r in new])
        self.handle.registerTimer(-(-min(r["t"] for r in new) // 1000))
        yield _frame([], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.by_event:
            yield from self._run(key, [], timerValues.getCurrentProcessingTimeInMs() * 1000)
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        names = [f.name for f in self.columns.fields]
        held = [dict(zip(names, map(_plain, r))) for r in self.waiting.get()] if self.waiting.exists() else []
        later = [r for r in held if r["t"] > now]
        if len(later) < len(held):
            if later:
                self.waiting.put([tuple(r[n] for n in names) for r in later])
                self.handle.registerTimer(-(-min(r["t"] for r in later) // 1000))
            else:
                self.waiting.clear()
        yield from self._run(key, [r for r in held if r["t"] <= now], now)

    def close(self):
        pass


def _prepared(rows: DataFrame, ts: str | None, order: str) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")
    return rows.withColumns({"t": at, "ord": F.col(order).cast("long")}).where("t is not null")


def _schema(rows: DataFrame, key: list[str], machine: Machine) -> T.StructType:
    return T.StructType([*(rows.schema[k] for k in key), *_fields(machine.output).fields])


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the state store that keeps list state and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def on_stream(rows: DataFrame, machine: Machine, key: list[str], ts: str | None = "ts", order: str = "event_id", delay: str = "0 seconds") -> DataFrame:
    """The machine's rows over a stream, behind their key: by event time with a watermark ``delay`` behind, or, without ts, by the clock.

    t and ord are the names of the rows' time and its order in here.
    """
    ship(rows.sparkSession)
    use_state_store(rows.sparkSession)
    prepared = _prepared(rows.withWatermark(ts, delay) if ts else rows, ts, order)
    columns = T.StructType([f for f in prepared.schema.fields if f.name not in (*key, ts)])
    out = _schema(rows, key, machine)
    return prepared.groupBy(*key).transformWithStateInPandas(_Processor(machine, columns, out, ts is not None), out, "append", "eventtime" if ts else "processingtime")


def over_table(rows: DataFrame, machine: Machine, key: list[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The machine's rows over a table: what a stream that has ended would have given. A key is sorted and streamed, not held."""
    ship(rows.sparkSession)
    out = _schema(rows, key, machine)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, s, found = None, None, []
        for pdf in parts:
            keys = list(zip(*(pdf[k].astype(object).where(pdf[k].notna(), None).tolist() for k in key)))
            for k, r in zip(keys, _records(pdf.drop(columns=[*key, ts]))):
                if s is None or k != last:
                    found += [(*last, *o) for o in machine.until(s, None)] if s is not None else []
                    last, s = k, machine.start()
                found += [(*k, *o) for o in machine.until(s, r["t"]) + machine.row(s, r, r["t"])]
                if len(found) >= ROWS:
                    yield _frame(found, out)
                    found = []
        found += [(*last, *o) for o in machine.until(s, None)] if s is not None else []
        yield _frame(found, out)

    return _prepared(rows, ts, order).repartition(*key).sortWithinPartitions(*key, "t", "ord").mapInPandas(run, out)


def micros(t: str) -> Column:
    """A time of a machine as a timestamp."""
    return F.timestamp_micros(F.col(t)).cast("timestamp_ntz")
