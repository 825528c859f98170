import datetime
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageflow.functions import text as T
from pageflow.operators import batching, blocks, cache
from pageflow.operators import rules as rule_ops
from pageflow.plans import bilingual
from pageflow.sources import rules, settings, suffixes
from pageflow.streaming import incremental


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s,out", [("&lt;a&gt;&amp;amp;", "<a>&amp;"), ("&#8364;&#x1F600;", "€😀"), ("&constructor;&nope;", "&constructor;&nope;"), ("&#1114112;&#99999999999;", "&#1114112;&#99999999999;"), ("no entity", "no entity"), ("&apos;&nbsp;&quot;", "'\xa0\""), ("&#0065;x", "Ax")])
def test_entities(spark, s, out):
    assert one(spark, T.decode_entities(F.col("s")), s=s) == out


@pytest.mark.parametrize("pattern,path,holds", [
    ("/(?<x>a)/", "/a", True), ("/(?P<x>a)/", "/a", False), ("/(?<$y_1>a)\\k<$y_1>/", "/aa", True), ("/[/", "/[", False), ("/[[]x/", "/[x", True),
    ("/[a&&b]/", "/&", True), ("/[^]/", "/", True), ("/[]/", "/", False), ("/a++/", "/aa", False), ("/(?>a)/", "/a", False), ("/(?i)A/", "/a", False),
    ("/\\A/", "/A", True), ("/\\Qa/", "/Qa", True), ("/x{/", "/x{", True), ("/x{2}y/", "/xxy", True), ("/a{1}{2}/", "/aa", False), ("/(?<!b)a/", "/a", True), ("/\\/fr\\//", "/fr/", True),
    ("/", "/a/", True), ("//", "/a", True), ("/*/", "/*", False), ("a.c", "/a.c", True), ("a.c", "/abc", False), (None, "/", True), ("/a|/", "/zzz", True), ("/[\\d-z]/", "/-", True), ("/a\\/", "/a", False),
])
def test_path_patterns_are_those_of_browsers(spark, pattern, path, holds):
    rows = spark.createDataFrame([(pattern, path)], "path_pattern string, path string").withColumn("path_regex", rules.path_expression(F.col("path_pattern")))
    assert rows.select(rule_ops.path_matches(F.col("path_pattern"), F.col("path_regex"), F.col("path")).alias("x")).first()["x"] is holds


def test_a_broken_path_fails_no_job(spark):
    text = "example.com##:matches-path(/(?P<x>a)/) .ad\nexample.com##:matches-path(/(?<x>a)/) .note\nexample.com##:matches-path(/[/) p"
    pages = spark.createDataFrame([(1, "example.com", "/a")], "page_id long, host string, path string")
    found = rule_ops.page_selectors(pages, rules.parse_rules(rules.rule_lines(spark, text))).first()
    assert found["skip"] == [".note"]


def test_units_and_trim(spark):
    assert one(spark, T.utf16_length(F.col("s")), s="a😀") == 3
    assert one(spark, T.utrim(F.col("s")), s="\xa0\t x ﻿　") == "x"


@pytest.mark.parametrize("texts,reply,out", [
    (["a b c", "d e f"], '<t id="1">two</t>\n<t id="0">one</t>', ["one", "two"]),
    (["a b c", "d e f"], '<t id="0">one</t><t id="0">last</t><t id="7">x</t>', ["last", "d e f"]),
    (["a b c", "d e f"], '<t id="0">one</t>\n<t id="1">cut off', ["one", "cut off"]),
    (["short"], "a very long explanation of the text", ["short"]),
    (["short"], " kurz ", ["kurz"]),
])
def test_tag_decode(spark, texts, reply, out):
    assert one(spark, T.tag_decode(F.col("t"), F.col("r")), t=texts, r=reply) == out


def test_prompt_and_urls(spark):
    assert one(spark, T.fill_prompt(F.col("s"), F.lit("$&")), s="a {{targetLang}} b {{targetLang}}") == "a $& b {{targetLang}}"
    assert one(spark, T.fill_prompt(F.col("s"), F.lit("de")), s="none") == "none"
    assert one(spark, T.url_host(F.col("s")), s="HTTPS://A.Example.com/x") == "a.example.com"
    assert one(spark, T.url_host(F.col("s")), s="not a url") == ""
    assert one(spark, T.is_pdf_url(F.col("s")), s="https://a.b/c.PDF?x=1")
    assert one(spark, T.migrate_endpoint(F.col("s")), s="https://a/v1/chat/completions/") == "https://a/v1"


RULES = """! comment
google.*##.a
mail.google.*#+#.b
*.wikipedia.org##:matches-path(/^\\/wiki\\/(a|b)/) .c
x.co.uk###id
sample.test##:matches-path(/foo).d
sample.test##:matches-path(/[/)x
*.ex.*##.e
bad.test##:matches-path(/open.f"""


@pytest.mark.parametrize("host,path,skip,include", [
    ("google.com.hk", "/", [".a"], []),
    ("www.google.com", "/", [], []),
    ("inbox.mail.google.com", "/", [], [".b"]),
    ("wikipedia.org", "/wiki/a", [".c"], []),
    ("de.wikipedia.org", "/other", [], []),
    ("x.co.uk", "/", ["#id"], []),
    ("sample.test", "/a/foo", [".d"], []),
    ("sample.test", "/[/", [], []),
    ("a.b.ex.de", "/", [".e"], []),
    ("1.2.3.4", "/", [], []),
    ("bad.test", "/", [":matches-path(/open.f"], []),
])
def test_rules(spark, host, path, skip, include):
    pages = spark.createDataFrame([(1, host, path)], "page_id long, host string, path string")
    r = rule_ops.page_selectors(pages, rules.parse_rules(rules.rule_lines(spark, RULES))).first()
    assert (r["skip"], r["include"]) == (skip, include)


def test_rule_sources(spark, tmp_path):
    kept = rules.parse_rules(rules.rule_lines(spark, RULES))
    assert rules.effective_rules(None, kept) is kept
    assert rules.effective_rules(kept.limit(0), kept) is kept
    (tmp_path / "r.txt").write_text("a.com##.x\n")
    assert rules.refresh_rules(spark, str(tmp_path / "r.txt"), kept).count() == 1
    assert rules.refresh_rules(spark, str(tmp_path / "none.txt"), kept) is kept
    (tmp_path / "e.txt").write_text("! nothing\n")
    assert rules.refresh_rules(spark, str(tmp_path / "e.txt"), kept) is kept
    assert rules.refresh_rules(spark, str(tmp_path / "r.txt"), kept, due=False) is kept
    assert rules.refresh_rules(spark, str(tmp_path / "r.txt"), kept, due=False, forced=True).count() == 1
    with pytest.raises(ValueError):
        rules.refresh_rules(spark, str(tmp_path / "e.txt"), kept, forced=True)


def test_suffix_list():
    assert len(suffixes.icann_rules()) > 1000


def test_cache_boundaries(spark):
    now = datetime.datetime(2024, 6, 1)
    day = datetime.timedelta(days=1)
    c = spark.createDataFrame([("de", "a", "A", now - 30 * day), ("de", "b", "B", now - 30 * day - datetime.timedelta(seconds=1)), ("de", "c", "C", now)], "target_lang string, source string, translated string, ts timestamp")
    at = F.lit(now)
    asked = spark.createDataFrame([("de", x) for x in "abcd"], "target_lang string, source string")
    assert {r["source"]: r["translated"] for r in cache.lookup(asked, c, at).collect()} == {"a": "A", "b": None, "c": "C", "d": None}
    assert {r["source"] for r in cache.misses(asked, c, at).collect()} == {"b", "d"}
    assert {r["source"] for r in cache.evict(c, at).collect()} == {"c"}  # exactly 30 days: readable, but evicted
    new = spark.createDataFrame([("de", "c", "C2", now)], c.schema)
    assert {r["source"]: r["translated"] for r in cache.upsert(c, new).collect()}["c"] == "C2"
    assert cache.clear(c).count() == 0


def test_greedy_batches(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 1, 20, 3, 3, 3, 3])], "k int, i int, n int")
    got = batching.greedy_batches(rows, ["k"], ["i"], 3, 10, F.col("n")).orderBy("i").collect()
    assert [r["batch_id"] for r in got] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_long_parts(spark):
    text = "One two. " * 300 + "x" * 2500 + "😀" * 10
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "id int, text string")
    got = batching.long_parts(rows, "text").orderBy("id", "part").collect()
    assert "".join(r["part_text"] for r in got if r["id"] == 1) == text
    assert all(len(r["part_text"].encode("utf-16-le")) // 2 <= 950 for r in got)
    assert [r["part_text"] for r in got if r["id"] == 4] == ["short"]


def test_outermost(spark):
    rows = spark.createDataFrame([(1, "/0"), (1, "/0/1"), (1, "/01"), (2, "/0/1"), (1, "/2/3"), (1, "/2/3/4/5")], "page_id int, node_path string")
    assert {tuple(r) for r in blocks.outermost(rows).select("page_id", "node_path").collect()} == {(1, "/0"), (1, "/01"), (2, "/0/1"), (1, "/2/3")}


def test_settings(spark):
    rows = spark.createDataFrame([('{"provider":"openai","openai":{"endpoint":"https://x/v1/chat/completions","model":"m"}}',), (None,)], "document string")
    a, b = settings.read_settings(rows, F.lit("fr-CH")).collect()
    assert (a["provider"], a["openai_baseUrl"], a["openai_model"], a["openai_apiKey"]) == ("openai", "https://x/v1", "m", None)
    assert (b["provider"], b["targetLang"], b["openai_model"]) == ("google", "fr", "gpt-4o-mini")
    m = spark.range(1).select(settings.patch_settings(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()["m"]
    assert m == {"a": "1", "b": "3"}


def test_translator_errors(spark):
    def bad(texts, lang):
        if "boom" in texts:
            return [None] * len(texts)
        return [t.upper() for t in texts] + ["extra"]

    rows = spark.createDataFrame([("a",), ("b",), ("a",), ("boom",)], "source string").coalesce(1)
    got = {r["source"]: (r["translated"], r["error"] is not None) for r in bilingual.translate_texts(rows, bad, "de", batch=1).collect()}
    assert got == {"a": ("A", False), "b": ("B", False), "boom": (None, True)}


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_pages_with_repeated_and_missing_ids(spark):
    """Rules are joined by host and path: a page's row is extracted once, whatever its id."""
    html = "<p>a plain paragraph</p><div class=ad>an ad to skip</div>"
    rows = [(1, "http://x.test/a", html), (1, "http://x.test/b", html), (None, "http://x.test/a", html), (1, "http://other.test/", html)]
    rule = rules.parse_rules(rules.rule_lines(spark, "x.test##.ad\nx.test##p:hover"))
    got = sorted((r["page_id"] or 0, r["source"]) for r in bilingual.bilingual(_pages(spark, rows), "fr", rule).collect())
    assert got == [(0, "a plain paragraph")] + [(1, "a plain paragraph")] * 3 + [(1, "an ad to skip")]
    parsed = rule_ops.parse_patterns(rule)
    assert [r["selector"] for r in parsed.where("not valid_selector").collect()] == ["p:hover"]


def test_errors_language_and_cache(spark):
    def picky(texts, lang):
        if any("bad" in t for t in texts):
            raise RuntimeError("503 " + "x" * 300)
        return [t.upper() if "same" not in t else t for t in texts]

    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "target_lang string, source string, translated string, ts timestamp")
    pages = _pages(spark, [(1, "http://x.test/", "<p>good text<p>bad text<p>same text<p>texte en français"), (2, "http://x.test/", "<p>good text")])
    in_french = lambda rows: rows.withColumn("detected", F.when(F.col("text").contains("français"), "fr").otherwise(""))
    one_by_one = lambda texts, lang: [picky([t], lang)[0] for t in texts]
    table, after = bilingual.bilingual_and_cache(pages, "fr", empty, now, translator=one_by_one, detector=in_french)
    rows = {(r["page_id"], r["source"]): (r["translated"], r["status"]) for r in table.collect()}
    # a failed batch fails all that wait for it
    assert set(rows) == {(1, "good text"), (1, "bad text"), (1, "same text"), (2, "good text")}
    assert rows[1, "bad text"] == (None, "error")
    again = {r["source"]: (r["translated"], r["status"]) for r in bilingual.retry_errors(table, bilingual.echo_translator, "fr").collect()}
    assert again["bad text"] == ("[fr] bad text", "done") and "error" not in {s for _, s in again.values()}
    done = {s for (_, s), (_, status) in rows.items() if status == "done"}
    assert {r["source"] for r in after.collect()} == done
    known = spark.createDataFrame([("fr", "good text", "bon texte", datetime.datetime(2024, 1, 1))], empty.schema)
    kept = {r["source"]: r["translated"] for r in bilingual.bilingual(pages, "fr", cache=known, as_of=now, detector=in_french).collect()}
    assert kept["good text"] == "bon texte" and kept["same text"] == "[fr] same text"


def test_no_translator_needs_no_shuffle(spark):
    plan = bilingual.bilingual(_pages(spark, [(1, "http://x.test/", "<p>some text")]).coalesce(1), "fr")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_fold_in_order_carries_state(spark):
    rows = spark.range(5000).selectExpr("id % 3 as k", "id as i", "1 as n").union(spark.sql("select cast(null as bigint), 1L, 1"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = batching.greedy_batches(rows, ["k"], ["i"], 7, None, F.col("n")).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, g in got.groupby("k"):
        assert g.sort_values("i")["batch_id"].tolist() == [j // 7 for j in range(len(g))]
    assert got["k"].isna().sum() == 1


def test_too_many_languages(spark, monkeypatch):
    from pageflow.functions import language

    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = spark.createDataFrame([(x, f"words of {x}", i % 2) for i, x in enumerate("abcabc")], "lang string, text string, fold int")
    with pytest.raises(ValueError, match="languages"):
        language.profiles(rows, [0, 1])


def test_where_results_go(spark):
    from pageflow.operators.extract import blocks_of

    (block,) = blocks_of("<div><p><span>some text</span></p></div>")
    assert block[4].startswith(block[1]) and block[4].count("/") == block[1].count("/") + 1
    before = [b[6] for b in blocks_of("<p>some text<img src=x> <br></p><p>more <b>text</b></p>")]
    assert before[0] is not None and before[1] is None


def test_streaming_newest_text(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_id").alias("version"), F.col("props").alias("text"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.newest_text(stream, ["user_id"]).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = incremental.newest_text(events, ["user_id"])
    assert spark.table("newest").exceptAll(want).count() == 0 and want.exceptAll(spark.table("newest")).count() == 0


def until(spark, q, name, n):
    """Wait for n rows; a query with timers has no end of its own."""
    end = time.time() + 120
    while spark.table(name).count() < n and time.time() < end:
        time.sleep(0.2)
    q.stop()


def test_streaming_batches(spark, tmp_path):
    rows = spark.createDataFrame([("de", i, f"t{i}") for i in range(7)] + [("fr", 7, "x")], "lang string, seq long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.stream_batches(stream, 3, 3_600_000).writeStream.outputMode("append").format("memory").queryName("batches").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    until(spark, q, "batches", 6)
    got = {(r["lang"], r["seq"]): r["batch_id"] for r in spark.table("batches").collect()}
    assert got == {("de", i): i // 3 for i in range(6)}  # what is held waits for its timer


def test_streaming_batches_by_characters(spark, tmp_path):
    texts = ["a" * 5, "b" * 5, "c", "d" * 20, "e" * 3, "😀" * 4, "f" * 3]
    rows = spark.createDataFrame([("de", i, t) for i, t in enumerate(texts)], "lang string, seq long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.stream_batches(stream, 100, 3_600_000, chars=10).writeStream.outputMode("append").format("memory").queryName("by_chars").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    until(spark, q, "by_chars", 6)
    got = {r["seq"]: r["batch_id"] for r in spark.table("by_chars").collect()}
    twin = {r["seq"]: r["batch_id"] for r in batching.greedy_batches(rows, ["lang"], ["seq"], 100, 10, T.utf16_length(F.col("text"))).collect()}
    assert got == {k: v for k, v in twin.items() if v < max(twin.values())} and len(set(twin.values())) == 6


def test_first_anchored(spark):
    t0 = pd.Timestamp("2024-01-01")
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "event_id": range(6), "ts": [t0 + pd.Timedelta(milliseconds=m) for m in (0, 30, 49, 50, 60, 200)]}))
    got = incremental.first_anchored(rows, ["k"], 50).orderBy("event_id").collect()
    assert [r["batch_id"] for r in got] == [0, 0, 0, 1, 1, 2]


def test_merged_lines_are_asked_for_again_alone(spark):
    """A translator that loses lines, one that fails, texts with line ends, long and empty ones: every text has its answer or its error."""
    texts = ["one", "two\n  lines", "", "four", None, "Long sentence here. " * 80, "bad", "last", "  x  "]
    rows = spark.createDataFrame([(k, i, t) for k in ("a", None) for i, t in enumerate(texts)], "k string, i long, t string")
    asked = spark.sparkContext.accumulator(0)

    def loses(text, lang):
        asked.add(1)
        if text == "bad":
            raise RuntimeError("429")
        return " ".join(f"<{lang}>{x}" for x in text.split("\n"))

    got = bilingual.translate_by_lines(rows, ["k"], ["i"], "t", loses, "fr").collect()
    assert len(got) == 18
    of = {(r["k"], r["i"]): r for r in got}
    for k in ("a", None):
        assert [of[k, i]["translated"] for i in (0, 1, 2, 3, 4, 7, 8)] == ["<fr>one", "<fr>two lines", "", "<fr>four", "", "<fr>last", "<fr>x"]
        assert [of[k, i]["alone"] for i in range(9)] == [True, True, False, True, False, False, True, True, True]
        assert of[k, 5]["translated"].count("Long sentence here.") == 80 and of[k, 5]["translated"].count("<fr>") == 2
        assert (of[k, 6]["translated"], of[k, 6]["error"]) == (None, "429")
    # a whole reply needs no second request; a failed one is its rows' error
    keeps = lambda text, lang: "\n".join(f" {x}! " for x in text.split("\n"))
    whole = {r["i"]: (r["translated"], r["alone"]) for r in bilingual.translate_by_lines(rows.where("k = 'a' and i in (0, 1, 3)"), ["k"], ["i"], "t", keeps, "fr").collect()}
    assert whole == {0: ("one!", False), 1: ("two lines!", False), 3: ("four!", False)}

    def fails(text, lang):
        raise RuntimeError("no")

    assert {(r["translated"], r["error"], r["alone"]) for r in bilingual.translate_by_lines(rows.where("i in (0, 1)"), ["k"], ["i"], "t", fails, "fr").collect()} == {(None, "no", False)}


def test_long_parts_hold_texts_by_their_bytes(spark):
    import pyarrow as pa

    from pageflow.session import portions

    rows = spark.createDataFrame([(i, "Some words. " * n) for i, n in enumerate([0, 300, 1, 500, 200])] + [(9, None)], "id long, text string").coalesce(1)
    parts = batching.long_parts(rows, "text")
    # a pandas function would get all sentences of a batch of rows as objects at once
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert parts.columns == ["id", "text", "part", "part_text"]
    got = parts.groupBy("id").agg(F.sum(F.length("part_text")).alias("n"), F.max("part").alias("last")).orderBy("id").collect()
    assert [(r["id"], r["n"], r["last"]) for r in got] == [(1, 3600, 3), (2, 12, 0), (3, 6000, 6), (4, 2400, 2)]
    sizes = pa.RecordBatch.from_pydict({"n": [5, 5, None, 20, 1]})
    assert [x.num_rows for x in portions(sizes, "n", 10)] == [3, 1, 1]
