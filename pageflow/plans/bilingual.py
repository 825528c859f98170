"""Raw pages to the bilingual table: rules, blocks, filters, cache, batches, translator, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.config import MESSAGE_CHARS, REQUEST_CHARS
from pageflow.functions import text as T
from pageflow.functions.language import other_language
from pageflow.operators import blocks as B
from pageflow.operators import cache as C
from pageflow.operators.batching import long_parts, packed_groups
from pageflow.operators.extract import extract_blocks
from pageflow.operators.rules import place_selectors
from pageflow.session import materialise, ship

#: A translator: texts and a target language to as many texts.
Translator = Callable[[list[str], str], list[str]]


def with_places(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"host": T.url_host(F.col("url")), "path": T.url_path(F.col("url"))})


def page_blocks(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Blocks of pages, with the selectors of the rules that hold for each. PDFs have none; URL-only blocks go.

    Selectors depend on host and path alone and are joined by them: each page is extracted once, whatever its id.
    """
    rows = with_places(pages.where(~T.is_pdf_url(F.col("url"))))
    if rules is not None:
        rows = rows.join(place_selectors(rows.select("host", "path"), rules), ["host", "path"], "left")
    return extract_blocks(rows).where(~T.is_url_only(F.col("text")))


def translate_texts(texts: DataFrame, translator: Translator, target_lang: str, batch: int = 20, source: str = "source") -> DataFrame:
    """Distinct texts with translated and error: sent in batches inside tasks. Fewer results than texts, or a null, is an error of the batch."""
    ship(texts.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out, errors = [], []
            rows = pdf[source].tolist()
            for i in range(0, len(rows), batch):
                some = rows[i : i + batch]
                try:
                    got = translator(some, target_lang)
                    if len(got) < len(some) or any(g is None for g in got[: len(some)]):
                        raise ValueError(f"{len(got)} results for {len(some)} texts")
                    out += got[: len(some)]
                    errors += [None] * len(some)
                except Exception as e:  # noqa: BLE001  an error belongs to the rows of its batch
                    out += [None] * len(some)
                    errors += [str(e)[:MESSAGE_CHARS]] * len(some)
            yield pd.DataFrame({"source": rows, "translated": out, "error": errors})

    return texts.select(source).distinct().mapInPandas(run, "source string, translated string, error string")


def echo_translator(texts: list[str], target_lang: str) -> list[str]:
    """The deterministic default: the language in front of each text."""
    return [f"[{target_lang}] {t}" for t in texts]


#: A translator of one message: a text and a target language to a text. It may merge or split lines.
OneTranslator = Callable[[str, str], str]


def _sent(messages: DataFrame, text: str, translator: OneTranslator, target_lang: str, *keep: str) -> DataFrame:
    """keep, reply and error: each row's text sent alone."""
    ship(messages.sparkSession)
    schema = ", ".join([*(f"`{k}` {messages.schema[k].dataType.simpleString()}" for k in keep), "reply string", "error string"])

    def ask(x: str) -> tuple[str | None, str | None]:
        try:
            return translator(x, target_lang), None
        except Exception as e:  # noqa: BLE001  an error belongs to its message
            return None, str(e)[:MESSAGE_CHARS]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            replies = [ask(x) for x in pdf[text].tolist()]
            yield pdf[list(keep)].assign(reply=[r for r, _ in replies], error=[e for _, e in replies])

    return messages.select(*keep, *([] if text in keep else [text])).mapInPandas(run, schema)


def translate_by_lines(rows: DataFrame, key: list[str], order: list[str], text: str, translator: OneTranslator, target_lang: str, limit: int = REQUEST_CHARS) -> DataFrame:
    """key, order, translated, error and alone of every row: texts of a key in order, many to a request, a line each.

    Line ends inside texts become spaces first. A request holds up to ``limit`` units with its line ends. If the number of a
    reply's lines is not that of the texts, the translator has merged or split some, and each text of that request is sent
    again alone (``alone``). A text over the limit is sent in parts at its sentences, an empty one not at all. An error is that of
    all rows of its request. Rows of a key are told apart by order.
    """
    if taken := {"flat", "place", "message", "units"} & {*key, *order}:
        raise ValueError(f"columns with names of their own: {sorted(taken)}")
    ident = [*key, *order]
    flat = rows.select(*ident, T.flatten_lines(F.coalesce(F.col(text), F.lit(""))).alias("flat")).withColumn("units", T.utf16_length(F.col("flat")))
    flat = materialise(flat, "lines")
    empty = flat.where("flat = ''").select(*ident, F.lit("").alias("translated"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("alone"))
    # in requests of many
    short = packed_groups(flat.where((F.col("flat") != "") & (F.col("units") <= limit)), key, order, "flat", limit)
    by_place = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), F.col("flat"))))
    grouped = short.groupBy(*key, "batch_id").agg(by_place.alias("place"))  # a request: limit units at most
    grouped = grouped.select(*key, "place", F.array_join(F.col("place.flat"), "\n").alias("message"))
    replies = materialise(_sent(grouped, "message", translator, target_lang, *key, "place"), "replies")
    lines = F.split("reply", "\n", -1)
    fits = F.size(lines) == F.size("place")
    each = F.explode(F.transform("place", lambda p, i: F.struct(*(p[c].alias(c) for c in order), p["flat"].alias("flat"), F.when(fits, T.utrim(F.get(lines, i))).alias("line"))))
    placed = replies.select(*key, "error", each.alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in order), "x.flat", F.col("x.line").alias("translated"), "error")
    done = placed.where("translated is not null or error is not null").select(*ident, "translated", "error", F.lit(False).alias("alone"))
    # again, one by one
    again = _sent(placed.where("translated is null and error is null"), "flat", translator, target_lang, *ident).select(*ident, F.col("reply").alias("translated"), "error", F.lit(True).alias("alone"))
    parts = long_parts(flat.where(F.col("units") > limit), "flat", limit)
    long_ = _sent(parts, "part_text", translator, target_lang, *ident, "part")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "reply"))), lambda x: x["reply"]), "")
    long_ = long_.groupBy(*ident).agg(F.when(F.max("error").isNull(), whole).alias("translated"), F.max("error").alias("error")).withColumn("alone", F.lit(False))
    return done.unionByName(again).unionByName(long_).unionByName(empty)


#: Adds ``detected``, the language of each row's text, to rows with text.
Detector = Callable[[DataFrame], DataFrame]


def _answered(found: DataFrame, target_lang: str, cache: DataFrame | None, as_of: Column | None, translator: Translator | None) -> tuple[DataFrame, DataFrame]:
    """Blocks with translated and error, and the new translations (source, translated, error), both written.

    Blocks are extracted once and written; texts are joined by a hash, and compared.
    """
    found = materialise(found, "blocks")
    asked = found.select(F.lit(target_lang).alias("target_lang"), F.col("text").alias("source"))
    work = asked if cache is None else C.misses(asked, cache, as_of)
    new = materialise(translate_texts(work, translator or echo_translator, target_lang), "translations")
    known = new
    if cache is not None:
        live = C.lookup(asked.distinct(), cache, as_of).where("translated is not null")
        known = new.unionByName(live.select("source", "translated", F.lit(None).cast("string").alias("error")))
    keyed = known.withColumn("key", F.xxhash64("source"))
    on = (F.xxhash64(found["text"]) == keyed["key"]) & (found["text"] == keyed["source"])
    return found.join(keyed, on, "left").drop("source", "key"), new


def _wanted(pages: DataFrame, target_lang: str, rules: DataFrame | None, detector: Detector | None) -> DataFrame:
    """Blocks that are not yet in the target language; those of unknown language stay."""
    found = page_blocks(pages, rules)
    return found if detector is None else other_language(detector(found), F.lit(target_lang)).select(found.columns)


def bilingual(pages: DataFrame, target_lang: str, rules: DataFrame | None = None, cache: DataFrame | None = None, as_of: Column | None = None, translator: Translator | None = None, detector: Detector | None = None) -> DataFrame:
    """page_id, block_ord, source, translated, status, layout.

    Each distinct text is translated once, however often it occurs. Without a translator of its own the echo is a
    column expression in the same stage as the extraction, and nothing is shuffled at all. Blocks of a failed batch have
    the status error. With a detector, blocks that are in the target language have no row.
    """
    found = _wanted(pages, target_lang, rules, detector)
    if translator is None and cache is None:
        return B.apply_results(found.withColumn("translated", T.echo()(F.col("text"), F.lit(target_lang))))
    return B.apply_results(_answered(found, target_lang, cache, as_of, translator)[0])


def bilingual_and_cache(pages: DataFrame, target_lang: str, cache: DataFrame, as_of: Column, rules: DataFrame | None = None, translator: Translator | None = None, detector: Detector | None = None) -> tuple[DataFrame, DataFrame]:
    """The bilingual table, and the cache after it: new translations that are worth keeping are upserted, then it is evicted."""
    rows, new = _answered(_wanted(pages, target_lang, rules, detector), target_lang, cache, as_of, translator)
    return B.apply_results(rows), C.evict(C.upsert(cache, cacheable(new, target_lang, as_of)), as_of)


def retry_errors(table: DataFrame, translator: Translator, target_lang: str) -> DataFrame:
    """A bilingual table whose rows with the status error have all been sent again; the others stay as they are."""
    failed = F.col("status") == "error"
    again = translate_texts(table.where(failed).select("source"), translator, target_lang)
    again = again.select(F.col("source").alias("asked"), F.col("translated").alias("got"), F.col("error").alias("failed_again"))
    joined = table.join(again, failed & (F.col("source") == F.col("asked")), "left")
    status = F.when(failed, T.result_status(F.col("source"), F.col("got"), F.col("failed_again"))).otherwise(F.col("status"))
    return joined.select("page_id", "block_ord", "source", F.when(failed, F.col("got")).otherwise(F.col("translated")).alias("translated"), status.alias("status"), "layout")


def cacheable(translated: DataFrame, target_lang: str, now: Column) -> DataFrame:
    """Rows of translate_texts that are worth keeping, as cache rows."""
    return translated.where(T.is_worth_caching(F.col("source"), F.col("translated"))).select(F.lit(target_lang).alias("target_lang"), "source", "translated", now.alias("ts"))
