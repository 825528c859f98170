"""Column functions on texts, URLs and provider requests. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow import config

#: White space as a browser trims it: Java's own class holds ASCII only.
SPACE = "[\\s\\x0B\\p{Z}\\x{FEFF}]"


def utrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def has_letter(c: Column) -> Column:
    return c.rlike("\\p{L}")


def is_short_ascii(c: Column) -> Column:
    return c.rlike("^[a-zA-Z0-9]{1,2}\\z")


def is_url_only(c: Column) -> Column:
    """Exactly one http(s) URL, untrimmed."""
    return c.rlike("^https?://[^\\s\\x0B\\p{Z}\\x{FEFF}]+\\z")


def is_eligible(c: Column) -> Column:
    """A trimmed text worth translating."""
    return (c != "") & has_letter(c) & ~is_short_ascii(c)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def is_worth_caching(source: Column, translated: Column) -> Column:
    return (utrim(translated) != "") & ~same_ignoring_case(source, translated)


def result_status(source: Column, translated: Column, error: Column | None = None) -> Column:
    """error (a failed batch), pending (no answer yet), noop (empty, or the source but for case; not trimmed), done."""
    failed = F.lit(False) if error is None else error.isNotNull()
    return F.when(failed, "error").when(translated.isNull(), "pending").when((translated == "") | same_ignoring_case(source, translated), "noop").otherwise("done")


def layout(source: Column) -> Column:
    return F.when(utf16_length(source) <= config.SAME_LINE_CHARS, "inline").otherwise("break")


def is_explanation(source: Column, translated: Column) -> Column:
    """A short text whose translation is suspiciously long."""
    n = utf16_length(source)
    return (n < config.SHORT_CHARS) & (utf16_length(translated) > n * config.EXPLANATION_RATIO)


# --- URLs
def url_host(c: Column) -> Column:
    """Lower-case host; empty if the URL has none or is broken."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(""))


def url_path(c: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/"))


def is_pdf_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PATH"))).endswith(".pdf"), F.lit(False))


# --- provider codec
def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _char(n: Column) -> Column:
    """The character of a code point (chr() takes it modulo 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


# The forms of entities.
ENTITY = "&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"


def ended_entities(c: Column) -> Column:
    """Entities that lack their semicolon as the text they are written with; browsers read some of them, such as &amp before a tag."""
    return F.regexp_replace(c, f"&(?!{ENTITY[1:]})", "&amp;")


def decode_entities(c: Column) -> Column:
    """Six named entities, decimal and hexadecimal ones; unknown ones and code points out of range stay."""
    found = F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    between = F.split(c, ENTITY)
    body = lambda e: F.substring(e, F.lit(2), F.length(e) - 2)

    def one(e: Column) -> Column:
        digits = F.regexp_extract(e, "^&#[xX]?0*([0-9a-fA-F]+);", 1)
        base16 = e.rlike("^&#[xX]")
        number = F.when(F.length(digits) > 7, F.lit(-1)).otherwise(F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        valid = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        named = F.create_map(*(F.lit(x) for kv in config.ENTITIES.items() for x in kv))
        return F.when(e.startswith("&#"), F.when(valid, _char(number)).otherwise(e)).otherwise(F.coalesce(F.try_element_at(named, body(e)), e))

    return F.when(c.contains("&"), F.array_join(F.flatten(F.zip_with(between, found, lambda t, e: F.array(F.coalesce(t, F.lit("")), F.coalesce(one(e), F.lit(""))))), "")).otherwise(c)


def flatten_lines(c: Column) -> Column:
    """Line ends with the white space around them become one space."""
    return utrim(F.regexp_replace(c, f"{SPACE}*\\n{SPACE}*", " "))


def tag_encode(texts: Column) -> Column:
    """An array of texts as one message: a lone text as it is, others in numbered tags."""
    tagged = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit('<t id="'), i.cast("string"), F.lit('">'), t, F.lit("</t>"))), "\n")
    return F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(tagged)


# A closed tag of a reply.
CLOSED = '(?s)<t id="(\\d{1,9})">(.*?)</t>'


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: inside a lambda a column is computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tag_decode(texts: Column, reply: Column) -> Column:
    """The reply's texts by number: the last of several counts, numbers out of range don't; an unclosed last tag fills an empty slot; what is missing or an explanation gives the source."""
    ids, bodies = F.regexp_extract_all(reply, F.lit(CLOSED), F.lit(1)), F.regexp_extract_all(reply, F.lit(CLOSED), F.lit(2))
    tail = '(?s)^.*<t id="(\\d{1,9})">(.+)\\z'
    tail_id, tail_body = F.regexp_extract(reply, tail, 1), F.regexp_extract(reply, tail, 2)
    parts = F.struct(F.reverse(ids.cast("array<int>")).alias("ids"), F.reverse(bodies).alias("bodies"), tail_id.alias("tail_id"), tail_body.alias("tail_body"))

    def slot(source: Column, i: Column, p: Column) -> Column:
        closed = utrim(F.coalesce(F.get(p["bodies"], (F.array_position(p["ids"], i) - 1).cast("int")), F.lit("")))
        found = F.when((closed == "") & (p["tail_id"] != "") & (p["tail_id"].cast("int") == i), utrim(p["tail_body"])).otherwise(closed)
        return F.when((found == "") | is_explanation(source, found), source).otherwise(found)

    alone = F.transform(texts, lambda t: F.when(is_explanation(t, utrim(reply)), t).otherwise(utrim(reply)))
    return F.when(F.size(texts) == 1, alone).otherwise(_bound(parts, lambda p: F.transform(texts, lambda t, i: slot(t, i, p))))


def placed_results(texts: Column, reply: Column) -> Column:
    """An array of (pos, source, translated): lines of a reply by their places; if their number differs, translated is null and each text is sent again alone."""
    place = lambda lines: F.transform(texts, lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("source"), F.get(lines, i).alias("translated")))
    return _bound(line_decode(texts, reply), place)


def first_translation(body: Column) -> Column:
    """The text of a provider's reply in a list; null for any other reply, such as an object that tells an error."""
    return F.when(utrim(body).startswith("["), F.nullif(F.get_json_object(body, "$[0].translations[0].text"), F.lit("")))


def reply_error(body: Column) -> Column:
    """The message for a reply without a translation; null if it has one."""
    return F.when(first_translation(body).isNull(), F.concat(F.lit("Microsoft translate failed: "), F.substring(body, 1, config.MESSAGE_CHARS)))


def line_decode(texts: Column, reply: Column) -> Column:
    """Lines of a reply, trimmed, if there is one for each text; else null: the texts are then sent one by one."""
    lines = F.split(reply, "\n")
    return F.when(F.size(lines) == F.size(texts), F.transform(lines, utrim))


def fill_prompt(template: Column, lang: Column) -> Column:
    """The first placeholder only."""
    parts = F.split(template, "\\{\\{targetLang\\}\\}", 2)
    return F.when(F.size(parts) == 2, F.concat(parts[0], lang, parts[1])).otherwise(template)


def completions_url(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, "/+\\z", ""), F.lit("/chat/completions"))


def migrate_endpoint(c: Column) -> Column:
    """The base URL of a full one that an old settings document holds."""
    return F.regexp_replace(F.regexp_replace(c, "/chat/completions/?\\z", ""), "/+\\z", "")


def provider_lang(c: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for kv in config.LANG_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(codes, c), c)


def primary_subtag(c: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(c, F.lit("-"), F.lit(1)), F.lit("")), F.lit("zh"))


def shown_error(c: Column) -> Column:
    out = F
    for part, shown in config.ERRORS:
        out = out.when(c.contains(part), F.replace(F.lit(shown), F.lit("{}"), c) if "{}" in shown else F.lit(shown))
    return out.when(c.rlike("\\b5\\d\\d\\b"), config.PROVIDER_DOWN).when(F.lower(c).contains("failed to fetch"), config.UNREACHABLE).otherwise(c)


#: A rewrite of a request: host, model and the effort set so far to the effort after it; null is unset.
Rewrite = Callable[[Column, Column, Column], Column]

# Hosts, and the models whose effort is set.
REWRITES: list[Rewrite] = [
    lambda host, model, effort: F.when((host == "api.openai.com") & ~model.rlike("\\bgpt-(3|4)"), F.when(model.rlike("\\bgpt-5\\b\\z"), "minimal").otherwise("none")).otherwise(effort),
    lambda host, model, effort: F.when((host == "api.deepseek.com") & model.rlike("\\bdeepseek-v4\\b"), "low").otherwise(effort),
    lambda host, model, effort: F.when((host == "generativelanguage.googleapis.com") & model.rlike("\\bgemini-(2\\.5|3)"), "low").otherwise(effort),
]


def reasoning_effort(endpoint: Column, model: Column, rewrites: list[Rewrite] | None = None) -> Column:
    """What a request's reasoning effort is set to after all rewrites, in order; a user may append to the list."""
    effort = F.lit(None).cast("string")
    for rewrite in REWRITES if rewrites is None else rewrites:
        effort = rewrite(url_host(endpoint), model, effort)
    return effort


def request_body(model: Column, system: Column, user: Column, effort: Column) -> Column:
    """The JSON body of a request; an unset effort is left out."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), effort.alias("reasoning_effort")))


def reply_text(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))


def session_expiry(now: Column, seconds: Column) -> Column:
    """A session's end: its given time, one hour at most and if none is given, less a minute."""
    return now + F.make_dt_interval(secs=F.least(F.coalesce(seconds, F.lit(3600)), F.lit(3600)) - 60)


# A sentence.
SENTENCE = "[^.!?。！？]*[.!?。！？]+[\"')\\]]*[\\s\\x0B\\p{Z}\\x{FEFF}]*|[^.!?。！？]+\\z"


def to_iso(ts: Column) -> Column:
    """A time as ISO 8601 text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(c: Column) -> Column:
    """Its time; the epoch if there is none."""
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_seconds(F.lit(0)))


def is_stale_clone(clone: Column, source: Column) -> Column:
    """Whether a part cut from an earlier text is out of date: it is empty, or its beginning stands in the new text."""
    probe = utrim(clone)
    head = F.substring(probe, 1, config.CLONE_CHARS)
    return (probe == "") | F.when(F.length(head) < config.CLONE_LEAST, F.contains(source, probe)).otherwise(F.contains(source, head))


def sentences(c: Column) -> Column:
    """Runs up to closing marks with what closes them and white space; the rest."""
    return F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))


def echo(prefix: str = "[{}] "):
    """The deterministic translator: the target language in front of the text."""
    return lambda text, lang: F.concat(F.format_string(prefix.replace("{}", "%s"), lang), text)
