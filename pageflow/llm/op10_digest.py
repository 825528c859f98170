"""Operator 10: canonical exact digests of documents, with DataFrame functions only.

A text's canonical form is its NFC normal form, then case folded, then with runs of white space folded to one space and
none at the ends. Its fingerprint is a 128-bit xxhash of that form. Documents are grouped by it, and within groups of equal
hashes the forms themselves are compared byte by byte; should two differ, the fingerprints of that hash get the SHA-256
of the form as well, so equal fingerprints of documents always mean equal forms. Edited texts are told apart by the
hash, and in the same way where documents clash.

Forms are computed once for the texts and once for the edited texts, and again only for texts that share a hash without
being the same. One shuffle deals the texts to ranges of ids, for the next document; nothing else moves texts.

Normalisation costs one look at each character where a text has no mark that could combine (NFC quick check); other
texts are cut in a starter and what may combine with it, decomposed, put in canonical order and composed again.

Null and empty texts have the fingerprint of the empty form. Null ids sort first; rows of a repeated id follow each other by
fingerprint. The document after the last is the first, which may be itself. An empty table gives an empty result. Only
the id and text columns are read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.batches import id_and_text
from pageflow.session import materialise

#: Lookup tables are cut in so many parts by code point. Bits of the filter of repeated hashes, in maps of 2^15.
PARTS, MAPS = 64, 256
#: Bytes of text in a range of ids, about; ranges at most, then they grow; hashes that forms may clash on.
RANGE_BYTES, RANGES, CLASHES = 1 << 27, 20_000, 1000


def _char_class(chars: list[int]) -> str:
    """A regular expression's class for sorted code points."""
    out, start = [], None
    for a, b in zip(chars, [*chars[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{a:X}}}")
            start = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _unicode() -> tuple[str, dict[str, str], dict[str, int], dict[str, str]]:
    """What may change or combine, full canonical decompositions, combining classes, and compositions by pair; from the Unicode database, without Hangul syllables, which are computed."""
    decompose, klass, compose, affected = {}, {}, {}, []
    for n in range(0x300, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        if k := unicodedata.combining(c):
            klass[c] = k
        if unicodedata.normalize("NFC", c) != c or k:
            affected.append(n)
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        if (d := unicodedata.normalize("NFD", c)) != c:
            decompose[c] = d
            pair = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            if len(pair) == 2 and unicodedata.normalize("NFC", c) == c:
                compose[pair] = c
                affected.append(ord(pair[1]))
    affected += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]  # Hangul vowels and finals
    return _char_class(sorted(set(affected))), decompose, klass, compose


@lru_cache(maxsize=4)
def _maps(name: str) -> Column:
    """A table of _unicode() as an array of maps, by code point: few entries are compared for each key. It folds to one literal."""
    table = dict(zip(("decompose", "klass", "compose"), _unicode()[1:]))[name]
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for k, v in table.items():
        parts[ord(k[0]) % PARTS].append(f"{k}\x02{v}")
    between = (F.lit("\x01"), F.lit("\x02"))
    return F.array(*(F.str_to_map(F.lit("\x01".join(p)), *between) for p in parts))


def _lookup(name: str, key: Column) -> Column:
    """The value of a key; null if it has none."""
    return F.try_element_at(F.get(_maps(name), F.pmod(F.ascii(key), F.lit(PARTS))), key)


def _char(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _compose_unit(unit: Column) -> Column:
    """NFC of a starter and what follows it up to the next character that cannot combine."""
    chars = F.flatten(F.transform(F.split(unit, ""), lambda c: F.split(F.coalesce(_lookup("decompose", c), c), "")))
    kinds = F.transform(chars, lambda c: F.struct(c.alias("c"), F.coalesce(_lookup("klass", c).cast("int"), F.lit(0)).alias("k")))
    # canonical order: marks by class within their run, in place among equals
    run = lambda x, i: F.aggregate(F.slice(kinds, 1, i + 1), F.lit(0), lambda n, y: n + F.when(y["k"] == 0, 1).otherwise(0))
    ordered = F.array_sort(F.transform(kinds, lambda x, i: F.struct(run(x, i).alias("r"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))

    def joined(s: Column, c: Column) -> Column:
        a, b = F.ascii(s), F.ascii(c)
        lead, syllable = a - 0x1100, a - 0xAC00
        return (
            F.when((F.length(s) == 1) & lead.between(0, 18) & b.between(0x1161, 0x1175), _char(0xAC00 + (lead * 21 + b - 0x1161) * 28))
            .when((F.length(s) == 1) & syllable.between(0, 11171) & (F.pmod(syllable, F.lit(28)) == 0) & b.between(0x11A8, 0x11C2), _char(a + b - 0x11A7))
            .otherwise(_lookup("compose", F.concat(s, c)))
        )

    def step(acc: Column, x: Column) -> Column:
        new = joined(acc["starter"], x["c"])
        free = (acc["pending"] == "") | (acc["last"] < x["k"])
        text = lambda v: v.cast("string")
        return (
            F.when((acc["starter"] != "") & free & new.isNotNull(), F.struct(acc["done"].alias("done"), text(new).alias("starter"), acc["pending"].alias("pending"), acc["last"].alias("last")))
            .when(x["k"] == 0, F.struct(F.concat(acc["done"], acc["starter"], acc["pending"]).alias("done"), x["c"].alias("starter"), F.lit("").alias("pending"), F.lit(0).alias("last")))
            .otherwise(F.struct(acc["done"].alias("done"), acc["starter"].alias("starter"), F.concat(acc["pending"], x["c"]).alias("pending"), x["k"].alias("last")))
        )

    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("pending"), F.lit(0).alias("last"))
    return F.aggregate(ordered, empty, step, lambda a: F.concat(a["done"], a["starter"], a["pending"]))


#: Characters that may need more than a look: none below U+0300 changes or combines under NFC.
HIGH = "[^\\x00-\\x{2FF}]"


def nfc(text: Column) -> Column:
    """The NFC normal form. Marks before any starter are kept in canonical order."""
    affected = _unicode()[0]
    units = F.regexp_extract_all(text, F.lit(f"(?s).{affected}*"), F.lit(0))
    slow = F.array_join(F.transform(units, lambda u: F.when(u.rlike(affected), _compose_unit(u)).otherwise(u)), "")
    return F.when(text.rlike(HIGH) & text.rlike(affected), slow).otherwise(text)


#: White space, separators and the byte order mark: below U+0300, where a class is one table, and all of it.
LOW_SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0]+"
SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\p{Z}\\x{FEFF}]+"


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the canonical form of a text column: NFC, case folded, white space folded.

    The steps are columns of their own, so that no expression holds another one several times.
    """
    # upper, then lower case, is a fold; what stands between keeps the optimizer from dropping the first step
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    fold = lambda c: swap(F.lower(swap(F.upper(c), "ϴ", "Θ")), "ς", "σ")
    steps = df.withColumn("_nfc", nfc(F.coalesce(F.col(text), F.lit("")))).withColumn("_form", fold(F.col("_nfc")))
    spaced = F.when(F.col("_form").rlike(HIGH), F.regexp_replace("_form", SPACES, " ")).otherwise(F.regexp_replace("_form", LOW_SPACES, " "))
    return steps.withColumn(out, F.trim(spaced)).drop("_nfc", "_form")


def wide_hash(form: Column) -> Column:
    """128 bits of xxhash as 32 hex digits: two seeds."""
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(part(F.xxhash64(form)), part(F.xxhash64(F.lit(1), form))))


def copy_key(text: Column) -> Column:
    """What only copies share: the text's SHA-256, so that texts with one fingerprint that are not the same have several keys."""
    return F.sha2(text.cast("binary"), 256)


def _placed(key: Column) -> dict[str, Column]:
    bits = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")
    return {"map": F.pmod(bits, F.lit(MAPS)), "bit": F.pmod(F.shiftright(bits, 8), F.lit(1 << 15))}


def repeated_filter(rows: DataFrame) -> DataFrame:
    """map and bits: a filter of MAPS * 2^15 bits at most that passes the key of every row whose hash occurs with several keys."""
    several = rows.groupBy("hash").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("hash")
    # copies are one row before they meet
    place = rows.select("hash", "key").distinct().join(several, "hash", "left_semi").select(*(c.alias(k) for k, c in _placed(F.col("key")).items()))
    return place.groupBy("map").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def collisions(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Hashes shared by different canonical forms; within equal hashes, forms are compared byte by byte.

    texts: text; rows: key (copy_key of the text), hash. Copies have one key, so only texts that share a hash and are not the
    same need their form again. The filter lets those through and, when it is full, others too.
    """
    keyed = texts.withColumns(_placed(copy_key(F.col("text"))))
    # MAPS rows of 4 KB at most
    again = keyed.join(F.broadcast(repeated_filter(rows)), "map").where("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    forms = with_canonical(again.select("text"), "text", "form").select(wide_hash(F.col("form")).alias("hash"), "form")
    return forms.groupBy("hash").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("hash")


def _range_of(key: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are at most the key, by binary search."""
    steps = F.lit([1 << k for k in range(len(bounds).bit_length(), -1, -1)])
    all_bounds = F.lit([float(b) for b in bounds]).cast("array<double>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(all_bounds, at + step - 1) <= key.cast("double"), at + step).otherwise(at))


def with_range(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """rows (doc_id, hash, ...) with range, ascending with doc_id, nulls first, and how many ranges there are: about n, of like size.

    Bounds are approximate quantiles of the ids. An id that several of them fall on, null included, is cut by its rows'
    hashes in as many ranges, so rows of one id need not stand together.
    """
    least = -(1 << 63)  # stands for null
    keys = rows.select(F.coalesce("doc_id", F.lit(least)).alias("key"))
    found = keys.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted(set(found))
    ids = [None, *(None if b == float(least) else int(b) for b in bounds)]
    # in how many ranges the id of a bound is cut; beyond 2^53 a bound may stand for several ids
    cuts = [0, *(m if (m := found.count(b)) > 1 and (abs(b) < 1 << 53 or b == float(least)) else 0 for b in bounds)]
    starts = [sum(c + 1 for c in cuts[:i]) for i in range(len(cuts))]
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("own"))
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")  # of 2^32
    inner = F.when(of(cuts, "int") == 0, 0).when(F.col("doc_id").eqNullSafe(of(ids, "bigint")), F.shiftright(place * of(cuts, "int"), 32)).otherwise(of(cuts, "int"))
    owned = rows.withColumn("own", _range_of(F.coalesce("doc_id", F.lit(least)), bounds))
    return owned.withColumn("range", (of(starts, "int") + inner).cast("int")).drop("own"), starts[-1] + cuts[-1] + 1


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash and text with next_hash and next_text, those of the row after it in its range, by doc_id, hash and text.

    range, first and last tell a row's range and whether it stands at an end of it; the last one has no next row here.
    """
    ranged, ranges = with_range(docs, n)
    by = Window.partitionBy("range").orderBy("doc_id", "hash", "text")
    lead = {f"next_{c}": F.lead(c).over(by) for c in ("hash", "text")}
    return ranged.repartitionById(ranges, "range").withColumns({**lead, "first": F.row_number().over(by) == 1}).withColumn("last", F.isnull("next_hash"))


def _told_apart(form: Column, clash: list[str]) -> Column:
    """The hash of a form; where documents' forms clash, with its SHA-256."""
    h = wide_hash(form)
    return F.when(h.isin(clash), F.concat(h, F.sha2(form.cast("binary"), 256))).otherwise(h) if clash else h


def _edited(rows: DataFrame, clash: list[str], *more: Column) -> DataFrame:
    """Digests of rows with doc_id, hash, text, next_hash and next_text."""
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q))
    rows = with_canonical(rows.withColumn("edited", edited), "edited", "edited_form")
    near = lambda h: F.when(F.col("hash") == h, 1.0).otherwise(0.0)
    rows = rows.withColumn("edited_hash", _told_apart(F.col("edited_form"), clash))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"), near(F.col("edited_hash")).alias("near_edited"), near(F.col("next_hash")).alias("near_next"), *more)


def _digests(texts: DataFrame, n: int, clash: list[str]) -> DataFrame:
    """The result's rows and their key, written; a range's last row meets the first one of the next range afterwards."""
    own = with_canonical(texts, "text", "form").select("doc_id", _told_apart(F.col("form"), clash).alias("hash"), "text")
    ends = F.when(F.col("first") | F.col("last"), F.col("text")).alias("text")
    rows = materialise(_edited(with_next(own, n), clash, copy_key(F.col("text")).alias("key"), F.col("range"), F.col("first"), F.col("last"), ends), "op10-rows")
    # two rows for each range from here on
    firsts = rows.where("first").select("range", F.col("fingerprint").alias("next_hash"), F.col("text").alias("next_text"))
    by = Window.orderBy("range")
    after = firsts.select(F.col("range").alias("before"), F.coalesce(F.lead("range").over(by), F.min("range").over(Window.partitionBy())).alias("range"))
    lasts = rows.where("last").select("doc_id", F.col("fingerprint").alias("hash"), "text", "key", F.col("range").alias("before"))
    joined = _edited(lasts.join(after, "before").join(firsts, "range"), clash, F.col("key"))
    return rows.where("not last").select(joined.columns).union(joined)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the beginning of the next document.

    near_edited and near_next are 1 where the fingerprints are equal, else 0: an exact digest knows no other likeness.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-size // RANGE_BYTES)))
    rows = _digests(texts, n, [])
    clash = [r["hash"] for r in collisions(texts.select("text"), rows.select("key", F.col("fingerprint").alias("hash"))).limit(CLASHES + 1).collect()]
    if len(clash) > CLASHES:
        raise RuntimeError("too many different forms share a hash")
    if clash:  # it takes some 2^64 different forms to expect one
        rows = _digests(texts, n, clash)
    return rows.drop("key")
