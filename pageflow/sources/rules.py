"""Rule texts as tables: one line per rule, `domain##selector` skips, `domain#+#selector` includes."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions.text import utrim
from pageflow.session import ship

PATH = ":matches-path("


def _closing(s: str) -> int:
    """Where the bracket opened by PATH closes, escapes honoured; -1 if it doesn't."""
    depth, skip = 1, False
    for i, c in enumerate(s[len(PATH) :], len(PATH)):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    return -1


def path_condition(selector: str) -> tuple[str | None, str]:
    """(path pattern, selector) of a selector that may begin with a path condition. Unbalanced ones stay as they are."""
    if not selector.startswith(PATH) or (end := _closing(selector)) < 0:
        return None, selector
    return selector[len(PATH) : end], selector[end + 1 :].strip() or "*"


def parse_rules(lines: DataFrame) -> DataFrame:
    """lines: line_no, value. rule_id, domain, type, path_pattern, selector of every rule; blank lines and `!` comments go.

    A rule text is configuration, read once; the path condition's nested brackets are found by a UDF on its few lines.
    """
    ship(lines.sparkSession)
    line = utrim(F.col("value"))
    kept = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("!"))
    include, skip = "^(.+?)#\\+#(.+)\\z", "^(.+?)##(.+)\\z"
    is_include = F.col("line").rlike(include)
    part = lambda i: F.when(is_include, F.regexp_extract("line", include, i)).otherwise(F.regexp_extract("line", skip, i))
    conditioned = F.udf(lambda s: path_condition(s), "path_pattern string, selector string")
    rules = kept.where(is_include | F.col("line").rlike(skip)).select("line_no", part(1).alias("domain"), F.when(is_include, "include").otherwise("exclude").alias("type"), conditioned(utrim(part(2))).alias("c"))
    return rules.select(F.col("line_no").alias("rule_id"), "domain", "type", "c.path_pattern", "c.selector")


def rule_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")


def effective_rules(stored: DataFrame | None, built_in: DataFrame) -> DataFrame:
    """The stored rules if they hold any, else the built-in ones."""
    return stored if stored is not None and not stored.isEmpty() else built_in


def refresh_rules(spark: SparkSession, candidate: str, kept: DataFrame, due: bool = True, forced: bool = False) -> DataFrame:
    """Rules of a candidate file. A file that can't be read or holds no rule leaves the kept ones; if forced, it is an error.

    ``due`` tells whether the kept ones are old enough to be read again (refresh_due); forced reads in any case.
    """
    if not due and not forced:
        return kept
    try:
        lines = spark.read.text(candidate, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
        found = parse_rules(lines)
        if found.isEmpty():
            raise ValueError("the file holds no rule")
        return found
    except (AnalysisException, PySparkException, ValueError):
        if forced:
            raise
        return kept


#: Escapes that mean in Java what they mean in a browser; other escaped letters stand for themselves there.
_ESCAPES = frozenset("dDwWsSbBnrtfvux0123456789")
_QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")
_GROUP = re.compile(r"\?(?:[:=!]|<[=!]|<([A-Za-z_$][\w$]*)>)")


@lru_cache(maxsize=4096)
def java_pattern(pattern: str | None) -> str | None:
    """The expression of a path pattern in slashes, as browsers read it, in the words of Java; null if it is none.

    What only one of the two knows is rewritten (brackets in classes, names with a dollar sign, literal braces) or is no
    expression (inline flags, possessive quantifiers, atomic groups). Whether the rest compiles is for Java to say.
    """
    if pattern is None or len(pattern) < 2 or pattern[0] != "/" or pattern[-1] != "/":
        return None
    s, out, i, names, quantified = pattern[1:-1], [], 0, {}, False
    while i < len(s):
        c, again = s[i], False
        if c == "\\":
            if i + 1 == len(s):
                return None
            e = s[i + 1]
            if e == "k" and (m := re.match(r"<([A-Za-z_$][\w$]*)>", s[i + 2 :])):
                out.append(f"\\k<{names.setdefault(m[1], f'g{len(names)}')}>")
                i += 2 + m.end()
                quantified = False
                continue
            out.append(e if e.isascii() and e.isalnum() and e not in _ESCAPES else "\\x0B" if e == "v" else "\\" + e)
            i += 2
        elif c == "[":
            j, inner, negated = i + 1, [], s[i + 1 : i + 2] == "^"
            j += negated
            while j < len(s) and s[j] != "]":
                if s[j] == "\\" and j + 1 < len(s):
                    e = s[j + 1]
                    inner.append("\\x08" if e == "b" else "\\x0B" if e == "v" else e if e.isascii() and e.isalnum() and e not in _ESCAPES else "\\" + e)
                    j += 2
                else:
                    inner.append("\\" + s[j] if s[j] in "[&^" else s[j])
                    j += 1
            if j >= len(s):
                return None
            out.append("[" + "^" * negated + "".join(inner) + "]" if inner else "[\\s\\S]" if negated else "(?!)")
            i = j + 1
        elif c == "(" and s[i + 1 : i + 2] == "?":
            m = _GROUP.match(s, i + 1)
            if not m:
                return None
            out.append("(" + (f"?<{names.setdefault(m[1], f'g{len(names)}')}>" if m[1] else m[0]))
            i = m.end()
        elif c in "*+?" or c == "{" and _QUANTIFIER.match(s, i):
            m = _QUANTIFIER.match(s, i) if c == "{" else None
            end = m.end() if m else i + 1
            if quantified or s[end : end + 1] == "+":  # repeated, or possessive
                return None
            out.append(s[i:end])
            if s[end : end + 1] == "?":
                out.append("?")
                end += 1
            i, again = end, True
        else:
            out.append("\\" + c if c in "{}" else c)
            i += 1
        quantified = again
    return "".join(out)


def path_expression(pattern: Column) -> Column:
    """The Java expression of a pattern in slashes; null for other patterns, and for what does not compile there."""
    java = F.udf(lambda p: java_pattern(p), "string")(pattern)
    return F.when(is_regex(pattern), F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java))


def is_regex(pattern: Column) -> Column:
    return (F.length(pattern) >= 2) & pattern.startswith("/") & pattern.endswith("/")
