"""Pages as a table of nodes, and their readable blocks from it by windows.

A parse function gives a row for each node with its place in document order (``pre``) and the place of the last node below
it (``last``). Every decision of the extraction is then a column: what is inherited comes from the nearest node around
(intervals nest, so a running count of open ones names it), what is below from the next such node in document order, and
families are partitions by parent. All windows part by page, so the table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.functions.html import Node, compile_selector, matches, parse
from pageflow.operators.extract import DONE_ATTR, EDITORS, INLINE, INLINE_BLOCK, LEAVES, LEFT_OUT, NEVER, PORTION, RESULT_CLASS, WHITE, extract_blocks, valid
from pageflow.session import materialise, portions, ship

NODE_FIELDS = [
    ("page", "long", pa.int64()), ("page_id", "long", pa.int64()), ("pre", "int", pa.int32()), ("last", "int", pa.int32()), ("parent", "int", pa.int32()),
    ("tree", "int", pa.int32()), ("nth", "int", pa.int32()), ("path", "string", pa.string()), ("tag", "string", pa.string()), ("text", "string", pa.string()),
    ("attrs", "map<string,string>", pa.map_(pa.string(), pa.string())), ("up_style", "string", pa.string()), ("hosts", "boolean", pa.bool_()),
    ("limited", "boolean", pa.bool_()), ("skip_hit", "boolean", pa.bool_()), ("include_hit", "boolean", pa.bool_()), ("editor_hit", "boolean", pa.bool_()),
]
NODE_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in NODE_FIELDS)
#: A style that may keep line breaks, told from a page's source: such pages are cut at blank lines, which is left to the walk.
KEEPS_LINES = "(?i)white-space|style\\s*=[^>]*&"
#: Beyond every place in a page.
FAR = 2**31 - 1
#: White space as in the walk, for a character class.
SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE)


def nodes_of(html: str, skip: list[str], include: list[str]) -> list[list]:
    """pre, last, parent, tree, nth, path, tag, text, attrs, the parent's style, whether it hosts a shadow tree, whether parts are
    included by a rule, and what selectors say of it. A shadow tree follows its host's own nodes and has a number of its own."""
    left, kept, editors = ([compile_selector(s) for s in group] for group in (skip, include, EDITORS))

    def hit(n: Node, selectors: list[tuple]) -> bool:
        return n.tag not in ("#text", "#comment") and any(matches(n, s) for s in selectors)

    rows: list[list] = []
    stack: list[tuple[Node | None, int, int]] = [(parse(html), -1, 0)]
    trees = 0
    while stack:
        n, parent, tree = stack.pop()
        if n is None:
            rows[parent][1] = len(rows) - 1
            continue
        at, up = len(rows), n.parent
        style = up.attrs.get("style") if parent >= 0 and up is not None and up.is_element else None
        rows.append([at, at, parent, tree, n.index, n.path, n.tag, n.text, list(n.attrs.items()), style, bool(n.shadow), bool(include), hit(n, left), hit(n, kept), n.is_element and bool(n.attrs) and hit(n, editors)])
        stack.append((None, at, 0))
        trees += bool(n.shadow)
        stack += [(k, at, trees) for k in n.shadow[::-1]]
        stack += [(k, at, tree) for k in n.kids[::-1]]
    return rows


def page_nodes(pages: DataFrame) -> DataFrame:
    """page_id, html and optionally skip and include (arrays of selectors) to one row per node; ``page`` numbers the rows of pages,
    so null ids and repeated rows are pages of their own. Written once and read back, since the number is of a task.

    Null and empty pages have no nodes. Memory: the nodes of about PORTION bytes of pages, one page at least.
    """
    ship(pages.sparkSession)
    arrays = [F.col(c) if c in pages.columns else F.array().cast("array<string>").alias(c) for c in ("skip", "include")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, "html", PORTION):
                rows = [[key, i, *node] for key, i, html, s, x in zip(*(part.column(c).to_pylist() for c in ("page", "page_id", "html", "skip", "include"))) if html for node in nodes_of(html, valid(s), valid(x))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, (_, _, kind) in enumerate(NODE_FIELDS)], [n for n, _, _ in NODE_FIELDS])

    numbered = pages.select(F.monotonically_increasing_id().alias("page"), F.col("page_id").cast("long").alias("page_id"), "html", *arrays)
    return materialise(numbered.mapInArrow(run, NODE_SCHEMA), "nodes")


# --- what stands around and below a node
def nearest(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """The value of the innermost node, itself included, for which it isn't null.

    A running count of the open ones is a node's level; the last of a level to open is still open.
    """
    marks = F.when(F.col("_v").isNull(), F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("step")))).otherwise(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step"))))
    rows = nodes.withColumn("_v", value).select("*", F.explode(marks).alias("_m"))
    level = F.sum("_m.step").over(Window.partitionBy("page").orderBy("_m.at", F.col("_m.step") >= 0).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_level", level).where("_m.step >= 0")
    found = F.last("_v", ignorenulls=True).over(Window.partitionBy("page", "_level").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.col("_level") > 0, found)).drop("_v", "_m", "_level")


def covered(flag: Column) -> Column:
    """Whether a node or one around it has the flag."""
    ends = F.max(F.when(flag, F.col("last"))).over(Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(ends >= F.col("pre"), F.lit(False))


def following(flag: Column, keys: list[str], own: bool) -> Column:
    """Place of the next node with the flag in document order, of those with the same keys; from the node itself on, or after it."""
    back = Window.partitionBy("page", *keys).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return F.coalesce(F.min(F.when(flag, F.col("pre"))).over(back), F.lit(FAR))


def _style(name: str, style: str = "style") -> Column:
    """The last value of a property in a style."""
    found = F.regexp_extract_all(F.col(style), F.lit(f"(?i)(?:^|;)\\s*{name}\\s*:(?=[^;])\\s*([^;]*?)\\s*(?=;|$)"), F.lit(1))
    return F.when(F.col(style).isNotNull(), F.nullif(F.lower(F.get(F.reverse(found), F.lit(0))), F.lit("")))


def _in(tags: frozenset | list) -> Column:
    return F.col("tag").isin(sorted(tags))


def facts(nodes: DataFrame) -> DataFrame:
    """Nodes with: element, white, hidden, inline, off_limits, left_out, excluded, inside, included, stopped, has_text, holds_block, in_run and
    stateful (a widget that opens is in it or below)."""
    attr = {a: F.col("attrs")[a] for a in ("style", "class", "hidden", "translate", "contenteditable", "aria-expanded", DONE_ATTR)}
    below = lambda flag, own: following(flag, ["tree"], own) <= F.col("last")
    element, classes = ~F.col("tag").startswith("#"), F.split(F.coalesce(attr["class"], F.lit("")), "\\s+")
    n = nodes.withColumns({"element": element, "style": attr["style"], "white": (F.col("tag") == "#text") & F.col("text").rlike(f"^[{SPACE}]*\\z")})
    n = n.withColumns({"display": _style("display"), "up_display": _style("display", "up_style"), "visibility": _style("visibility"), "width": _style("width"), "height": _style("height")})
    n = nearest(n, F.when(F.col("element"), F.col("visibility")), "seen")
    n = nearest(n, F.when(F.col("element") & (attr["contenteditable"] != "inherit"), F.lower(attr["contenteditable"]) != "false"), "editable")
    tiny = [F.coalesce(F.regexp_extract(side, "^([0-9.]+)(?:px)?\\z", 1).try_cast("double") <= 1, F.lit(False)) for side in ("width", "height")]
    n = n.withColumns({
        "gone": covered(F.col("element") & ((F.coalesce("display", F.lit("")) == "none") | attr["hidden"].isNotNull())),
        "in_editor": covered(F.col("editor_hit")),
        "inside": covered(F.col("include_hit")),
        "has_text": below((F.col("tag") == "#text") & ~F.col("white"), True),
        "stateful": below(F.col("element") & attr["aria-expanded"].isNotNull(), True),
        "host_below": below(F.col("hosts"), False),
        "above": following(F.col("include_hit"), [], False) <= F.col("last"),
    })
    by_parent = F.coalesce(F.col("up_display").rlike("flex|grid"), F.lit(False))
    n = n.withColumns({
        "hidden": F.col("element") & (tiny[0] | tiny[1] | F.col("gone") | F.coalesce(F.col("seen").isin("hidden", "collapse"), F.lit(False))),
        "inline": F.coalesce(F.col("display").startswith("inline"), ~by_parent & _in(INLINE | INLINE_BLOCK)),
        "off_limits": F.col("element") & (_in(NEVER) | F.array_contains(classes, "notranslate") | F.array_contains(classes, RESULT_CLASS) | F.coalesce(attr["translate"] == "no", F.lit(False)) | F.coalesce("editable", F.lit(False))),
        "included": ~F.col("limited") | F.col("inside") | F.col("above"),
    })
    n = n.withColumns({
        "excluded": F.col("off_limits") | F.col("hidden") | F.col("element") & F.col("skip_hit"),
        "stopped": F.col("element") & (_in(LEFT_OUT) | F.col("skip_hit") | F.col("off_limits") | F.col("in_editor") | attr[DONE_ATTR].isNotNull() | ~F.col("included") & ~F.col("hosts") & ~F.col("host_below")),
        "closed": F.col("element") & (_in(NEVER) | F.col("tag").contains("-") & ~F.col("has_text")),
    })
    n = nearest(n, F.when(F.col("closed"), F.col("pre")), "_wall").withColumn("_wall", F.coalesce("_wall", F.lit(-1)))
    block = F.col("element") & ~_in(INLINE) & ~F.col("closed") & ~F.col("inline")
    n = n.withColumn("holds_block", following(block, ["tree", "_wall"], False) <= F.col("last"))
    n = n.withColumn("in_run", (F.col("tag") == "#text") | F.col("element") & ~_in(NEVER) & ~F.col("holds_block") & F.col("inline"))
    return n.drop("_wall", "style", "attrs", "up_style", "up_display", "visibility", "width", "height", "seen", "gone", "closed", "above", "host_below", "in_editor", "editable")


def _readable(nodes: DataFrame) -> DataFrame:
    """Nodes with ``around`` (the innermost excluded one) and ``readable``: what is left of the text below has a letter and is more
    than one or two letters or digits."""
    n = nearest(nodes, F.when(F.col("excluded"), F.col("pre")), "around").withColumn("around", F.coalesce("around", F.lit(-1)))
    keys, text = ["tree", "around"], F.col("tag") == "#text"
    # the next text that isn't white, the ones after it, and whether its end meets the next text's beginning
    n = n.withColumns({"_solid": text & ~F.col("white"), "_letter": text & F.col("text").rlike("\\p{L}")})
    after = Window.partitionBy("page", *keys, text).orderBy("pre")
    n = n.withColumns({"_next": F.lead("pre").over(after), "_text": F.lead("text").over(after), "_then": following(F.col("_solid"), keys, False)})
    n = n.withColumn("_third", F.when(F.col("_solid"), F.lead("_then").over(Window.partitionBy("page", *keys, "_solid").orderBy("pre"))))
    short = F.struct(
        F.col("pre"),
        F.col("text").rlike(f"^[{SPACE}]*[a-zA-Z0-9]{{1,2}}[{SPACE}]*\\z").alias("one"),
        F.col("_then").alias("then"),
        (F.col("text").rlike(f"^[{SPACE}]*[a-zA-Z0-9]\\z") & F.coalesce(F.col("_text").rlike(f"^[a-zA-Z0-9][{SPACE}]*\\z"), F.lit(False))).alias("two"),
        F.coalesce("_next", F.lit(FAR)).alias("next"),
        F.coalesce("_third", F.lit(FAR)).alias("third"),
    )
    back = Window.partitionBy("page", *keys).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"_s": F.last(F.when(F.col("_solid"), short), ignorenulls=True).over(back), "_l": following(F.col("_letter"), keys, True)})
    few = F.col("_s.one") & (F.col("_s.then") > F.col("last")) | F.col("_s.two") & (F.col("_s.next") <= F.col("last")) & (F.col("_s.third") > F.col("last"))
    return n.withColumn("readable", (F.col("_l") <= F.col("last")) & ~F.coalesce(few, F.lit(False))).drop("_solid", "_letter", "_next", "_text", "_then", "_third", "_s", "_l")


def _families(nodes: DataFrame) -> DataFrame:
    """Each node twice: as the head of its family and, not the root, as one of its parent's."""
    roles = F.array(F.struct(F.col("pre").alias("family"), F.lit(True).alias("head")), F.struct(F.col("parent").alias("family"), F.lit(False).alias("head")))
    return nodes.select("*", F.explode(roles).alias("_r")).select("*", "_r.family", "_r.head").drop("_r")


def _modes(nodes: DataFrame) -> DataFrame:
    """Nodes with mode: leaf (its text or nothing), mixed (runs of text between blocks), or whole (its text, else what is below)."""
    rows = _families(nodes).withColumn("_tree", F.when(~F.col("head"), F.col("tree")))
    order = Window.partitionBy("page", "family", "_tree").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    pair = ~F.col("head") & (F.col("tag") == "br") & F.coalesce(F.last(F.when(~F.col("white"), F.col("tag")), ignorenulls=True).over(order) == "br", F.lit(False))
    rows = rows.withColumn("_pair", F.when(pair, F.col("tree")))
    # of the family's two line breaks, those of the head's own tree count
    own = F.array_contains(F.collect_set("_pair").over(Window.partitionBy("page", "family")), F.col("tree"))
    rows = rows.withColumn("_own", own).where("head")
    mode = F.when(_in(LEAVES) & ~F.col("holds_block"), "leaf").when(F.col("holds_block") | F.col("_own"), "mixed").otherwise("whole")
    taken = F.col("included") & ~F.col("hidden") & F.col("readable")
    return rows.withColumns({"mode": mode, "taken": taken}).drop("_tree", "_pair", "_own", "family", "head")


def _parts(nodes: DataFrame) -> DataFrame:
    """Nodes with what their parent makes of them: passed (it is walked), and for a run's node the run, its part, whether the part is a block
    and its first node."""
    rows = _families(nodes)
    head = F.first(F.when(F.col("head"), F.struct("mode", "taken", "tree", "tag", "inside", "path", "around"))).over(Window.partitionBy("page", "family").orderBy(F.desc("head")))
    rows = rows.withColumn("up", head).where("not head")
    light = F.col("up").isNotNull() & (F.col("tree") == F.col("up.tree"))
    kids = Window.partitionBy("page", "family", "tree").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    runs = Window.partitionBy("page", "family", "tree", "_run").orderBy("pre")
    so_far, before = runs.rowsBetween(Window.unboundedPreceding, 0), runs.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.sum((F.col("element") & ~F.col("in_run")).cast("int")).over(kids))
    rows = rows.withColumn("_soft", F.col("in_run") & ((F.col("tag") == "br") | F.col("white"))).withColumn("_solid", F.col("in_run") & ~F.col("_soft"))
    rows = rows.withColumn("_brs", F.sum((F.col("in_run") & (F.col("tag") == "br")).cast("int")).over(so_far))
    rows = rows.withColumn("_cut", F.col("_solid") & F.coalesce(F.col("_brs") - F.last(F.when(F.col("_solid"), F.col("_brs")), ignorenulls=True).over(before) >= 2, F.lit(False)))
    rows = rows.withColumn("_part", F.sum(F.col("_cut").cast("int")).over(so_far))
    part = Window.partitionBy("page", "family", "tree", "_run", "_part")
    ends = F.struct(F.min(F.when(F.col("_solid"), F.col("pre"))).over(part).alias("first"), F.max(F.when(F.col("_solid"), F.col("pre"))).over(part).alias("last"))
    rows = rows.withColumn("_ends", ends)  # line breaks at the ends of a part are not of it
    found = F.col("in_run") & F.col("element") & F.coalesce(F.col("pre").between(F.col("_ends.first"), F.col("_ends.last")), F.lit(False))
    alone = (F.sum(F.col("_solid").cast("int")).over(part) == 1) & (F.sum((F.col("_solid") & F.col("element")).cast("int")).over(part) == 1)
    opens = F.coalesce(F.max(found & F.col("stateful")).over(part), F.lit(False))
    wanted = ~F.col("limited") | F.col("up.inside") | F.coalesce(F.max(found & F.col("included")).over(part), F.lit(False))
    first = F.min(F.when(F.col("_solid"), F.struct("pre", "nth"))).over(part)
    rows = rows.withColumns({"_walks": alone | F.col("up.tag").contains("-") | opens, "_wanted": wanted, "first": first})
    mixed = light & (F.col("up.mode") == "mixed")
    passed = (
        F.when(F.col("parent") < 0, True)
        .when(~F.col("element"), False)
        .when(~light, True)
        .when(F.col("up.mode") == "leaf", False)
        .when(F.col("up.mode") == "mixed", ~F.col("in_run") | F.col("_walks"))
        .otherwise(~F.col("up.taken"))
    )
    block = mixed & F.col("in_run") & ~F.col("_walks") & F.col("_wanted") & F.col("first").isNotNull()
    return rows.withColumns({"passed": passed, "run_block": block}).drop("_run", "_soft", "_solid", "_brs", "_cut", "_part", "_ends", "_walks", "_wanted", "family", "head")


def node_blocks(pages: DataFrame) -> DataFrame:
    """page_id, html and optionally skip and include to page_id, block_ord, tag, node_path, text and synthetic: the blocks of
    ``extract_blocks``, from the table of nodes. Pages whose styles may keep line breaks are walked.

    Null and empty pages have no blocks; null ids and repeated rows are pages of their own. A page is one key of the windows, which
    stream its nodes in order; the text of a block is put together in one row.
    """
    keeps = F.coalesce(F.col("html").rlike(KEEPS_LINES), F.lit(False))
    n = _parts(_modes(_readable(facts(page_nodes(pages.where(~keeps))))))
    # walked: no node around was passed over or stopped; a run's nodes are passed over, so their parent is asked
    ends = F.max(F.when(~F.col("passed") | F.col("stopped"), F.col("last"))).over(Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_open", ~F.coalesce(ends >= F.col("pre"), F.lit(False)))
    own = F.col("_open") & F.col("passed") & ~F.col("stopped") & F.col("mode").isin("leaf", "whole") & F.col("taken")
    n = n.withColumns({"_own": own, "_run": F.col("_open") & F.col("run_block")})
    anchor = F.when(
        F.col("_own"), F.struct(F.col("pre").alias("at"), "last", "tag", F.col("path").alias("node_path"), F.lit(False).alias("synthetic"), "around")
    ).when(
        F.col("_run"), F.struct(F.col("first.pre").alias("at"), "last", F.lit("font").alias("tag"), F.concat("up.path", F.lit("#"), F.col("first.nth")).alias("node_path"), F.lit(True).alias("synthetic"), F.col("up.around").alias("around"))
    )
    n = n.withColumn("a", F.last(anchor, ignorenulls=True).over(Window.partitionBy("page", "tree").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)))
    texts = n.where((F.col("tag") == "#text") & (F.col("a.last") >= F.col("pre")) & (F.col("around") == F.col("a.around")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda t: t["text"]), "")
    blocks = texts.groupBy("page", F.col("a.at").alias("at")).agg(F.first("page_id").alias("page_id"), F.first(F.struct("a.tag", "a.node_path", "a.synthetic")).alias("b"), F.regexp_replace(joined, f"^[{SPACE}]+|[{SPACE}]+\\z", "").alias("text"))
    blocks = blocks.where(F.col("text").rlike("\\p{L}") & ~F.col("text").rlike("^[a-zA-Z0-9]{1,2}\\z"))
    order = (F.row_number().over(Window.partitionBy("page").orderBy("at")) - 1).alias("block_ord")
    columns = ["page_id", "block_ord", "tag", "node_path", "text", "synthetic"]
    table = blocks.select("page_id", order, "b.tag", "b.node_path", "text", "b.synthetic")
    return table.unionByName(extract_blocks(pages.where(keeps)).select(*columns))
