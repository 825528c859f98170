"""Blocks from the table of nodes are those of the walk."""

import random

import test_extract

from pageflow.operators.extract import blocks_of
from pageflow.operators.nodes import facts, nearest, node_blocks, page_nodes, nodes_of

SCHEMA = "page_id long, html string, skip array<string>, include array<string>"
TAGS = "div p span b i br br br li ul h1 section x-y button a td nav script em em span".split()
ATTRS = [
    *[""] * 5, " hidden", " style='display:inline'", " style='display:block'", " style='visibility:hidden'", " style='visibility:visible'", " style='width:1px'", " style='display:flex'", " class=notranslate", " class=k",
    " contenteditable=true", " contenteditable=false", " aria-expanded=true", " data-pageflow-done", " translate=no", " class=cm-editor", " style='display:none'", " style='white-space:pre'",
]


def made_up(r: random.Random, depth: int) -> str:
    out = []
    for _ in range(r.randint(0, 5)):
        kind = r.random()
        if kind < 0.35 or not depth:
            out.append(r.choice(["a", "ab", " ", "\n", "x y", "word word", "1", "字", " b", "c ", "<!--c-->", "12 ", "q\n\nr s"]))
        elif kind < 0.42:
            out.append(f"<template shadowrootmode=open>{made_up(r, depth - 1)}</template>")
        else:
            tag = r.choice(TAGS)
            out.append(f"<{tag}{r.choice(ATTRS)}>" + ("" if tag == "br" else f"{made_up(r, depth - 1)}</{tag}>"))
    return "".join(out)


def pages() -> list[tuple]:
    mark = next(m for m in test_extract.test_blocks.pytestmark if m.name == "parametrize")
    ruled = "<div class=a><p>first part</p></div><div class=b><p>second <b class=x>bb</b></p>loose <i class=x>ii</i> one<p>third</p></div>"
    rows = [(html, [], []) for html, _ in mark.args[1]]
    rows += [(ruled, skip, include) for skip, include in (([".a"], []), ([], [".a"]), (["p"], [".b"]), ([], [".x"]), ([".x"], []), (["::no"], ["a:hover"]))]
    rows += [(html, [], []) for html in ("<div hidden>aaa<p>b b</p>ccc</div>", "<div><b>a</b><i>b</i></div><p><b>a</b> <i>b</i></p>", "text only here", "<div>" * 600 + "deep text", "<p>long " + "word " * 50_000)]
    r = random.Random(11)
    return rows + [(made_up(r, 6), r.choice([[], [], ["i"], [".k"]]), r.choice([[], [], [], [".k"], ["p"]])) for _ in range(1500)]


def test_blocks_are_those_of_the_walk(spark):
    rows = pages()
    found: dict[int, list] = {}
    for b in node_blocks(spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)).collect():
        found.setdefault(b.page_id, []).append((b.block_ord, b.tag, b.node_path, b.text, b.synthetic))
    for i, (html, skip, include) in enumerate(rows):
        skip, include = ([s for s in group if s not in ("::no", "a:hover")] for group in (skip, include))
        assert sorted(found.get(i, [])) == [(n, *b[:4]) for n, b in enumerate(blocks_of(html, skip, include))], (html, skip, include)


def test_null_ids_repeated_and_empty_pages(spark):
    rows = [(None, "<p>one one</p>"), (None, "<p>one one</p>"), (3, None), (4, ""), (5, "<p>five</p>"), (5, "<p>five</p>")]
    out = node_blocks(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as pre", "'x' as tag"))
    assert sorted((b.page_id or 0, b.block_ord, b.text) for b in out.collect()) == [(0, 0, "one one")] * 2 + [(5, 0, "five")] * 2
    assert node_blocks(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_intervals_and_what_is_inherited(spark):
    html = "<div style='visibility:hidden'><p>a<i style='visibility: visible'>b<b>c</b></i></p></div><p hidden><u>d</u></p>"
    rows = nodes_of(html, [], [])
    for at, last, parent, *_ in rows:  # intervals nest, and children lie within their parents
        assert at <= last and (parent < 0 or rows[parent][0] < at <= last <= rows[parent][1])
    nodes = page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {r.tag for r in facts(nodes).where("hidden").collect()} == {"div", "p", "u"}
    around = {r.text: r.near for r in nearest(nodes, nodes.attrs["style"], "near").where("tag = '#text'").collect()}
    assert around == {"a": "visibility:hidden", "b": "visibility: visible", "c": "visibility: visible", "d": None}


def test_one_shuffle(spark):
    """All windows part by page: nodes are exchanged once."""
    plan = node_blocks(spark.createDataFrame([(1, "<p>one one</p>")], "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Final Plan")[0].count("Exchange hashpartitioning") == 1
