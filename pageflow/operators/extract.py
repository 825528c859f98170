"""Readable text blocks of HTML pages.

The tree of a page is walked once. Facts that many decisions need (does an element hold a block, is it laid out in
line, is it hidden, does it keep lines, has it a text, is it inside or above an included part) are noted once per element, and
the tree is no deeper than a browser's, so a page takes time in proportion to its size, however its tags nest. Layout is
static: inline styles and the usual display of each tag; style sheets are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.functions.html import DEPTH, Node, asks_attributes, compile_selector, matches, parse, valid_selector
from pageflow.session import portions, ship

# How tags are treated.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i input ins kbd label mark nobr q rp rt ruby s samp small span strong sub sup tt u var wbr img".split())
NEVER = frozenset("script style textarea svg template noscript iframe math select option video audio canvas pre time".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote figcaption caption".split())
LEFT_OUT = frozenset(["nav", "footer"])
INLINE_BLOCK = frozenset(["button", "select", "meter", "progress"])
# Parts of rich-text editors.
EDITORS = [
    '.RichEditor-root:has([contenteditable="true"])',
    '.DraftEditor-root:has([contenteditable="true"])',
    '[data-lexical-editor][contenteditable="true"]',
    '.ProseMirror[contenteditable="true"]',
    '[data-slate-editor][contenteditable="true"]',
    '.ql-editor[contenteditable="true"]',
    '.ck-editor:has([contenteditable="true"])',
    '.tox-editor-container:has([contenteditable="true"])',
    ".cm-editor",
    ".monaco-editor",
]
RESULT_CLASS, DONE_ATTR = "pageflow-result", "data-pageflow-done"

WHITE = "\t\n\x0b\x0c\r \xa0                　﻿"
BLANK_LINE = re.compile(f"\n[{WHITE.replace(chr(10), '')}]*\n")
SEPARATOR = re.compile(f"([{WHITE}]*\n[{WHITE.replace(chr(10), '')}]*\n[{WHITE}]*)")
SHORT = re.compile(r"[a-zA-Z0-9]{1,2}")

SCHEMA = "page_id long, block_ord int, tag string, node_path string, text string, synthetic boolean, target_path string, tail_block boolean, before_path string"


NO_STYLE: dict[str, str] = {}


def is_white(n: Node) -> bool:
    return n.tag == "#text" and not n.text.strip(WHITE)


class Walk:
    """The blocks of one page, as (tag, path, text, synthetic, target path, whether a block ends the target, what the result goes before)."""

    def __init__(self, root: Node, skip: list[str], include: list[str]):
        self.root, self.blocks, self.facts = root, [], {}
        self.skip = [compile_selector(s) for s in skip]
        self.skip_bare = [s for s in self.skip if not asks_attributes(s)]
        self.editors = [compile_selector(s) for s in EDITORS]
        self.included = self._included(root, [compile_selector(s) for s in include]) if include else None
        self.walk(root)

    def _included(self, root: Node, include: list[tuple]) -> dict[int, bool]:
        """Elements inside an included part (true), or above one or above a shadow tree (false)."""
        out: dict[int, bool] = {}
        stack = [(root, False)]
        while stack:
            n, inside = stack.pop()
            inside = inside or any(matches(n, s) for s in include)
            if inside:
                out[id(n)] = True
                p = n.parent
                while p is not None and id(p) not in out:
                    out[id(p)] = False
                    p = p.parent
            stack += [(k, inside) for k in [*n.elements(), *(s for s in n.shadow if s.is_element)]]
        return out

    def fact(self, n: Node, name: str, find):
        known = self.facts.setdefault(id(n), {"node": n})
        if name not in known:
            known[name] = find(n)
        return known[name]

    def style(self, n: Node) -> dict[str, str]:
        if "style" not in n.attrs:
            return NO_STYLE
        return self.fact(n, "style", lambda n: {k.strip().lower(): v.strip().lower() for k, _, v in (p.partition(":") for p in n.attrs.get("style", "").split(";")) if v})

    def inline(self, n: Node) -> bool:
        """Laid out in line."""

        def find(n: Node) -> bool:
            if own := self.style(n).get("display"):
                return own.startswith("inline")
            if n.parent is not None and n.parent.is_element and re.search("flex|grid", self.style(n.parent).get("display", "")):
                return False
            return n.tag in INLINE or n.tag in INLINE_BLOCK

        return self.fact(n, "inline", find)

    def holds_block(self, n: Node) -> bool:
        """A block below, seen through inline tags and blocks laid out in line; an empty custom element is none."""

        def counts(k: Node) -> bool:
            if k.tag in NEVER:
                return False
            if k.tag not in INLINE:
                if "-" in k.tag and not self.has_text(k):
                    return False
                if not self.inline(k):
                    return True
            return self.holds_block(k)

        return self.fact(n, "holds_block", lambda n: any(counts(k) for k in n.elements()))

    def in_run(self, n: Node) -> bool:
        """May stand in a run of text."""
        return n.tag == "#text" or n.is_element and n.tag not in NEVER and not self.holds_block(n) and self.inline(n)

    def all_text(self, n: Node) -> str:
        out, stack = [], [n]
        while stack:
            n = stack.pop()
            if n.tag == "#text":
                out.append(n.text)
            elif n.tag != "#comment":
                stack += n.kids[::-1]
        return "".join(out)

    def has_text(self, n: Node) -> bool:
        """A text that isn't white, in it or below."""
        if n.tag == "#text":
            return bool(n.text.strip(WHITE))
        return n.tag != "#comment" and self.fact(n, "has_text", lambda n: any(map(self.has_text, n.kids)))

    def hidden(self, n: Node) -> bool:
        def gone(n: Node) -> bool:  # not laid out, with all below
            return n.is_element and (self.style(n).get("display") == "none" or "hidden" in n.attrs) or n.parent is not None and self.fact(n.parent, "gone", gone)

        def unseen(n: Node) -> bool:
            own = self.style(n).get("visibility") if n.is_element else None
            return own in ("hidden", "collapse") if own else n.parent is not None and self.fact(n.parent, "unseen", unseen)

        tiny = any((m := re.fullmatch(r"([0-9.]+)(?:px)?", self.style(n).get(side, ""))) and float(m[1]) <= 1 for side in ("width", "height"))
        return tiny or self.fact(n, "gone", gone) or self.fact(n, "unseen", unseen)

    def editable(self, n: Node) -> bool:
        def find(n: Node) -> bool:
            own = n.attrs.get("contenteditable")
            if own is not None and own != "inherit":
                return own.lower() != "false"
            return n.parent is not None and self.fact(n.parent, "editable", find)

        return self.fact(n, "editable", find)

    def in_editor(self, n: Node) -> bool:
        def find(n: Node) -> bool:
            # all of these ask for a class or an attribute
            return n.is_element and bool(n.attrs) and any(matches(n, s) for s in self.editors) or n.parent is not None and self.fact(n.parent, "in_editor", find)

        return self.fact(n, "in_editor", find)

    def off_limits(self, n: Node) -> bool:
        """Marked as not to be translated, or a result."""
        classes = n.attrs.get("class", "").split()
        return n.tag in NEVER or "notranslate" in classes or RESULT_CLASS in classes or n.attrs.get("translate") == "no" or self.editable(n)

    def left_out(self, n: Node) -> bool:
        """By a rule."""
        return any(matches(n, s) for s in (self.skip if n.attrs else self.skip_bare))

    def skipped(self, n: Node) -> bool:
        if self.included is not None and id(n) not in self.included and not n.shadow and not any(d.shadow for d in n.below()):
            return True
        return self.left_out(n) or self.off_limits(n) or self.in_editor(n) or DONE_ATTR in n.attrs

    def text_of(self, nodes: list[Node]) -> str:
        out = []
        for n in nodes:
            if n.tag == "#text":
                out.append(n.text)
            elif n.is_element and not self.off_limits(n) and not self.hidden(n) and not self.left_out(n):
                out.append(self.text_of(n.kids))
        return "".join(out)

    def keeps_lines(self, n: Node) -> bool:
        def find(n: Node) -> bool:
            if n.is_element and (own := self.style(n).get("white-space")):
                return own.startswith("pre") or own == "break-spaces"
            return n.parent is not None and self.fact(n.parent, "keeps_lines", find)

        return self.fact(n, "keeps_lines", find)

    def has_br_pair(self, n: Node) -> bool:
        count = 0
        for k in n.kids:
            if k.tag == "br":
                count += 1
                if count == 2:
                    return True
            elif not is_white(k):
                count = 0
        return False

    # --- where a result goes
    def target(self, n: Node) -> Node:
        """Down while the only visible child is an element."""
        while True:
            seen = [k for k in n.kids if k.tag == "#text" and k.text.strip(WHITE) or k.is_element and not self.hidden(k) and self.has_text(k)]
            if len(seen) != 1 or not seen[0].is_element:
                return n
            n = seen[0]

    def ends_in_block(self, n: Node) -> bool:
        last = next((k for k in reversed(n.kids) if k.tag == "#text" and k.text.strip(WHITE) or k.is_element and self.has_text(k)), None)
        return last is not None and last.is_element and not self.inline(last)

    def before(self, n: Node) -> str | None:
        """The first of the nodes without text at the end, before which a result goes; none: at the end."""
        ref = None
        for i in range(len(n.kids) - 1, -1, -1):
            k = n.kids[i]
            if k.is_element and RESULT_CLASS in k.attrs.get("class", "").split():
                continue
            if self.has_text(k):
                break
            ref = k.path or f"{n.path}#{i}"
        return ref

    # --- the walk
    def add(self, nodes: list[Node], at: Node, synthetic: bool) -> bool:
        text = self.text_of(nodes).strip(WHITE)
        if not any(map(str.isalpha, text)) or SHORT.fullmatch(text):
            return False
        target = at if synthetic else self.target(at)
        path = f"{at.path}#{next((i for i, k in enumerate(at.kids) if k is nodes[0]), 0)}" if synthetic else at.path
        self.blocks.append(("font" if synthetic else at.tag, path, text, synthetic, target.path, self.ends_in_block(target), self.before(target)))
        return True

    def extract(self, n: Node) -> bool:
        if n.is_element and self.hidden(n) or self.included is not None and id(n) not in self.included:
            return False
        return self.add(n.kids, n, False)

    def walk(self, n: Node) -> None:
        if n.is_element and (self.skipped(n) or n.tag in LEFT_OUT):
            return
        if self.keeps_lines(n) and BLANK_LINE.search(self.all_text(n)) and not self.hidden(n):
            self.mixed(self.cut_at_blank_lines(n), True)
        elif n.tag in LEAVES and not self.holds_block(n):
            self.extract(n)
        elif self.holds_block(n) or self.has_br_pair(n):
            self.mixed(n, False)
        elif not self.extract(n):
            for k in n.elements():
                self.walk(k)
        for k in n.shadow:
            if k.is_element:
                self.walk(k)

    def cut_at_blank_lines(self, parent: Node) -> Node:
        """The parent with its inline descendants cut at blank lines, which become texts of their own directly below it."""

        def groups(n: Node) -> list[list[Node] | str]:
            """Children in groups, with the blank lines that part them."""
            out: list[list[Node] | str] = [[]]
            for k in n.kids:
                if k.tag == "#text":
                    for i, part in enumerate(SEPARATOR.split(k.text)):
                        if i % 2:
                            out += [part, []]
                        elif part:
                            out[-1].append(Node("#text", n, text=part, path=k.path))
                elif k.is_element and self.in_run(k) and not self.off_limits(k):
                    inner = groups(k)
                    if len(inner) == 1:
                        out[-1].append(k)
                        continue
                    for i, g in enumerate(inner):
                        if isinstance(g, str):
                            out += [g, []]
                        elif g:
                            part = Node(k.tag, n, {a: v for a, v in k.attrs.items() if a != "id" or not i}, path=k.path if not i else f"{k.path}~{i // 2}")
                            part.kids = g
                            out[-1].append(part)
                else:
                    out[-1].append(k)
            return out

        whole = Node(parent.tag, parent.parent, parent.attrs, path=parent.path)
        for g in groups(parent):
            whole.kids += [Node("#text", whole, text=g)] if isinstance(g, str) else g
        if self.included is not None and id(parent) in self.included:
            for d in [whole, *whole.below()]:
                self.included.setdefault(id(d), self.included[id(parent)])
        self.facts.setdefault(id(whole), {"node": whole})
        return whole

    def mixed(self, parent: Node, at_blank_lines: bool) -> None:
        """Runs of text between blocks, cut at two line breaks or blank lines; blocks are walked."""
        run: list[Node] = []
        for k in [*parent.kids, None]:
            if k is not None and self.in_run(k):
                run.append(k)
            elif k is None or k.is_element:
                for part in self.parts(run, at_blank_lines):
                    self.flush(parent, part)
                run = []
                if k is not None:
                    self.walk(k)

    def parts(self, run: list[Node], at_blank_lines: bool) -> Iterator[list[Node]]:
        part: list[Node] = []
        soft: list[Node] = []
        for k in [*run, None]:
            if k is not None and (k.tag == "br" or is_white(k)):
                soft.append(k)
                continue
            if sum(s.tag == "br" for s in soft) >= 2 or at_blank_lines and BLANK_LINE.search("".join(s.text for s in soft)):
                yield part
                part = []
            elif part:
                part += soft
            soft = []
            if k is not None:
                part.append(k)
        yield part

    def flush(self, parent: Node, part: list[Node]) -> None:
        while part and (part[-1].tag == "br" or is_white(part[-1])):
            part.pop()
        if not part:
            return
        found = [k for k in part if k.is_element]
        stateful = any("aria-expanded" in d.attrs for k in found for d in [k, *k.below()])
        if len(part) == 1 and found or "-" in parent.tag or stateful:
            for k in found:
                self.walk(k)
        elif self.included is None or self.included.get(id(parent)) or any(id(k) in self.included for k in found):
            self.add(part, parent, True)


def blocks_of(html: str | None, skip: list[str] | None = None, include: list[str] | None = None) -> list[tuple]:
    """Blocks of one page, in document order."""
    if not html:
        return []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
    return Walk(parse(html), skip or [], include or []).blocks


#: Bytes of pages whose blocks are held at once, about.
PORTION = 4_000_000


def valid(selectors: list[str] | None) -> list[str]:
    """Selectors that can be compiled; loaded rules have no others."""
    return [s for s in selectors or [] if valid_selector(s)]


def extract_blocks(pages: DataFrame) -> DataFrame:
    """page_id, html and optionally skip and include (arrays of selectors) to one row per block. One pass, no shuffle.

    Null and empty pages have no blocks; null ids and repeated rows are pages of their own. Memory: the blocks of about PORTION
    bytes of pages, one page at least.
    """
    ship(pages.sparkSession)
    arrays = [F.col(c) if c in pages.columns else F.array().cast("array<string>").alias(c) for c in ("skip", "include")]

    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, "html", PORTION):
                rows = [(i, n, *block) for i, html, s, x in zip(*(part.column(c).to_pylist() for c in ("page_id", "html", "skip", "include"))) for n, block in enumerate(blocks_of(html, valid(s), valid(x)))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html", *arrays).mapInArrow(run, SCHEMA)
