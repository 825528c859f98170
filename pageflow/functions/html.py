"""A small HTML tree and the subset of CSS selectors that site rules use."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# which open elements a start tag ends, up to the nearest of the stops
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul summary".split())
P_SCOPE = frozenset("td th caption table button html body".split())


#: Elements nest so deep at most: further ones become siblings, as browsers have it (a fixed value), so a page of tags that
#: are never closed costs no more than another one of its size.
DEPTH = 512


class Node:
    """An element, or a text or comment when its tag is #text or #comment.

    index is its place among its parent's kids, nth its place among the elements there, prev the element before it; last
    is its own last element.
    """

    __slots__ = ("tag", "attrs", "kids", "parent", "text", "own_path", "index", "nth", "prev", "last", "shadow")

    def __init__(self, tag: str, parent: Node | None = None, attrs: dict | None = None, text: str = "", path: str | None = None):
        self.tag, self.parent, self.attrs, self.text, self.own_path = tag, parent, attrs or {}, text, path
        self.kids: list[Node] = []
        self.shadow: list[Node] = []
        self.index = self.nth = 0
        self.prev = self.last = None

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    @property
    def path(self) -> str:
        """Indexes from the root on; written when it is asked for."""
        parts, n = [], self
        while n is not None and n.own_path is None and n.parent is not None:
            parts.append(str(n.index))
            n = n.parent
        head = n.own_path or "" if n is not None else ""
        return "/".join([head, *reversed(parts)]) if parts else head

    def put(self, node: Node) -> None:
        """Append a node."""
        node.index = len(self.kids)
        self.kids.append(node)
        if node.is_element:
            node.prev, self.last = self.last, node
            node.nth = node.prev.nth + 1 if node.prev is not None else 0

    def elements(self):
        return [k for k in self.kids if k.is_element]

    def below(self):
        """Elements under this one, in order, without shadow trees."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements()[::-1]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where in open each tag stands

    def _close_to(self, i: int) -> None:
        for n in self.open[i:]:
            self.at[n.tag].pop()
        del self.open[i:]

    def _nearest(self, tags) -> int:
        """Where the innermost open element of some tags stands; 0: nowhere."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body", "head") and self.at.get(tag):
            return
        if tag in ENDS_P and (i := self._nearest("p".split())) > self._nearest(P_SCOPE):
            self._close_to(i)
        if tag in ENDS:
            ends, stops = ENDS[tag]
            if (i := self._nearest(ends)) > self._nearest(stops - ends):
                self._close_to(i)
        parent = self.open[-1]
        if len(self.open) > DEPTH:
            parent = parent.parent
        node = Node(tag, parent, {k: v or "" for k, v in attrs})
        parent.put(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].parent is not None and tag in ("svg", "path", "use", "math"):
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        i = self._nearest([tag])
        if not i:
            return
        node = self.open[i]
        self._close_to(i)
        if tag == "template" and node.attrs.get("shadowrootmode") == "open" and node.parent.last is node:
            host = node.parent
            host.kids.remove(node)
            host.last, host.shadow = node.prev, node.kids
            for k in node.kids:
                k.own_path = k.path
            for k in node.kids:
                k.parent = host

    def _leaf(self, tag: str, text: str) -> None:
        parent = self.open[-1]
        if tag == "#text" and parent.kids and parent.kids[-1].tag == "#text":
            parent.kids[-1].text += text
        else:
            parent.put(Node(tag, parent, text=text))

    def handle_data(self, data: str) -> None:
        self._leaf("#text", data)

    def handle_comment(self, data: str) -> None:
        self._leaf("#comment", data)


def parse(html: str) -> Node:
    """The body of a page, or the whole of a fragment."""
    b = _Builder()
    b.feed(html)
    b.close()
    return next((n for n in b.root.below() if n.tag == "body"), b.root)


# --- selectors
_TOKEN = re.compile(r"""\s*([>+~])\s*|(\s+)|([A-Za-z*][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([\^*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]|:(not|has|is)\(|:(nth-child|nth-last-child)\(\s*([^()]*?)\s*\)|:(first-child|last-child|only-child)(?![\w-])""")
_NTH = re.compile(r"([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+)")


def _nth(s: str) -> tuple[int, int]:
    """a and b of an+b."""
    s = {"odd": "2n+1", "even": "2n"}.get(s.lower(), s.lower())
    m = _NTH.fullmatch(s)
    if not m:
        raise ValueError(f"selector not supported: {s!r}")
    if m[4]:
        return 0, int(m[4])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int((m[2] or "+") + (m[3] or "0"))


def _split_list(s: str) -> list[str]:
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[start:i])
            start = i + 1
    return [x.strip() for x in [*out, s[start:]]]


@lru_cache(maxsize=4096)
def compile_selector(s: str) -> tuple:
    """Alternatives, each a tuple of (combinator, tests), left to right. What is not supported raises ValueError."""
    return tuple(_compile_one(x) for x in _split_list(s))


def valid_selector(s: str | None) -> bool:
    try:
        return s is not None and bool(compile_selector(s))
    except ValueError:
        return False


def _compile_one(s: str) -> tuple:
    parts: list[tuple[str, list]] = [(" ", [])]
    i = 0
    while i < len(s):
        m = _TOKEN.match(s, i)
        if not m or m.end() == i:
            raise ValueError(f"selector not supported: {s!r}")
        i = m.end()
        if m[1] or m[2]:
            if m[1] and not parts[-1][1]:
                parts[-1] = (m[1], [])
            elif not m[2] or i < len(s):
                parts.append((m[1] or " ", []))
            continue
        tests = parts[-1][1]
        if m[3]:
            if m[3] != "*":
                tests.append(("tag", m[3].lower()))
            else:
                tests.append(("any", None))
        elif m[4]:
            tests.append(("=", ("id", m[4])))
        elif m[5]:
            tests.append(("class", m[5]))
        elif m[6]:
            tests.append((m[7] or "has-attr", (m[6].lower(), m[8] or m[9] or m[10] or "")))
        elif m[12]:
            tests.append((m[12], _nth(m[13])))
        elif m[14]:
            tests += [(k, (0, 1)) for k in {"first-child": ["nth-child"], "last-child": ["nth-last-child"]}.get(m[14], ["nth-child", "nth-last-child"])]
        else:
            depth, j = 1, i
            while j < len(s) and depth:
                depth += {"(": 1, ")": -1}.get(s[j], 0)
                j += 1
            if depth:
                raise ValueError(f"selector not supported: {s!r}")
            tests.append((f":{m[11]}", compile_selector(s[i : j - 1])))
            i = j
    if not all(t for _, t in parts):
        raise ValueError(f"selector not supported: {s!r}")
    return tuple((c, tuple(t)) for c, t in parts)


def _test(n: Node, kind: str, x) -> bool:
    if kind == "tag":
        return n.tag == x
    if kind == "any":
        return True
    if kind == "class":
        return x in n.attrs.get("class", "").split()
    if kind == ":not":
        return not matches(n, x)
    if kind == ":is":
        return matches(n, x)
    if kind == ":has":
        return any(_has(n, alternative) for alternative in x)
    if kind in ("nth-child", "nth-last-child"):
        if n.parent is None:
            return False
        a, b = x
        at = n.nth + 1 if kind == "nth-child" else n.parent.last.nth - n.nth + 1 if n.parent.last is not None else 1
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0
    value = n.attrs.get(x[0])
    if value is None:
        return False
    return kind == "has-attr" or kind == "=" and value == x[1] or bool(x[1]) and (kind == "^=" and value.startswith(x[1]) or kind == "*=" and x[1] in value)


def _fits(n: Node, steps: tuple, scope: Node | None = None) -> bool:
    """Whether n is what the steps end in; the first step hangs on scope, if there is one."""
    combinator, tests = steps[-1]
    if not all(_test(n, k, x) for k, x in tests):
        return False
    rest = steps[:-1]
    if not rest and scope is None:
        return True
    if combinator == "+":
        near = [n.prev]
    elif combinator == "~":
        near, p = [], n.prev
        while p is not None:
            near.append(p)
            p = p.prev
    elif combinator == ">":
        near = [n.parent]
    else:
        near, p = [], n.parent
        while p is not None:
            near.append(p)
            p = p.parent
    if not rest:
        return any(p is scope for p in near)
    return any(p is not None and p.is_element and _fits(p, rest, scope) for p in near)


def _has(n: Node, steps: tuple) -> bool:
    pool = n.below()
    if steps[0][0] in "+~":
        siblings = n.parent.elements() if n.parent else []
        at = next((i for i, s in enumerate(siblings) if s is n), len(siblings))
        pool = siblings[at + 1 :]
    return any(_fits(d, steps, n) for d in pool)


def asks_attributes(selector: tuple) -> bool:
    """Whether no element without attributes can match."""
    return all(any(kind in ("class", "has-attr", "=", "^=", "*=") for kind, _ in steps[-1][1]) for steps in selector)


def matches(n: Node, selector: tuple) -> bool:
    return any(_fits(n, steps) for steps in selector)
