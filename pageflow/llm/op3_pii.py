"""Operator 3: personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans; those always stay. A bidirectional LSTM over characters with a linear-chain CRF, written
and trained in numpy, adds spans in other forms (grouped otherwise, without a country code and so on). It is trained
on labelled spans: the base spans of at most about TRAIN_TEXTS texts (the documented bound), taken by a hash over all
rows, and written variants of the four kinds set in their surroundings, with numbers that are no personal data between. Copies count once in the sample, and places are taken by a hash.

Every kind of span holds a mark: a digit, an at sign or an at in brackets. A window without any would decode to no span
under that constraint, so overlapping windows are laid over the stretches around marks, wherever in a text they stand.
Each window is decoded; the spans of all windows of a text are then reconciled globally: those cut by an inner edge of a
window give way to the neighbour's, which has them whole up to LONGEST characters; one that does not hold what its kind needs
(form, check digits, number ranges) grows to the run of its form around it that does, or goes; and of overlapping ones the set with the greatest sum of window scores stays. Added
spans that overlap base spans go.

Null and empty texts have no spans. Repeated rows get repeated results, null ids are kept, extra columns are not read;
an empty table trains on written variants alone and returns nothing. Memory: one portion of a batch and one batch of
windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.batches import held, id_and_text, map_portions, portions
from pageflow.session import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]  # kind, start, end

# --- base patterns. Each is written so that no start inside a failed run is tried again: one pass over any text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: No span of any kind is without one of these.
MARK = r"[0-9@]|[\[(](?:at|AT)[\])]"
_MARK = re.compile(MARK)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_DOT = r" ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?"
_LOOSE = {
    "email": re.compile(rf"[\w%+-]+(?:\.[\w%+-]+)* ?(?:@|\[(?:at|AT)\]|\((?:at|AT)\)) ?[\w-]+(?:{_DOT}[\w-]+)+"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9](?:[ ._/-]{0,2}[0-9])+"),
    "phone": re.compile(r"(?:\+ ?)?[(]?[0-9](?:[ ()./-]{0,3}[0-9])+"),
}


def plausible(kind: str, s: str) -> bool:
    """What an added span must hold: its kind's form, numbers in range, check digits."""
    if len(s) > LONGEST or not _LOOSE[kind].fullmatch(s):
        return False
    d = digits_of(s)
    if kind == "ip":
        return all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    # a plain number is no phone number, nor is one with a decimal point
    return kind == "email" or 10 <= len(d) <= 15 and sum(not c.isdigit() for c in s) >= 2


def whole(kind: str, text: str, a: int, b: int) -> Span:
    """A span that the model found: as it is if it holds what its kind needs, else the run of its kind's form, or of a card's, around it that does."""
    if plausible(kind, text[a:b]):
        return kind, a, b
    low = max(0, a - LONGEST)
    near = text[low : b + LONGEST]
    for k in dict.fromkeys((kind, "card") if kind != "email" else (kind,)):
        for m in _LOOSE[k].finditer(near):
            if m.start() < b - low and m.end() > a - low and plausible(k, m[0]):
                return k, low + m.start(), low + m.end()
    return kind, a, b


# --- the model
#: Characters with an input of their own: printable ASCII; then other letters, digits, spaces, the rest, padding.
ALPHABET, PAD = 95 + 4, 99
#: Tags: none, then a first and an inner tag for each kind.
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 12, 16
#: Characters of the longest span that is added; of a window, and from one window to the next, so that each such span lies
#: whole in one; around a mark, so that every span with the mark lies between.
LONGEST, WINDOW, STRIDE, MARGIN = 64, 112, 46, 64
#: The bounds of training: texts, places of each that are cut out, windows of texts and of written values, their characters, steps, windows of one.
TRAIN_TEXTS, PLACES, TRAIN_WINDOWS, TRAIN_WIDTH, STEPS, BATCH, SEED = 2000, 4, 1500, 80, 600, 96, 7


def codes(text: str) -> np.ndarray:
    n = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.full(len(n), 98)
    ascii_ = (n >= 32) & (n < 127)
    out[ascii_] = n[ascii_] - 32
    for i in np.flatnonzero(~ascii_):
        c = text[i]
        out[i] = 95 if c.isalpha() else 96 if c.isdigit() else 97 if c.isspace() else 98
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Bidirectional LSTM and CRF; arrays are time, batch, feature."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": r(ALPHABET + 1, EMBED) * 3, "O": r(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        # both directions side by side: forwards, backwards
        self.p |= {"W": r(EMBED + HIDDEN, 2, 4 * HIDDEN).transpose(1, 0, 2).copy(), "c": np.zeros((2, 1, 4 * HIDDEN), np.float32)}
        self.p["c"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.forbidden = np.zeros((TAGS, TAGS), np.float32)  # an inner tag follows its own kind only
        for k in range(len(KINDS)):
            self.forbidden[[t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4

    def _lstm(self, x: np.ndarray, keep: bool):
        """x: direction, time, batch, feature; the second direction has its time turned."""
        steps, own = x.shape[1], np.ascontiguousarray(self.p["W"][:, EMBED:])
        pre = x @ self.p["W"][:, None, :EMBED] + self.p["c"][:, None]
        h = s = np.zeros((2, x.shape[2], HIDDEN), pre.dtype)
        out, trace = np.empty((*x.shape[:3], HIDDEN), pre.dtype), []
        for t in range(steps):
            g = pre[:, t] + h @ own
            gates = _sigmoid(g[:, :, : 3 * HIDDEN])
            i, f, o = (gates[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            u = np.tanh(g[:, :, 3 * HIDDEN :])
            before, s = s, f * s + i * u
            th = np.tanh(s)
            h = out[:, t] = o * th
            if keep:
                trace.append((gates, i, f, o, u, before, th))
        return out, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: codes, time by batch."""
        e = self.p["E"][x]
        e = np.stack([e, e[::-1]])
        out, trace = self._lstm(e, keep)
        h = np.concatenate([out[0], out[1, ::-1]], axis=2)
        return h @ self.p["O"] + self.p["o"], (e, h, out, trace)

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradients."""
        em, (e, h, out, trace) = self.emissions(x, keep=True)
        steps, batch, _ = em.shape
        T = self.p["T"] + self.forbidden
        # forwards and backwards over probabilities, scaled at each step; c holds the scales
        top = em.max(axis=2, keepdims=True)
        A, w = np.exp(T), np.exp(em - top)
        alpha, beta, c = np.empty_like(em), np.ones_like(em), np.empty((steps, batch, 1), em.dtype)
        for t in range(steps):
            a = w[t] if not t else (alpha[t - 1] @ A) * w[t]
            c[t] = a.sum(axis=1, keepdims=True) + 1e-30
            alpha[t] = a / c[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = ((w[t + 1] * beta[t + 1]) @ A.T) / c[t + 1]
        z = (np.log(c) + top).sum(axis=(0, 2))
        rows = np.arange(batch)
        gold = em[np.arange(steps)[:, None], rows, tags].sum(axis=0) + T[tags[:-1], tags[1:]].sum(axis=0)
        d_em = alpha * beta
        d_em[np.arange(steps)[:, None], rows, tags] -= 1
        d_T = A * (alpha[:-1].reshape(-1, TAGS).T @ (w[1:] * beta[1:] / c[1:]).reshape(-1, TAGS))
        np.subtract.at(d_T, (tags[:-1], tags[1:]), 1)
        d_em /= batch
        g = {"T": d_T / batch, "O": h.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, TAGS), "o": d_em.sum(axis=(0, 1))}
        d_h = d_em @ self.p["O"].T
        d_out = np.stack([d_h[:, :, :HIDDEN], d_h[::-1, :, HIDDEN:]])
        W, d_g = self.p["W"], np.empty((2, steps, batch, 4 * HIDDEN), em.dtype)
        back = np.ascontiguousarray(W[:, EMBED:].transpose(0, 2, 1))
        dh_next = ds_next = np.zeros((2, batch, HIDDEN), em.dtype)
        for t in range(steps - 1, -1, -1):
            gates, i, f, o, u, before, th = trace[t]
            dh = d_out[:, t] + dh_next
            ds = dh * o * (1 - th * th) + ds_next
            d_gates = np.concatenate([ds * u, ds * before, dh * th], axis=2) * gates * (1 - gates)
            d_g[:, t] = np.concatenate([d_gates, ds * i * (1 - u * u)], axis=2)
            dh_next, ds_next = d_g[:, t] @ back, ds * f
        h_before = np.concatenate([np.zeros_like(out[:, :1]), out[:, :-1]], axis=1)
        flat = lambda a: a.reshape(2, steps * batch, -1)
        g |= {"W": np.concatenate([flat(e), flat(h_before)], axis=2).transpose(0, 2, 1) @ flat(d_g), "c": flat(d_g).sum(axis=1, keepdims=True)}
        d_e = d_g @ W[:, None, :EMBED].transpose(0, 1, 3, 2)
        d_e = (d_e[0] + d_e[1, ::-1]).reshape(-1, EMBED)
        g["E"] = np.stack([np.bincount(x.ravel(), d_e[:, k], ALPHABET + 1) for k in range(EMBED)], axis=1).astype(em.dtype)
        return float((z - gold).mean()), g

    def fit(self, windows: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> float:
        """Adam over random batches; the last loss."""
        rng, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        xs, ys = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])
        for step in range(1, steps + 1):
            at = rng.integers(0, len(xs), batch)
            loss, g = self.gradients(xs[at].T, ys[at].T)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                self.p[k] = (self.p[k] - rate * (1 - step / steps * 0.9) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of windows (time by batch), and by how much each character's emission prefers its tag to none."""
        em, _ = self.emissions(x)
        T = self.p["T"] + self.forbidden
        best = em[0].copy()
        best[:, 2::2] = -1e4  # no window begins inside
        came = np.empty(em.shape, np.int8)
        for t in range(1, len(em)):
            all_ = best[:, :, None] + T
            came[t] = all_.argmax(axis=1)
            best = all_.max(axis=1) + em[t]
        tags = np.empty(x.shape, np.int64)
        rows = np.arange(x.shape[1])
        tags[-1] = best.argmax(axis=1)
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = came[t][rows, tags[t]]
        return tags, em[np.arange(len(em))[:, None], rows, tags] - em[:, :, 0]


# --- labelled spans to train on
def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def written(kind: str, rng) -> str:
    """A made-up value of a kind in one of its usual forms."""
    d, pick = (lambda n: _digits(rng, n)), (lambda *o: o[rng.integers(len(o))])
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwxz"), int(rng.integers(2, 9))))
    if kind == "email":
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "), (" [at] ", "."), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "))
        name = word() + pick("", "", ".", "_", "-", "+") + pick(word(), d(2), "")
        return name.strip("._-+") + at + dot.join([word(), *pick([], [], [word()]), pick("com", "org", "net", "de", "io")])
    if kind == "ip":
        return pick(".", ".", " . ", "[.]", "(.)", "[.]").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        groups = pick((4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
        body = d(sum(groups) - 1)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick("", " ", "-", ".", ".", "_", "_", "/", "/", "  ")
        return sep.join(body[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))
    three, four = lambda: pick("2", "3", "4", "5", "6", "7", "8", "9") + d(2), lambda: d(4)
    area, mid, end = three(), three(), four()
    return pick(f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"({area}) {mid} {end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"{area} {mid} {end}", f"({area}){mid}-{end}", f"1-{area}-{mid}-{end}", f"+49 {area} {mid} {end}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {area} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"0{d(3)}-{d(3)}-{d(4)}", f"{area}/{mid}-{end}")


def harmless(rng) -> str:
    """Numbers and signs that are no personal data."""
    d, pick = (lambda n: _digits(rng, n)), (lambda *o: o[rng.integers(len(o))])
    n = int(rng.integers(2, 7))
    return pick(
        d(4), d(2) + "." + d(1), f"version {d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", "".join(rng.choice(list("0123456789abcdef"), 32)), f"${d(3)}.{d(2)}", f"{d(1)},{d(3)}", f"{d(1)},{d(3)},{d(3)}",
        "AK" + "".join(rng.choice(list("ABCDEFGHIJ0123456789"), 18)), "@" + "".join(rng.choice(list("abcdefgh"), 6)), d(int(rng.integers(5, 9))), d(int(rng.integers(9, 20))), f"{d(2)}:{d(2)}:{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)} {d(2)}:{d(2)}:{d(2)}", f"20{d(2)}-20{d(2)}",
        " ".join(d(int(rng.integers(1, 5))) for _ in range(n)), ", ".join(d(int(rng.integers(1, 4))) for _ in range(n)), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"No. {d(3)}-{d(2)}", f"({d(1)}) {d(3)}", f"{d(3)} @ {d(2)}", f"[{d(2)}]", f"{d(1)}.{d(6)}", f"{d(3)}.{d(3)} {d(3)}.{d(3)}",
    )


def training_windows(texts: list[str], rng, n: int = TRAIN_WINDOWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows with tags: n at most around the marks of texts, by their base spans, and n around written values and harmless ones."""

    def window(text: str, spans: list[Span], start: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.full(TRAIN_WIDTH, PAD), np.zeros(TRAIN_WIDTH, np.int64)
        part = text[start : start + TRAIN_WIDTH]
        x[: len(part)] = codes(part)
        for kind, a, b in spans:
            if a >= start and b <= start + TRAIN_WIDTH and not y[a - start : b - start].any():
                y[a - start : b - start] = 2 + 2 * KINDS.index(kind)
                y[a - start] -= 1
        return x, y

    out = []
    for text in texts:
        spans = base_spans(text)
        marks = [m.start() for m in _MARK.finditer(text)]
        for at in rng.choice(marks, min(PLACES, len(marks)), replace=False).tolist() if marks else []:
            start = max(0, at - int(rng.integers(4, TRAIN_WIDTH - 30)))
            # spans that the window cuts would teach the wrong thing
            if not any(a < start < b or a < start + TRAIN_WIDTH < b for _, a, b in spans):
                out.append(window(text, spans, start))
    if len(out) > n:
        out = [out[i] for i in rng.choice(len(out), n, replace=False)]
    plain = [s for t in texts for s in re.split(r"[0-9@]+", t) if len(s) > 40] or ["the quick brown fox jumps over the lazy dog and runs along the old river bank. "]
    for _ in range(n):
        around = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, len(around) - 50)))
        before, after = around[at : at + int(rng.integers(0, 30))].rstrip(), around[at + 20 : at + 80]
        kind = KINDS[rng.integers(len(KINDS))] if rng.random() < 0.6 else None
        value = written(kind, rng) if kind else harmless(rng)
        before += "" if not before else rng.choice([" ", " ", ": ", " (" if kind == "email" else " "])
        text = before + value + rng.choice([" ", ". ", ", ", "\n"]) + after
        out.append(window(text, [(kind, len(before), len(before) + len(value))] if kind else [], 0))
    return out


def training_texts(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """text: surroundings of marks, PLACES at most from each of about ``limit`` different texts, taken by a hash over all rows."""
    marked = id_and_text(docs, id_col, text_col).where(F.col("text").rlike(MARK)).select("text", F.xxhash64("text").alias("key"))
    n = marked.count()
    found = F.regexp_extract_all("text", F.lit(rf"(?s).{{0,{WINDOW}}}(?:{MARK}).{{0,{WINDOW}}}"), F.lit(0))
    # different places of a text, not its beginning
    places = F.slice(F.array_sort(F.transform(found, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("text")))), 1, PLACES)
    some = marked.where(F.pmod("key", F.lit(1_000_000)) * n < limit * 1_000_000)
    # copies are one text
    return some.select("key", places.alias("places")).groupBy("key").agg(F.first("places").alias("places")).select(F.explode("places.text").alias("text")).limit(2 * PLACES * limit)


def train(docs: DataFrame, limit: int = TRAIN_TEXTS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Tagger:
    """A tagger from the base spans of about ``limit`` texts that hold a mark, and from written values."""
    rows = training_texts(docs, limit, id_col, text_col).toPandas()["text"].sort_values().tolist()  # bounded
    rng = np.random.default_rng(seed)
    out = Tagger(seed)
    out.fit(training_windows(rows, rng), seed=seed)
    return out


# --- windows, decoding, reconciliation
def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows over the stretches around marks: every span of LONGEST characters with a mark lies whole in one."""
    out: list[int] = []
    low = high = -1

    def stretch() -> range:
        return range(low, max(low + 1, high - (WINDOW - STRIDE)), STRIDE)

    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a <= high:
            high = b
        else:
            out += stretch() if high >= 0 else []
            low, high = a, b
    return out + list(stretch()) if high >= 0 else out


def reconcile(text: str, found: list[tuple[float, str, int, int]], base: list[Span]) -> list[Span]:
    """Of the windows' spans, the non-overlapping set of the greatest score in sum that leaves base spans alone."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return i == 0 or reach[i - 1] <= a

    score: dict[Span, float] = {}
    for s, kind, a, b in found:
        score[kind, a, b] = score.get((kind, a, b), 0.0) + s
    items = sorted(((b, a, kind, s) for (kind, a, b), s in score.items() if s > 0 and free(a, b) and plausible(kind, text[a:b])))
    best, ends = [(0.0, None, 0)], []
    for i, (b, a, kind, s) in enumerate(items):
        j = bisect_right(ends, a)  # the last that ends before this one starts
        best.append(max((best[-1][0], None, i), (best[j][0] + s, i, j), key=lambda x: x[0]))
        ends.append(b)
    out, at = [], len(items)
    while at:
        _, i, j = best[at]
        if i is not None:
            b, a, kind, _ = items[i]
            out.append((kind, a, b))
        at = j
    return out


def find_spans(texts: list[str | None], model: Tagger, at_once: int = 512) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    places = [(i, s) for i, t in enumerate(texts) if t for s in window_starts(t)]
    found: dict[int, list[tuple[float, str, int, int]]] = {}
    for k in range(0, len(places), at_once):
        some = places[k : k + at_once]
        x = np.full((WINDOW, len(some)), PAD)
        for n, (i, s) in enumerate(some):
            part = codes(texts[i][s : s + WINDOW])
            x[: len(part), n] = part
        tags, margin = model.decode(x)
        for n in np.flatnonzero(tags.any(axis=0)):
            i, s = some[n]
            size, own = len(texts[i]), tags[:, n]
            for a in np.flatnonzero(own % 2 == 1).tolist():
                kind, b = own[a] // 2, a + 1
                while b < WINDOW and own[b] == own[a] + 1:
                    b += 1
                if b == WINDOW and s + b < size or a == 0 and s > 0:
                    continue  # an inner edge cuts it; the next window has it whole
                found.setdefault(i, []).append((float(margin[a:b, n].mean()), *whole(KINDS[kind], texts[i], s + a, s + b)))
    out = []
    for i, t in enumerate(texts):
        added = reconcile(t, found[i], base[i]) if i in found else []
        out.append((base[i], sorted(base[i] + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _mapped(docs: DataFrame, model: Tagger, make, schema: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers
    return map_portions(id_and_text(docs, id_col, text_col), lambda batch: make(batch, shared.value), schema)


def detect(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans of every row."""

    def make(batch: pa.RecordBatch, tagger: Tagger) -> pa.RecordBatch:
        found = find_spans(batch.column("text").to_pylist(), tagger)
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
        sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, pa.array([joined(a) for _, a in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return _mapped(docs, model, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", id_col, text_col)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or union of overlapping ones, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, end, open_end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= open_end:
            out += [text[end:a] if a > end else "", f"<{kind}>"]
        open_end = end = max(end, b)
    return "".join([*out, text[end:]])


def mask_column(docs: DataFrame, model: Tagger, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with the personal data of a text column masked, all other columns kept; count_col, if there, is counted anew.

    Null texts stay null with a null count, empty ones empty with 0; repeated rows and null ids stay; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns
    counted = names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("pii",), object)  # caches of earlier stages go
        for batch in batches:
            for part in portions(batch, text_col):
                texts = part.column(at).to_pylist()
                new = [masked(t, a) for t, (_, a) in zip(texts, find_spans(texts, shared.value))]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in new], part.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
