"""Operator 3: personal data by fixed patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import arrow_rows

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match ends where its digits end, so no later one starts inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
_PART = re.compile(r"[A-Za-z0-9._%+@-]+")
_NUMBER = re.compile(r"\+?[0-9]+(?:[.-][0-9]+)*")
_LOCAL_PART = re.compile(r"([A-Za-z0-9._%+-]+) ?(?:\[at\]|\(at\)|\{at\}| at )")
_EDGE = ".,;:!?\"'()[]<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def in_range(address: str) -> bool:
    """Whether the four parts are at most 255, whatever zeros they begin with."""
    parts = [p.lstrip("0") or "0" for p in address.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the fixed patterns: leftmost, non-overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        else:
            # No later match can start before this sign, which no local part holds.
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if in_range(m[0]):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            d = _DIGITS.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _cut_run(at: int, run: str, longest: int = 80) -> list[tuple[int, str]]:
    """(start, token) of a run without white space. One of over ``longest`` characters is cut at the
    edges of its address characters, and a part still longer that holds no @ into its numbers."""
    if len(run.strip(_EDGE)) <= longest:
        return [(at, run)]
    out = []
    for m in _PART.finditer(run):
        if m.end() - m.start() <= longest or "@" in m[0]:
            out.append((at + m.start(), m[0]))
        else:
            out += [(at + x.start(), x[0]) for x in _NUMBER.finditer(run, m.start(), m.end())]
    return out


@dataclass
class Node:
    start: int
    stop: int
    text: str
    base: int  # kind, or -1
    cue: str = ""
    open: bool = False  # inside a match of a fixed pattern that failed its check


#: Words that name a kind, and words that name a secret: cues when they stand before a node.
CUES = {
    "email": "email e-mail mail contact write reply",
    "ip": "ip host server address addr node gateway",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "call phone tel telephone mobile cell fax ring dial",
    "secret": "token secret key password passwd hash sha id order ref build version serial",
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
_CALL = re.compile(r"\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])")
_SPELT = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+"
)


def _cue(text: str, start: int) -> str:
    """The kind that one of the two words before a node names."""
    for w in reversed(text[max(0, start - 32) : start].split()[-2:]):
        if k := _CUE_OF.get(w.strip(":=#.,;\"'()[]").lower()):
            return k
    return ""


def _failed(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Matches of the fixed number patterns that fail for their length: a longer run can hold
    entities that the leftmost match swallowed."""
    out = [(m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 19 and len(_DIGITS.sub("", m[0])) > 16]
    if "+" in text:
        out += [(m.start(), m.end()) for m in _PHONE.finditer(text) if len(_DIGITS.sub("", m[0])) > 15]
    done = {(s, e) for s, _, e in base}
    return sorted(x for x in out if x not in done)


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """The label sequence: base spans, and outside them the runs that hold an @ or at least four
    digits, groups of digits in a phone number's form, and spelt-out addresses. A run is what lies
    between white space, long ones cut into parts first. All other tokens have label O for certain
    and break no skip edge."""
    out, taken = [], 0
    held: list[Node] = []
    for s, k, e in base:
        if s >= taken:
            held.append(Node(s, e, text[s:e], k))
            taken = e
    cut = [(n.start, n.stop) for n in held]
    for m in _SPELT.finditer(text) if "at]" in text or "at)" in text or "at}" in text or " dot " in text else ():
        if not any(a < m.end() and m.start() < b for a, b in cut):
            out.append(Node(m.start(), m.end(), m[0], -1))
    cut = sorted(cut + [(n.start, n.stop) for n in out])
    at, j = 0, 0
    while True:
        m = _CUE.search(text, at)
        if not m:
            break
        p = m.start()
        while j < len(cut) and cut[j][1] <= p:
            j += 1
        if j < len(cut) and cut[j][0] <= p:
            at = cut[j][1]
            continue
        low = max(at, cut[j - 1][1] if j else 0)
        s = p
        while s > low and not text[s - 1].isspace():
            s -= 1
        high = cut[j][0] if j < len(cut) else len(text)
        call = _CALL.match(text, s + (text[s] == "(" and text[s + 1 : s + 2] == "+"), high)
        if call:
            out.append(Node(call.start(), call.end(), call[0], -1))
            at = call.end()
            continue
        e = p
        while e < high and not text[e].isspace():
            e += 1
        at = e
        for begin, piece in _cut_run(s, text[s:e]):
            lead = len(piece) - len(piece.lstrip(_EDGE))
            piece = piece.strip(_EDGE)
            if "@" in piece or sum(c.isdigit() for c in piece) >= 4:
                out.append(Node(begin + lead, begin + lead + len(piece), piece, -1))
    if out:
        gone = _failed(text, base)
        starts, reach = [a for a, _ in gone], list(accumulate((b for _, b in gone), max))
        for n in out:
            n.cue = _cue(text, n.start)
            k = bisect_right(starts, n.start) - 1
            n.open = k >= 0 and n.stop <= reach[k]
    for n in held:
        n.cue = _cue(text, n.start)
    out += held
    out.sort(key=lambda n: n.start)
    return out


def shape(text: str) -> str:
    """Observed features of a node as one symbol: digit count, signs, letters, and whether a number
    of a card's or an address's form fails the check digit or the range of its parts."""
    if _SPELT.fullmatch(text):
        return "spelt"
    d = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    size = "0" if d == 0 else "s" if d < 7 else "p" if d < 10 else "P" if d < 14 else "c" if d < 20 else "x"
    if size in "pP" and _CALL.fullmatch(text):
        size = "call"
    fails = size == "c" and not luhn(_DIGITS.sub("", text))
    fails |= _IP.fullmatch(text) is not None and not in_range(text)
    return size + "@" * ("@" in text) + "." * min(3, text.count(".")) + "a" * (letters > 0) + "+" * text.startswith("+") + "!" * fails


def skip_keys(text: str) -> list[str]:
    """Nodes with a common key are tied: the lower-cased text, the last seven digits, or an
    address's local part."""
    keys = ["t" + text.lower()]
    d = _DIGITS.sub("", text)
    if len(d) >= 7:
        keys.append("d" + d[-7:])
    if "@" in text:
        keys.append("l" + text.split("@")[0].lower())
    elif m := _LOCAL_PART.match(text):
        keys.append("l" + m[1].lower())
    return keys


def skip_edges(nodes: list[Node]) -> list[tuple[int, int]]:
    """From each node to the first and the latest one before it with a common key: linear in the document."""
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    tied = set()
    for i, x in enumerate(nodes):
        for key in skip_keys(x.text):
            for j in {first.get(key, i), last.get(key, i)} - {i}:
                tied.add((j, i))
            first.setdefault(key, i)
            last[key] = i
    return sorted(tied)


@dataclass(frozen=True)
class SkipChainModel:
    """Log potentials: ``shape`` and ``cue`` of a node, ``chain`` between neighbours, ``skip`` for two
    tied nodes of equal label, O or a kind alike. Labels: 0 is O, then the kinds. A shape or cue
    that was never seen has the potentials of ``""``."""

    shape: dict[str, tuple[float, ...]]
    cue: dict[str, tuple[float, ...]]
    chain: tuple[tuple[float, ...], ...]
    skip: float
    clamp: float = 12.0

    def graph(self, nodes: list[Node]) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]:
        """Node potentials, edges and their potentials."""
        phi = np.zeros((len(nodes), len(KINDS) + 1))
        for i, x in enumerate(nodes):
            if x.base >= 0:
                phi[i] = -self.clamp
                phi[i, x.base + 1] = 0.0
            else:
                phi[i] = np.add(self.shape.get(shape(x.text), self.shape[""]), self.cue.get(x.cue, self.cue[""]))
        tied = skip_edges(nodes)
        edges = [(i, i + 1) for i in range(len(nodes) - 1)] + tied
        return phi, edges, [np.array(self.chain)] * (len(nodes) - 1) + [self.skip * np.eye(len(KINDS) + 1)] * len(tied)

    def marginals(self, nodes: list[Node], rounds: int = 30) -> np.ndarray:
        """Loopy sum-product over the chain and the skip edges: a row of label probabilities a node."""
        phi, edges, _ = self.graph(nodes)
        belief = phi
        if edges:
            # Both directions of the chain's edges, then of the skip edges, follow each other.
            ends, k, c = np.array(edges), len(edges), len(nodes) - 1
            a, b = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
            back = np.r_[np.arange(k, 2 * k), np.arange(k)]
            chain, skip = np.exp(np.array(self.chain)), np.exp(self.skip * np.eye(phi.shape[1]))
            parts = ((slice(0, c), chain), (slice(c, k), skip), (slice(k, k + c), chain.T), (slice(k + c, 2 * k), skip))
            order = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0])
            met = b[order][first]
            msg = np.zeros((2 * k, phi.shape[1]))

            def beliefs() -> np.ndarray:
                out = phi.copy()
                out[met] += np.add.reduceat(msg[order], first, axis=0)
                return out

            for _ in range(rounds):
                out = beliefs()[a] - msg[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.concatenate([out[part] @ tie for part, tie in parts])
                new = np.log(new)
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - msg).max()
                msg = 0.5 * msg + 0.5 * new
                if change < 1e-4:
                    break
            belief = beliefs()
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def label(self, nodes: list[Node], least: float = 0.8) -> list[int]:
        """Kinds of nodes, -1 for O or for a label less likely than ``least``."""
        p = self.marginals(nodes)
        return [x.base if x.base >= 0 else int(r.argmax()) - 1 if r.max() >= least else -1 for x, r in zip(nodes, p)]


#: Examples that every fit starts from, so that a table without entities has a model too:
#: (kind, text). Their worn forms (below) come with them.
EXAMPLES = (
    (0, "first.last@mail.example.com"), (1, "192.168.10.24"), (2, "4539148803436467"), (2, "4539 1488 0343 6467"),
    (3, "+1 (499) 555-6503"), (3, "+44 20 7946 0018"), (3, "+14995556503"),
    (-1, "2024"), (-1, "10000"), (-1, "4539148803436468"), (-1, "10.0.19041.1234"), (-1, "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"),
    (-1, "12345678"), (-1, "user@"), (-1, "1.2.3"), (-1, "2024-01-31"),
)


def worn(kind: int, text: str) -> list[str]:
    """Forms that an entity takes where no fixed pattern sees it: a number without its plus sign or
    marks, an address spelt out."""
    if kind == 3:
        bare = re.sub(r"^\+[0-9]{1,3}[ .-]", "", text) if " " in text else text.lstrip("+")
        return list(dict.fromkeys([text.lstrip("+"), bare, _DIGITS.sub("", bare)]))
    if kind == 0:
        local, host = text.split("@", 1)
        return [f"{local} [at] {host}", f"{local} at {host.replace('.', ' dot ')}"]
    return []


#: What a node's conditional distribution given its neighbours depends on, and its label:
#: shape, cue, labels left and right (-1: none or not known), labels tied to it.
Case = tuple[str, str, int, int, str, int]


def cases_of(nodes: list[Node]) -> list[tuple[Case, float]]:
    """The cases of a document with their weights. Nodes of unknown label (``open``) are no cases
    and tell their neighbours nothing. A worn form of an entity counts beside the entity: as one
    tied to it, as one after a word that names it, and alone, when it is as likely to be nothing."""
    y = [-1 if x.open else x.base + 1 for x in nodes]
    tied: list[list[int]] = [[] for _ in nodes]
    for a, b in skip_edges(nodes):
        if y[a] >= 0 and y[b] >= 0:
            tied[a].append(y[b])
            tied[b].append(y[a])
    out: list[tuple[Case, float]] = []
    for i, x in enumerate(nodes):
        if y[i] < 0:
            continue
        left, right = y[i - 1] if i else -1, y[i + 1] if i + 1 < len(nodes) else -1
        out.append(((shape(x.text), x.cue, left, right, "".join(map(str, sorted(tied[i])[:4])), y[i]), 1.0))
        if x.base >= 0:
            forms = worn(x.base, x.text)
            for t in forms:
                s, w = shape(t), 1.0 / len(forms)
                out.append(((s, "", left, right, str(y[i]), y[i]), w))
                out.append(((s, KINDS[x.base], left, right, "", y[i]), w))
                out += [((s, "", left, right, "", k), w / 2) for k in (0, y[i])]
                out.append(((s, "secret", left, right, "", 0), w))
    return out


def example_cases() -> Counter:
    seen: Counter = Counter()
    for kind, text in EXAMPLES:
        for c, w in cases_of([Node(0, len(text), text, kind)]):
            seen[c] += w
        if kind >= 0:
            # An entity of this shape after any word, and a lone one.
            for cue in ("", *CUES):
                seen[shape(text), cue, -1, -1, "", kind + 1] += 0.5
        for cue in CUES:
            seen[shape(text), cue, -1, -1, "", 0] += 0.5 * (kind < 0)
    return seen


def train(cases: dict[Case, float], *, ridge: float = 0.0004, steps: int = 1000, most_skip: float = 2.0, most_chain: float = 1.0) -> SkipChainModel:
    """Potentials of largest pseudo-likelihood: the product, over nodes, of a label's probability
    given the labels of its neighbours and of the nodes tied to it. Cases are few, however many
    nodes they stand for, and weigh by the logarithm of their count. A ridge keeps potentials
    finite; accelerated gradient steps on a convex function. Edge potentials are cut at
    ``most_skip`` and ``most_chain``: with stronger ones messages around loops are overconfident."""
    rows = sorted(cases.items())
    m = len(KINDS) + 1
    shapes, cues = sorted({c[0] for c, _ in rows}), sorted({c[1] for c, _ in rows} | {""})
    n, at_s, at_c = len(rows), len(shapes), len(shapes) + len(cues)
    fixed = np.zeros((n, at_c))
    left, right, ties = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
    y = np.zeros((n, m))
    for i, ((s, c, a, b, t, k), _) in enumerate(rows):
        fixed[i, shapes.index(s)] = fixed[i, at_s + cues.index(c)] = y[i, k] = 1
        if a >= 0:
            left[i, a] = 1
        if b >= 0:
            right[i, b] = 1
        for d in t:
            ties[i, int(d)] += 1
    weight = np.log1p(np.array([w for _, w in rows]))
    weight /= weight.sum()
    size = [at_c * m, m * m, 1]
    x = x0 = np.zeros(sum(size))
    limit = 2.0 / (2 + 4 + (ties**2).sum(1).max()) if n else 1.0
    k = 1.0
    parts = lambda v: (v[: size[0]].reshape(at_c, m), v[size[0] : size[0] + size[1]].reshape(m, m), v[size[0] + size[1] :])

    def gradient(v: np.ndarray) -> np.ndarray:
        u, chain, skip = parts(v)
        z = fixed @ u + left @ chain + right @ chain.T + ties * skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = (p - y) * weight[:, None]
        return np.concatenate([(fixed.T @ r).ravel(), (left.T @ r + (right.T @ r).T).ravel(), [(ties * r).sum()]]) + ridge * v

    for _ in range(steps):
        k1 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        ahead = x + (k - 1) / k1 * (x - x0)
        x0, x, k = x, ahead - limit * gradient(ahead), k1
    u, chain, skip = parts(x)
    flat = (0.0,) * m
    # A shape that was never seen is a run of another kind: nothing speaks for an entity.
    unseen = (3.0, *(0.0,) * (m - 1))
    return SkipChainModel(
        {**{s: tuple(u[i].tolist()) for i, s in enumerate(shapes)}, "": unseen},
        {"": flat, **{c: tuple(u[at_s + i].tolist()) for i, c in enumerate(cues)}},
        tuple(map(tuple, np.clip(chain, -most_chain, most_chain).tolist())), float(np.clip(skip[0], 0, most_skip)),
    )


def fit(docs: DataFrame, *, text_col: str = "text") -> SkipChainModel:
    """Potentials trained on all documents, in one scan.

    The fixed patterns label the nodes. What the driver gets is the number of nodes of each case,
    combined on the way; shapes, cues and labels are fixed, small sets, so the cases are bounded
    whatever the input. With no documents the examples alone count.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(cols: list) -> list:
        seen: Counter = Counter()
        for t in cols[0]:
            for c, w in cases_of(nodes_of(t or "", base_spans(t or ""))):
                seen[c] += w
        keys = list(seen)
        return [*[[k[j] for k in keys] for j in range(6)], [float(seen[k]) for k in keys]]

    names = ["shape", "cue", "before", "after", "ties", "label"]
    got = arrow_rows(rows, run, ["text"], "shape string, cue string, before int, after int, ties string, label int, n double")
    seen = example_cases()
    for r in got.groupBy(*names).agg(F.sum("n").alias("n")).collect():
        seen[tuple(r[c] for c in names)] += round(r["n"], 6)
    return train(seen)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str, model: SkipChainModel) -> tuple[list, list]:
    """Base spans, and base plus added spans: nodes that the field labels with a kind."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    free = [x for x in nodes if x.base < 0]
    if not free:
        return base, base
    found = [(x.start, k, x.stop) for x, k in zip(nodes, model.label(nodes)) if x.base < 0 and k >= 0]
    return base, sorted(set(base) | set(found))


def find_pii(docs: DataFrame, model: SkipChainModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256 and all spans, for every row; no shuffle.

    A null text has none. The field also runs where no fixed pattern matched: a shape alone, a word
    that names the kind, or tied nodes can be evidence enough.
    """

    def run(cols: list) -> list:
        out: list[list] = [cols[0], [], [], [], [], [], []]
        for t in cols[1]:
            base, both = all_spans(t or "", model)
            for k in range(4):
                out[1 + k].append(sum(1 for x in base if x[1] == k))
            out[5].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            out[6].append(join_spans(both))
        return out

    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(pick, run, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
