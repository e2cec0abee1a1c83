"""Operator 9: secret scan behind a trigram index, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import staged

#: A Boolean query in disjunctive form: sets of trigrams, one of which must all be present; None: no constraint.
Query = frozenset[frozenset[str]] | None


@dataclass(frozen=True)
class Rule:
    """A pattern, whose matches count if group ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    base: bool = False


#: Fixed values of the contract (assign, access, hex), then the rules that the method adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

_HEAD = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: Up to the matching END line, no other such line between; without one, the lines of base64 and a last short one.
_TO_END = r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
_GAP = r"(?:\s|\\[nr])"
_RUN = rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?![^\r\n]))?+"
#: The rules for redaction: a private key is the whole key, not its header alone, which RULES report.
WHOLE_RULES = tuple(Rule(r.kind, f"{_HEAD}(?:{_TO_END}|{_RUN})") if r.kind == "pem" else r for r in RULES)


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _absorb(x | y for x in a for y in b)


def _absorb(sets) -> Query:
    """Drops what another set already implies; an empty set means no constraint."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda x: (len(x), sorted(x))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return None if not kept or not kept[0] else frozenset(kept)


def _exact(strings: set[str]) -> Query:
    return _absorb(map(_grams, strings)) if strings else None


def _walk(nodes, limit: int = 64) -> tuple[set[str] | None, Query]:
    """Of a pattern: the strings it can match, if few, and what any match must contain."""
    run: set[str] | None = {""}
    query: Query = None
    for op, arg in nodes:
        found: set[str] | None = None
        inner: Query = None
        if op is sre.LITERAL:
            found = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            found = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            found, inner = _walk(arg[3], limit)
        elif op is sre.BRANCH:
            sides = [_walk(x, limit) for x in arg[1]]
            if all(s[0] is not None for s in sides):
                found = set().union(*(s[0] for s in sides))
            else:
                both = [s[1] if s[0] is None else _and(s[1], _exact(s[0])) for s in sides]
                inner = None if any(b is None for b in both) else _absorb(x for b in both for x in b)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            one, must = _walk(sub, limit)
            if one is not None and high == 1:
                found = one | ({""} if low == 0 else set())
            elif one is not None and low == high and len(one) ** low <= limit:
                found = reduce(lambda a, _: {x + y for x in a for y in one}, range(low), {""})
            elif low >= 1:
                inner = must if one is None else _and(must, _exact(one))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            found = {""}
        query = _and(query, inner)
        if found is not None and run is not None and len(run) * len(found) <= limit:
            run = {a + b for a in run for b in found}
        else:
            query = _and(query, _exact(run)) if run is not None else query
            run = found
            if found is None:
                run = None
        if run is None:
            # What follows starts a new run of known strings.
            tail, rest = _walk(nodes[list(nodes).index((op, arg)) + 1 :], limit)
            query = _and(query, rest if tail is None else _and(rest, _exact(tail)))
            return None, query
    return run, query


def trigram_query(pattern: str) -> Query:
    """Trigrams (of the lower-cased text) that every match of a pattern contains."""
    run, query = _walk(list(_parser.parse(pattern)))
    return _and(query, _exact(run)) if run is not None else query


class TrigramIndex:
    """An inverted index of the trigrams that a rule set needs.

    ``postings`` are the lists as rows (trigram, key), the key being the hash of a text, so that
    copies of a text are listed once. ``candidates`` intersects them by the rules' Boolean queries.
    Trigrams that no rule asks for are not listed: the table is bounded by the rules, not by the text.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.grams = sorted({g for q in self.queries.values() if q for s in q for g in s})
        self.bit = {g: (k // 63, k % 63) for k, g in enumerate(self.grams)}
        self.n_words = -(-len(self.grams) // 63)

    def postings(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(trigram, key) rows: the number of a needed trigram, and the hash of a text whose lower-cased form holds it."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        src = docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
        held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(self.grams)], F.lit(None).cast("int")))
        return src.select(F.explode(held).alias("trigram"), "key")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(key, rules): texts in the intersection of some rule's lists, with a bit for each such
        rule. Rules without mandatory trigrams are not among them: all texts are their candidates."""
        bits = lambda w: F.expr(f"bit_or(CASE WHEN trigram div 63 = {w} THEN shiftleft(1L, cast(trigram % 63 AS int)) ELSE 0L END)")
        lists = postings.groupBy("key").agg(*[bits(w).alias(f"w{w}") for w in range(self.n_words)])
        held = reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.when(self._meets(q), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(self.rules) if (q := self.queries[r.kind])], F.lit(0),
        )
        return lists.select("key", held.cast("long").alias("rules")).filter("rules <> 0")

    def _meets(self, query: frozenset[frozenset[str]]) -> Column:
        sides = []
        for s in sorted(query, key=sorted):
            masks: dict[int, int] = {}
            for g in s:
                w, b = self.bit[g]
                masks[w] = masks.get(w, 0) | (1 << b)
            sides.append(reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()]))
        return reduce(lambda a, b: a | b, sides)


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points: the text split at the
    matches gives the gaps between them, and lengths add up to positions."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(gaps.alias("g"), whole.alias("m"), (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole).alias("v"))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        good = x["m"].isNotNull() & (F.length(x["v"]) >= rule.at_least)
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # arrays_zip pads the shorter arrays with null: the last gap has no match.
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
    keep: tuple[str, ...] = (), most_broadcast: int = 1_000_000,
) -> DataFrame:
    """Adds to the id (and ``keep`` columns): ``found``, an array of (start, rank, stop) by start,
    then rule order, ``rank`` being the rule's place in ``rules``.

    The first pass over the texts writes the posting lists of the needed trigrams to the shared
    folder; their intersections give the candidate texts of each rule, and the second pass runs a
    rule's regex on its candidates alone, or on every text if the rule has no mandatory trigram.
    Candidates come to the texts by hash, broadcast up to a checked count, else in a salted shuffle.
    A null text has no spans; rows without an id and repeated rows are scanned like all others.
    """
    index = TrigramIndex(rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"kept {c}") for c in keep], text.alias("__text"),
        F.xxhash64(text).alias("__key"),
    )
    if index.grams:
        found = staged(index.candidates(staged(index.postings(docs, text_col), "postings")), "candidates")
        if found.count() <= most_broadcast:
            seen = seen.join(F.broadcast(found), F.col("__key") == F.col("key"), "left")
        else:
            salted = found.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
            seen = seen.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
            seen = seen.join(salted, (F.col("__key") == F.col("key")) & (F.col("__salt") == F.col("s")), "left")
    else:
        seen = seen.withColumn("rules", F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    body = F.col("__text")
    per_rule = []
    for k, r in enumerate(rules):
        listed = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        per_rule.append(F.when(listed if index.queries[r.kind] else body.rlike(r.pattern), _spans(r, k, body)).otherwise(empty))
    out = seen.withColumn("found", F.sort_array(F.concat(*per_rule)))
    return out.select("doc_id", *[F.col(f"kept {c}").alias(c) for c in keep], "found", F.col("__text").alias("scanned_text"))


def span_text(found: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(found, one))


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 of the base spans, and all spans."""
    kinds = [r.kind for r in rules]
    base = [k for k, r in enumerate(rules) if r.base]
    found = scan(docs, id_col=id_col, text_col=text_col, rules=rules).drop("scanned_text")
    ranks = F.transform("found", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{kinds[k]}") for k in base]
    own = F.filter("found", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *counts, F.sha2(span_text(own, kinds), 256).alias("base_sha256"), span_text(F.col("found"), kinds).alias("spans"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], F.array(gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, zero, step, done))
