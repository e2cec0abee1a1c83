"""Operator 4: token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import arrow_rows, hold

_NONE = np.int64(1 << 40)
#: Fixed value: the splitting rule of byte-level BPE vocabularies of this family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankMerger:
    """Symbol counts of many pre-tokens at once.

    All pre-tokens lie in one flat symbol array with row offsets. In each round every row finds
    its own lowest-rank adjacent pair and merges all its occurrences, left to right, at the same
    moment; rows without a pair leave. As a merge only makes pairs of higher rank, this gives the
    same symbols as merging one pair at a time.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        # The printable stand-ins of the 256 bytes, in byte order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in, extra = {b: chr(b) for b in plain}, 0
        for b in range(256):
            if b not in stand_in:
                stand_in[b] = chr(256 + extra)
                extra += 1
        self.byte_id = np.array([vocab[stand_in[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def count(self, tokens: list[bytes]) -> np.ndarray:
        out = np.array([len(t) for t in tokens], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.repeat(np.arange(len(tokens)), out)
        while len(sym) > 1:
            inside = row[1:] == row[:-1]
            rank, at = self._look_up(sym[:-1], sym[1:])
            rank = np.where(inside, rank, _NONE)
            best = np.full(len(tokens), _NONE)
            np.minimum.at(best, row[:-1], rank)
            hit = (rank < _NONE) & (rank == best[row[:-1]])
            if not hit.any():
                break
            # Overlapping occurrences (aaa) follow each other: every second one of a run merges.
            i = np.flatnonzero(hit)
            new_run = np.r_[True, np.diff(i) > 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - run_start) % 2 == 0]
            sym[i] = self.made[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            np.subtract.at(out, row[i], 1)
            keep &= best[row] < _NONE  # finished rows leave
            sym, row = sym[keep], row[keep]
        return out


class TokenCounter:
    """Token counts of whole texts, with a bounded table of counted pre-tokens."""

    #: Code points outside this class may be classed differently by the two Unicode tables at hand:
    #: each is tried when it is first met.
    _odd = re.compile("[\x1c-\x1f\u0558-\u1fff\u2065-\U0010ffff]")

    def __init__(self, path: str, limit: int = 300_000, longest: int = 256):
        import os

        # One thread: the other cores have tasks of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        self.plain = self.plain and simple
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"]) if self.plain else None
        self.split = regex.compile(PRE_TOKEN)
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.limit, self.longest, self.new, self.old = limit, longest, {}, {}
        self.alike: dict[str, bool] = {}

    def _agrees(self, c: str) -> bool:
        """Whether the library splits texts at a character where PRE_TOKEN does, in every context
        that the rule tells apart."""
        found = self.alike.get(c)
        if found is None:
            found = True
            for t in (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} a", f"{c}{c}", f"a {c}", f"'s{c}"):
                mine = [m.span() for m in self.split.finditer(t)]
                found &= mine == [tuple(x[1]) for x in self.tok.pre_tokenizer.pre_tokenize_str(t)]
            self.alike[c] = found
        return found

    def _library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str | None]) -> list[int]:
        """Whole-text counts; null is empty. Texts with characters that the library's own tables
        class otherwise, and pre-tokens of over ``longest`` bytes, go to the library."""
        out, todo = [0] * len(texts), []
        for k, t in enumerate(texts):
            if not t:
                continue
            if not self.plain or self._odd.search(t) and not all(map(self._agrees, set(self._odd.findall(t)))):
                out[k] = self._library(t)
                continue
            parts = [t]
            if self.marks and self.marks.search(t):
                parts = self.marks.split(t)
                out[k] = len(parts) - 1
            todo.append((k, [p for part in parts for p in self.split.findall(part)]))
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        known, missing, once = self.new, {}, {}
        for p in set().union(*(pre for _, pre in todo)).difference(known):
            n = self.old.get(p)
            if n is not None:
                known[p] = n
            elif len(p) > self.longest // 4 and len(p.encode()) > self.longest:
                once[p] = self._library(p)
            else:
                missing[p] = 0
        if missing:
            known.update(zip(missing, self.merger.count([p.encode() for p in missing]).tolist()))
        table = known | once if once else known
        for k, pre in todo:
            out[k] += sum(map(table.__getitem__, pre))
        return out


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    hold("token_counts", token_counter.cache_clear)
    return TokenCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, counted where it is read (no shuffle).

    A null text is empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty table
    gives none.
    """

    def run(cols: list) -> list:
        n = token_counter(tokenizer_path).count(cols[1])
        size = [len((t or "").encode("utf-8")) for t in cols[1]]
        return [cols[0], size, n, [x > limit for x in n]]

    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(pick, run, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
