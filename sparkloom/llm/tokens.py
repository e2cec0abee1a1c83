"""Whole-text ids through the tokenizers library, one library call for each new chunk of text."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

from sparkloom.llm._common import hold


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


class ChunkEncoder:
    """Encodes texts whose tokenizer drops white space: a text's ids are those of its chunks.

    Each distinct white-space chunk goes through the library once and is then looked up, in two
    generations of at most ``limit`` chunks, so memory stays bounded on any corpus. A tokenizer
    that keeps white space (found by probing) and a text with separators on which Python and the
    library differ are encoded whole. Ids come back as little-endian unsigned 32-bit bytes.
    """

    _odd = re.compile("[\x1c-\x1f]")
    #: Beyond these, lower-casing in Python and in the library may differ, or a mark may begin.
    _as_is = re.compile("[\u0130\u0250-\U0010ffff]")
    _marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = 350_000, longest: int = 200):
        # One thread: the other cores have tasks of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit, self.longest = limit, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.by_chunk = all(
            one(a + gap + b) == one(a) + one(b)
            for a, b in (("ab", "cd"), ("a!", "!b"), ("x1", "2y"))
            for gap in (" ", "  ", "\n", "\t  ", "\u0085")
        )
        self.lower = self.by_chunk and one("ABC Déf") == one("abc déf")
        self.by_stem = self.by_chunk and all(
            one(a + b) == one(a) + one(b)
            for a in ("ab", "X1", "é", "it's")
            for b in (".", "!!", "***", "-,", "%%%")
        )

        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.by_chunk:
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends[[k for w, k in self.tok.get_vocab().items() if w.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone go in long texts, cut where a token ends a word."""
        if self.ends is None:
            return dict(zip(words, self._library(words)))
        plain = [w for w in words if w.isalpha()]
        texts = [" ".join(plain[k : k + 2000]) for k in range(0, len(plain), 2000)]
        raw = b"".join(self._library(texts))
        stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)
        if len(stops) != len(plain):
            return dict(zip(words, self._library(words)))
        stops = stops.tolist()
        got = {w: raw[a:b] for w, a, b in zip(plain, [0, *stops], stops)}
        rest = [w for w in words if not w.isalpha()]
        got.update(zip(rest, self._library(rest)))
        return got

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are new: from the old table, from a stem and its closing marks (a
        vocabulary that splits letters from marks encodes them apart), or from the library."""
        known, old, split, ask, long = self.new, self.old, {}, {}, {}
        again = words & old.keys()
        known.update((w, old[w]) for w in again)
        for w in words - again:
            stem = w.rstrip(self._marks)
            if self.by_stem and stem and len(stem) < len(w) and stem[-1].isalnum() and "<|" not in w:
                tail = w[len(stem) :]
                split[w] = (stem, tail)
                for part in (stem, tail):
                    if part not in known and part not in ask:
                        ids = old.get(part)
                        if ids is not None:
                            known[part] = ids
                        else:
                            ask[part] = None
            else:
                ask[w] = None
        for w, ids in self._ask(list(ask)).items():
            (known if len(w) <= self.longest else long)[w] = ids
        get = lambda x: known[x] if x in known else long[x]
        for w, (stem, tail) in split.items():
            (known if len(w) <= self.longest else long)[w] = get(stem) + get(tail)
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_chunk:
            return self._library(texts)
        chunks = []
        for t in texts:
            if self._odd.search(t):
                chunks.append(None)
            else:
                plain = self.lower and "<|" not in t and (t.isascii() or not self._as_is.search(t))
                chunks.append((t.lower() if plain else t).split())
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        long = self._learn(set().union(*(c for c in chunks if c)).difference(self.new))
        get = (self.new | long if long else self.new).__getitem__
        return [b"".join(map(get, w)) if w is not None else self._library([t])[0] for t, w in zip(texts, chunks)]


@lru_cache(maxsize=1)
def chunk_encoder(path: str, limit: int = 350_000) -> ChunkEncoder:
    """One encoder for each worker process; ``limit`` chunks take about a quarter of a KB each."""
    hold("tokens", chunk_encoder.cache_clear)
    return ChunkEncoder(path, limit)
