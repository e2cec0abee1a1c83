"""Word-shingle sets of whole texts, hashed in numpy."""

from __future__ import annotations

import numpy as np

from sparkloom.llm._common import mix64

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            _powers["n"] = np.cumprod(np.full(size, _BASE), dtype=np.uint64)
            _powers["b"] = np.cumprod(np.full(size, _BACK), dtype=np.uint64)
    return _powers["n"], _powers["b"]


def _sets(data: bytes, lengths: list[int], width: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    up = (raw >= 65) & (raw <= 90)
    low = raw + (up * np.uint8(32))
    gap = _SPACE[low]
    bounds = np.cumsum(np.r_[0, lengths])
    doc_start = np.zeros(len(raw) + 1, bool)
    doc_start[bounds] = True
    before = np.r_[True, gap[:-1]] | doc_start[:-1]
    after = np.r_[gap[1:], True] | doc_start[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    up_pow, down_pow = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up_pow[: len(raw)], out=sums[1:])
    word = mix64((sums[ends] - sums[starts]) * down_pow[starts] + (ends - starts).astype(np.uint64) * _BASE)
    first = np.searchsorted(starts, bounds)
    out = []
    n = len(word)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += word[k : k + len(full)] * _PLACE[k]
    full = mix64(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            # The whole sequence as one shingle; its length keeps it apart from all others.
            out.append(mix64(np.array([(word[a:b] * _PLACE[: b - a]).sum() + _PLACE[32 + b - a]], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int = 5, chunk: int = 1 << 18) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each text (A-Z lower-cased,
    words ``[^\\x20\\x09-\\x0D]+``): with fewer words the whole sequence is one shingle, without
    words there is none. Texts are worked on in chunks of about ``chunk`` bytes."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(b) > chunk:
                out += _sets(b"".join(held), [len(x) for x in held], width)
                held, size = [], 0
            held.append(b)
            size += len(b)
        if held:
            out += _sets(b"".join(held), [len(x) for x in held], width)
    return out
