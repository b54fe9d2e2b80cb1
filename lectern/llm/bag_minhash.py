"""BagMinHash: signatures of weighted sets whose share of equal registers is, on average, the weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np
import xxhash

from lectern.llm.arrow import Memory

SHINGLE = 5
REGISTERS, BANDS = 160, 32
ROWS = REGISTERS // BANDS
#: What is left of registers without a point after the first threshold: about exp(-SLACK) for each document.
SLACK = 4.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_hash = Memory(lambda w: xxhash.xxh64_intdigest(w), 150_000).__getitem__


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, lower-cased, of a text; texts of one to four words are filled up to a shingle."""
    found = text.lower().split()
    out = np.fromiter(map(_hash, found), dtype=np.uint64, count=len(found))
    return out if len(out) >= SHINGLE or not len(out) else np.concatenate([out, np.zeros(SHINGLE - len(out), dtype=np.uint64)])


def bags(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight): the multiset of shingles of each document, by document, then shingle."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    words = np.concatenate(hashes) if len(hashes) else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(hashes)), sizes)
    if len(words) < SHINGLE:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(words) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        h = mix(h * _GOLD + words[j : n + j] + np.uint64(j))
    inside = doc[:n] == doc[SHINGLE - 1 :]
    h, doc = h[inside], doc[:n][inside]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _fill(signature: np.ndarray, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, until: np.ndarray) -> None:
    """Put the points of all processes up to each document's time limit into its registers.

    A shingle has one Poisson process on each interval of the weight axis, [0, 1),
    [1, 2), [2, 4), [4, 8) and so on, at a rate of the interval's length. Each bit of a point's
    place says into which half of what is left of its interval it falls, as if its process
    were split there into two of half the rate, level by level. A point
    counts if its place on the axis is under the shingle's weight, so a document
    sees of a shingle just the points that any document with at least that weight sees.
    A process stops once its next point is later than the largest register of its document.
    """
    registers = np.uint64(signature.shape[1])
    flat = signature.reshape(-1)
    top = int(weight.max(initial=0))
    level = 0
    while level == 0 or (1 << (level - 1)) < top:
        low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        has = np.flatnonzero(weight > low)
        seed = mix(shingle[has] ^ np.uint64((level + 1) * int(_GOLD) & _WRAP))
        r, w, limit = row[has], weight[has], until[row[has]]
        time = np.zeros(len(has))
        step = 0
        while len(seed):
            step += 1
            u = mix(seed + np.uint64(step * int(_GOLD) & _WRAP))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / (high - low)
            if step > 1:
                limit = np.minimum(limit, signature.max(axis=1)[r])
            go = np.flatnonzero(time < limit)
            if not len(go):
                break
            seed, r, w, limit, time = seed[go], r[go], w[go], limit[go], time[go]
            v = mix(u[go] ^ _GOLD)
            hit = slice(None)
            if level:
                place = low + (high - low) * ((mix(v) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0)
                hit = place < w
            np.minimum.at(flat, r[hit] * int(registers) + (v[hit] % registers).astype(np.int64), time[hit])
        level += 1


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, count: int, registers: int = REGISTERS) -> np.ndarray:
    """count x registers: the earliest point of each register; infinite in documents without words."""
    out = np.full((count, registers), np.inf)
    total = np.bincount(doc, weights=weight, minlength=count)
    until = registers * (np.log(registers) + SLACK) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        # points come from doc's own list only, so a document's signature doesn't depend on its neighbours
        local = np.full(count, -1)
        local[todo] = np.arange(len(todo))
        own = local[doc] >= 0
        part = np.full((len(todo), registers), np.inf)
        _fill(part, local[doc[own]], shingle[own], weight[own], until[todo])
        out[todo] = part
        todo = todo[np.isinf(part).any(axis=1)]
        until = until * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """count x BANDS of int64: one key of each band's registers."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, weights) of one text."""
    _, shingle, weight = bags([word_hashes(text)])
    return shingle, weight


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, exactly: 1 for two empty ones."""
    whole = int(a[1].sum() + b[1].sum())
    if not whole:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (whole - shared)
