"""Word and shingle hashing over whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
#: Fixed odd multipliers of a well-mixed 64-bit finaliser.
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(31))) * MIX_A
    x = (x ^ (x >> U64(29))) * MIX_B
    return x ^ (x >> U64(32))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * MIX_B + U64(seed))


_BYTES = byte_values(7)


def word_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word; flat holds the words' bytes, each word running
    from its start to the next one's (a trailing blank counts for every word)."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = np.diff(np.append(starts, len(flat)))
    at = np.arange(len(flat)) - np.repeat(starts, lengths)
    powers = np.ones(int(lengths.max()), U64)
    powers[1:] = MIX_A
    powers = np.cumprod(powers, dtype=U64)
    return mix(np.add.reduceat(_BYTES[flat] * powers[at], starts))


def word_table(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank after each word, word starts, document of each word, word counts).

    Words are the maximal runs without \\x20 and \\x09-\\x0D, as bytes.split() has
    them. Texts without words have no part in the bytes.
    """
    normal = [b" ".join(t.split()) for t in texts]
    flat = b"".join(t + b" " for t in normal if t)
    ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if flat else np.zeros(0, np.int64)
    counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in normal), np.int64, len(normal))
    return flat, starts, np.repeat(np.arange(len(texts)), counts), counts


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = (out * MIX_A) ^ h[j : j + n]
        out = mix(out)
    return out


def combine_axis(h: np.ndarray) -> np.ndarray:
    """Hashes along the last axis."""
    out = np.zeros(h.shape[:-1], U64)
    for j in range(h.shape[-1]):
        out = mix((out * MIX_A) ^ h[..., j])
    return out


def folded(own: np.ndarray, key: np.ndarray, pack: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of which equal ones follow each other in a text, as the first of
    them: (which ones stay, their n). The low half of n is the windows of one run, the
    high half how many equal ones come after it."""
    new = np.ones(len(n), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1]) | (pack[1:] != pack[:-1]) | (n[1:] != n[:-1]) | (start[1:] != start[:-1] + n[:-1])
    head = np.flatnonzero(new)
    more = np.diff(np.append(head, len(n))) - 1
    return head, n[head].astype(np.int64) | (more.astype(np.int64) << 32)


def single(n: str) -> Column:
    """The windows of one run of a folded n."""
    return F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def copies(n: str) -> Column:
    """How many equal runs a folded n stands for."""
    return F.shiftright(F.col(n), 32) + 1


def batches_of(texts: list, most: int = 4 << 20):
    """Ranges of a batch whose texts hold about `most` bytes (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, how many each has).

    A-Z are lower-cased. A text with fewer words than a shingle has its whole word
    sequence as the only one; a text without words has none.
    """
    flat, starts, doc, counts = word_table([t.translate(_LOWER) for t in texts])
    h = word_hashes(np.frombuffer(flat, np.uint8), starts)
    if not len(h):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    full = combine(h, words)
    inside = doc[: len(full)] == doc[words - 1 :] if len(full) else np.zeros(0, bool)
    owner, value = doc[: len(full)][inside], full[inside]
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        own = np.array([combine(h[first[d] : first[d] + counts[d]], int(counts[d]))[0] for d in short], U64)
        own = mix(own + counts[short].astype(U64))
        owner, value = np.concatenate((owner, short)), np.concatenate((value, own))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sketches(values: np.ndarray, sizes: np.ndarray, t: int, seed: int = 11) -> np.ndarray:
    """Fast similarity sketches, one row of t 64-bit coordinates per non-empty set.

    Round i throws every element of a set into one of t bins under a fresh hash and
    a bin keeps the smallest (round, hash); a set stops once all its bins are full.
    Rounds t to 2t-1 throw into bin i - t whatever the hash, so every coordinate is
    filled after 2t rounds at the latest.
    """
    out = np.full((len(sizes), t), np.iinfo(U64).max, U64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat, live = out.reshape(-1), values
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(live + U64((seed + i) * int(MIX_A) & (2**64 - 1)))
        at = (h % U64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        key = (h >> U64(8)) | (U64(min(i, 255)) << U64(56))
        cell = owner * t + at
        order = np.lexsort((key, cell))
        cell, key = cell[order], key[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, key = cell[first], key[first]
        flat[cell] = np.minimum(flat[cell], key)
        open_ = (out[np.unique(owner)] == np.iinfo(U64).max).any(axis=1)
        keep = np.zeros(len(sizes), bool)
        keep[np.unique(owner)[open_]] = True
        on = keep[owner]
        owner, live = owner[on], live[on]
    return out
