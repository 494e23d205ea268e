"""Vectorised word and shingle hashing shared by the near-duplicate operators.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR, with
A-Z lower-cased. Everything works on numpy arrays in slabs of bounded size, so
a very long text costs a few bytes per word and never a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLAB = 1 << 19

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, np.uint64)[_FOLD] | np.uint64(1)
_BYTE[_SEP] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.random.default_rng(77).integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_HELD: dict = {}


def held(key, make):
    """make(), kept in this Python worker for later tasks that name the same key; what another key kept goes first."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Free what tasks of other operators have left in this Python worker: Spark uses one worker for all of them,
    and a memory of some hundred megabytes would stay beside each later task's own."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads sums of products over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of the base and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64) for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
    return _POWERS


def _slab_end(data: bytes, at: int, n: int) -> int:
    """A slab of about SLAB bytes that ends at a separator; a longer word is not cut."""
    stop = min(n, at + SLAB)
    if stop == n:
        return n
    seps = np.flatnonzero(_SEP[np.frombuffer(data, np.uint8, stop - at, at)])
    if len(seps):
        return at + int(seps[-1]) + 1
    while stop < n and not _SEP[data[stop]]:
        stop += 1
    return stop


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word of `data`."""
    hashes, starts, ends, at, n = [], [], [], 0, len(data)
    while at < n:
        stop = _slab_end(data, at, n)
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        word = ~_SEP[raw]
        s = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        e = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        s, e = (np.r_[0, s] if word[0] else s), (np.r_[e, len(raw)] if word[-1] else e)
        if len(s):  # a byte weighs its place in the slab; taking back the weight of the word's start leaves the place in the word
            up, down = _powers(len(raw))
            sums = np.add.reduceat(_BYTE[raw] * up[: len(raw)], s) * down[s]
            hashes.append(mix(sums + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_key(id_col: Column) -> Column:
    """An id on its way into a pandas frame, where a null would turn whole numbers into floats: as a string."""
    return id_col.cast("long").cast("string")


def exact(ids) -> list[int | None]:
    """The ids that `as_key` made strings."""
    return [None if x is None else int(x) for x in ids]


def longs(ids: list[int | None]):
    """Ids as a nullable column of whole numbers."""
    return pd.array(ids, dtype="Int64")


def in_slices(run, schema: str, rows: int = 512):
    """A function of pandas frames as one of Arrow batches, for mapInArrow with the same schema.

    Only `rows` rows at a time become Python objects, so that a worker holds a batch of
    texts once (as Arrow) and not as strings and word arrays too. What earlier operators
    have left in the worker is freed first.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows).to_pandas()

    def over(batches):
        let_go()
        for frame in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)
        let_go()

    return over


def batch_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and where each text's words begin (one more entry than texts)."""
    hashes, bounds, held, size, sizes = [], [0], [], 0, []

    def flush():
        nonlocal held, size, sizes
        if not held:
            return
        h, s, _ = words_of(b"\n".join(held))
        tops = np.cumsum([x + 1 for x in sizes])
        base = bounds[-1]
        bounds.extend((base + np.searchsorted(s, tops)).tolist())
        hashes.append(h)
        held, size, sizes = [], 0, []

    for text in texts:
        data = encode(text)
        held.append(data)
        sizes.append(len(data))
        size += len(data)
        if size >= SLAB:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.asarray(bounds, np.int64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words of one sequence."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _LANES[k]
    return mix(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words are one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mix(np.array([(words * _LANES[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    return np.unique(grams(words, n))
