"""Exact removal of repeated byte strings, by suffix sorting in groups that share a seed.

A string of `length` bytes that also starts earlier is a repeat; every byte that
repeats cover goes. Each window of `length` bytes names one seed of `seed` bytes
within it, the one of least hash (the first on ties), so equal windows name equal
seeds at equal places. Neighbouring windows with the same seed occurrence are one
context. The steps, none of which moves text that has no seed twice:

1. Texts are cut into units of some hundred bytes where their content says so. Of units with equal
   bytes (by a 128-bit BLAKE2 digest) the first place goes into a bitmap of bounded size. A unit that is not in it is a later
   copy: it goes whole, and no window of it is looked at again. A later copy that falls into the bitmap by chance
   is left to the next steps.
2. Seed hashes of the other windows are counted; those met twice fall into another bitmap. Contexts with such a seed are stored. Equal contexts (by a 128-bit BLAKE2 digest)
   are counted with their first place before anything is sent by seed, so a passage in a third of all documents is one
   row a task; later ones are told from first ones by a bitmap of places, as units are, and leave without a join.
3. The different contexts of a seed are sorted as suffixes from the seed to the right,
   and from the seed to the left, by merge sort: prefix polynomial hashes and binary
   search give the common extension of two suffixes in a logarithmic number of
   steps, and the next byte decides. Extensions of neighbours in the sorted order
   are verified byte by byte; a collision of hashes makes the group be sorted by
   its bytes. Runs of neighbours that share enough bytes on both sides hold equal windows,
   of which the earliest stays. A seed with more than `most` contexts
   is split by longer and longer shared strings, down to single windows, which
   are grouped by their bytes.
4. A context that is not the first of its kind is removed whole, a first one as far as
   step 3 says; spans go to their documents.

Defined results: null texts are empty. Documents are ordered by id, null ids last, then by a
64-bit hash of the text; rows of one id and text are one document and
get the same result. Texts shorter than `length` keep everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.text import mix
from gridlens.session import forget, stored

LENGTH, SEED, MOST = 100, 32, 2_000
SLAB, ROWS, UNIT = 1 << 20, 1 << 14, 768
FEW_SPANS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240711).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
CONTEXT = "c binary, h long, ctx binary, a int, size long, doc long, th long, at long"
HELD = ["c", "h", "ctx", "a", "size", "doc", "th", "at"]
PLACE = ["c", "doc", "th", "at"]


class Marks:
    """Which classes of 64-bit hashes are met: a bitmap of at most 2**MOST_BITS bits, some `ROOM` for each hash while that suffices."""

    MOST_BITS, ROOM = 28, 16

    def __init__(self, cells: np.ndarray, words: np.ndarray):
        """`words` has 64 classes each, of the MOST_BITS highest bits of the hashes, from class 64 * cell on."""
        met = int(np.bitwise_count(words).sum())
        self.bits = min(self.MOST_BITS, max(6, (self.ROOM * met).bit_length()))
        self.map = np.zeros(1 << self.bits - 6, np.uint64)
        for at in range(0, len(cells), 1 << 16):
            cell, bit = np.nonzero(np.unpackbits(words[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            c = (cells[at : at + (1 << 16)][cell].astype(np.uint64) * np.uint64(64) + bit.astype(np.uint64)) >> np.uint64(self.MOST_BITS - self.bits)
            np.bitwise_or.at(self.map, (c >> np.uint64(6)).astype(np.int64), np.uint64(1) << (c & np.uint64(63)))

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        c = h >> np.uint64(64 - self.bits)
        return (self.map[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1) > 0


def marks(df: DataFrame, column: str):
    """The hashes in a column as broadcast Marks. A hash that has not been met may be marked by chance; one that has always is."""
    high = F.shiftrightunsigned(column, 64 - Marks.MOST_BITS)
    cells = df.select(high.alias("c")).groupBy(F.expr("c >> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(c & 63 as int)))").alias("bits")).toArrow()
    return df.sparkSession.sparkContext.broadcast(Marks(cells["at"].to_numpy(), np.ascontiguousarray(cells["bits"].to_numpy().astype(np.int64)).view(np.uint64)))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash, spread by a finalizer, of every run of k bytes."""
    cur, size, out, used, base = _BYTE[data], 1, None, 0, _BASE
    while True:
        if k & size:
            if out is None:
                out = cur
            else:
                n = len(data) - used - size + 1
                out = out[:n] * np.uint64(base) + cur[used : used + n]
            used += size
        if 2 * size > k:
            return mix(out[: len(data) - k + 1])
        cur = cur[: len(cur) - size] * np.uint64(base) + cur[size:]
        size, base = 2 * size, base * base & (1 << 64) - 1


def seeds(data: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k bytes, place of the seed of every window of `length` bytes)."""
    h = gram_hashes(data, k)
    low = np.uint64((1 << max(1, (len(h) - 1).bit_length())) - 1)
    least, size, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    return h, (least & low).astype(np.int64)


def slabs(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of a column of texts, some at a time: data, and of each piece its row, begin, end and place in its text.

    A text beyond the size of a slab is several pieces, each with the last `length - 1` bytes of the one before.
    """
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        if at[row + 1] - at[row] > SLAB:
            for begin in range(int(at[row]), int(at[row + 1]) - length + 1, SLAB):
                end = min(begin + SLAB + length - 1, int(at[row + 1]))
                yield data[begin:end], np.array([row]), np.array([0]), np.array([end - begin]), np.array([begin - at[row]])
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SLAB, "right")) - 1)
        yield data[at[row] : at[stop]], np.arange(row, stop), at[row:stop] - at[row], at[row + 1 : stop + 1] - at[row], np.zeros(stop - row, np.int64)
        row = stop


def windows(column: pa.Array, k: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each slab: its data, grams, the seed of every window, whether it lies in one text, its unit, and of each unit begin, end, row and place.

    A unit is a stretch of some `UNIT` windows of a text, cut where a gram's hash says so, so that copies of a passage are
    cut alike; its bytes are those of all its windows.
    """
    for data, row, begin, end, place in slabs(column, length):
        if len(data) < length:
            continue
        h, pick = seeds(data, k, length)
        edge = np.zeros(len(data) + 1, np.int64)
        long = end - begin >= length
        np.add.at(edge, begin[long], 1)
        np.add.at(edge, end[long] - length + 1, -1)
        inside = np.cumsum(edge)[: len(pick)] > 0
        opens = inside & ((h[: len(pick)] % np.uint64(UNIT) == 0) | np.r_[True, ~inside[:-1]])
        first = np.flatnonzero(opens)
        last = np.flatnonzero(inside & np.r_[opens[1:] | ~inside[1:], True])
        piece = np.searchsorted(begin, first, "right") - 1
        yield data, h, pick, inside, np.cumsum(opens) - 1, first, last + length, row[piece], first - begin[piece] + place[piece]


def unit_places(batch: pa.RecordBatch, data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """128-bit digest of the bytes of each unit, and a 64-bit one of these and the unit's document and place."""
    held = memoryview(np.ascontiguousarray(data))
    doc, th = batch.column("doc").take(pa.array(row)).to_pylist(), batch.column("th").take(pa.array(row)).to_pylist()
    digests = [blake2b(held[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    own = [blake2b(d + f"{x} {y} {z}".encode(), digest_size=8).digest() for d, x, y, z in zip(digests, doc, th, at.tolist(), strict=True)]
    return digests, np.frombuffer(b"".join(own), np.uint64)


def contexts(batch: pa.RecordBatch, k: int, length: int, firsts, wanted=None) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each slab: its data, of each context seed hash, begin, end, seed place, row and the begin in its text, and of each later unit begin, end, row and place.

    Windows of later units, those not among `firsts`, are in no context.
    """
    for data, h, pick, inside, unit, begin, end, row, at in windows(batch.column("t"), k, length):
        again = ~firsts(unit_places(batch, data, begin, end, row, at)[1])
        if again.any():
            inside = inside & ~again[np.maximum(unit, 0)]
        turn = np.r_[True, (pick[1:] != pick[:-1]) | ~inside[:-1]]
        first = np.flatnonzero(inside & turn)
        last = np.flatnonzero(inside & np.r_[turn[1:] | ~inside[1:], True])
        found = mix(h[pick[first]] + np.uint64(_BASE))  # seeds have small hashes, as the least ones; marks ask for even ones
        if wanted is not None:
            some = wanted(found)
            first, last, found = first[some], last[some], found[some]
        own = unit[first]
        yield data, found, first, last + length, pick[first], row[own], first - begin[own] + at[own], begin[again], end[again], row[again], at[again]


def binaries(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of bytes as a column."""
    size = end - begin
    to = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(flat)])


def sought(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))


def first_units(texts: DataFrame, k: int, length: int):
    """The bitmap of the first place of every different unit. A unit that is not in it is a later copy of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, _, _, _, begin, end, row, at in windows(batch.column("t"), k, length):
                digests, own = unit_places(batch, data, begin, end, row, at)
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(own.view(np.int64)), batch.column("doc").take(pa.array(row)), batch.column("th").take(pa.array(row)), pa.array(at)], names=["d", "p", "doc", "th", "at"])

    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "at", "p")).alias("f")
    return marks(texts.mapInArrow(run, "d binary, p long, doc long, th long, at long").groupBy("d").agg(least).select("f.p"), "p")


def met_twice(texts: DataFrame, firsts, k: int, length: int):
    """The bitmap of seeds that contexts name more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in contexts(batch, k, length, firsts.value.has):
                yield pa.record_batch({"h": found[1].view(np.int64)})

    return marks(texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h")


def repeated_contexts(texts: DataFrame, firsts, bits, k: int, length: int) -> DataFrame:
    """Contexts whose seed may be there twice: digest, seed hash, bytes, place of the seed in them, document and place in it.

    Later units are rows without digest; `size` is the number of bytes of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column("doc"), batch.column("th")
            for data, h, begin, end, seed, row, at, *again in contexts(batch, k, length, firsts.value.has, bits.value.has):
                if len(h):
                    held = memoryview(np.ascontiguousarray(data))
                    digests = [blake2b(held[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(h.view(np.int64)), binaries(data, begin, end), pa.array((seed - begin).astype(np.int32)), pa.array(end - begin), doc.take(pa.array(row)), th.take(pa.array(row)), pa.array(at)], names=HELD)
                begin, end, row, at = again
                if len(begin):
                    n = len(begin)
                    yield pa.record_batch([pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(end - begin), doc.take(pa.array(row)), th.take(pa.array(row)), pa.array(at)], names=HELD)

    return texts.mapInArrow(run, CONTEXT)


class Hashed:
    """Prefix polynomial hashes of bytes: the common extension of two places by binary search."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)]

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that agree from x and from y on, at most `most`."""
        lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(x, mid) == self.of(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def _bytes_agree(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from x and from y on are equal."""
    total = np.r_[0, np.cumsum(size)]
    step = np.arange(total[-1]) - np.repeat(total[:-1], size)
    wrong = data[np.repeat(x, size) + step] != data[np.repeat(y, size) + step]
    return np.bincount(np.repeat(np.arange(len(x)), size)[wrong], minlength=len(x)) == 0


def sorted_suffixes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, hashed: Hashed | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes data[at : at + size] sorted within each group, and the bytes each shares with the one before it.

    `group` is ascending. Bottom-up merge sort: an element's place after a merge is its place in its own
    run and the number of smaller elements in the other one, found by binary search.
    """
    hashed = hashed or Hashed(data)
    n = len(at)
    begin = np.searchsorted(group, group)
    place, count = np.arange(n) - begin, np.searchsorted(group, group, "right") - begin

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal ones by their number."""
        most = np.minimum(size[x], size[y])
        k = hashed.extension(at[x], at[y], most)
        ends = k == most
        a, b = data[np.where(ends, 0, at[x] + k)], data[np.where(ends, 0, at[y] + k)]
        return np.where(ends, (size[x] < size[y]) | ((size[x] == size[y]) & (x < y)), a < b)

    order, run = np.arange(n), 1
    while n and run < count.max():
        q = np.flatnonzero(count > run)
        base = begin[q] + place[q] // (2 * run) * (2 * run)
        left = place[q] % (2 * run) < run
        stop = begin[q] + count[q]
        lo = np.where(left, np.minimum(base + run, stop), base)
        hi = np.where(left, np.minimum(base + 2 * run, stop), np.minimum(base + run, stop))
        other = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            smaller = less(order[mid], order[q[open_]])
            lo[open_], hi[open_] = np.where(smaller, mid + 1, lo[open_]), np.where(smaller, hi[open_], mid)
        moved = order.copy()
        moved[base + np.where(left, place[q], place[q] - run) % (2 * run) + (lo - other)] = order[q]
        order, run = moved, 2 * run
    if n < 2:
        return order, np.zeros(n, np.int64)
    x, y = order[:-1], order[1:]
    most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
    common = hashed.extension(at[x], at[y], most)
    ends = common == most
    rising = np.where(ends, size[x] <= size[y], data[np.where(ends, 0, at[x] + common)] < data[np.where(ends, 0, at[y] + common)]) | (group[x] != group[y])
    if not (rising & _bytes_agree(data, at[x], at[y], common)).all():  # a collision: the bytes decide
        raw = data.tobytes()
        whole = [raw[a : a + s] for a, s in zip(at.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(n), key=lambda i: (group[i], whole[i], i)))
        pairs = [(whole[i], whole[j]) if group[i] == group[j] else (b"", b"") for i, j in zip(order[:-1], order[1:], strict=True)]
        common = np.array([next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b))) for a, b in pairs])
    return order, np.r_[0, common]


def earlier_windows(data: np.ndarray, bounds: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes before the seed of those windows of each context that an earlier context of its group has too; least > most without any.

    Context i is data[bounds[i] : bounds[i + 1]] with its seed at a[i]; `rank` orders contexts by their seeds' places; equal ranks are one context.
    """
    n, mid = len(a), bounds[:-1] + a
    right, left = bounds[1:] - mid, a
    sides = []
    for d, at, size in ((data, mid, right), (data[::-1].copy(), len(data) - mid, left)):
        order, common = sorted_suffixes(d, at, np.asarray(size, np.int64), group)
        sides.append((order, common, group[order]))
    by_rank = np.argsort(rank, kind="stable")
    least, most = np.full(n, length + 1), np.full(n, -1)
    for before in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        has = (left >= before) & (right >= length - before) & (lo <= before) & (before <= hi)
        rows = by_rank[has[by_rank]]
        if len(rows) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common, own), need in zip(sides, (length - before, before), strict=True):
            new = np.r_[True, (common[1:] < need) | (own[1:] != own[:-1])]
            part = np.empty(n, np.int64)
            part[order] = np.cumsum(new)
            key = key * (n + 1) + part
        _, first, kind = np.unique(key[rows], return_index=True, return_inverse=True)
        again = rows[rank[rows] > rank[rows[first[kind]]]]
        least[again], most[again] = np.minimum(least[again], before), np.maximum(most[again], before)
    return least, most


def verdicts(rows: DataFrame, length: int) -> DataFrame:
    """(c, doc, th, at, least, most) of contexts dealt by `key`, whole groups at a time."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        ctx = t["ctx"].combine_chunks()
        bounds = np.r_[0, np.cumsum(np.diff(np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1]).astype(np.int64))]
        at = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset]
        data = np.frombuffer(ctx.buffers()[2], np.uint8)[at : at + bounds[-1]]
        part = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "a", "lo", "hi", "th", "at")}
        doc, none = t["doc"].combine_chunks().fill_null(0).to_numpy(), t["doc"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        by = [none, doc, part["th"], part["at"] + part["a"]]
        order = np.lexsort(by[::-1])
        rank = np.empty(len(none), np.int64)  # rows of one place, from repeated rows of the table, are one
        rank[order] = np.cumsum(np.r_[0, np.any([x[order][1:] != x[order][:-1] for x in by], axis=0)])
        least, most = earlier_windows(data, bounds, part["a"].astype(np.int64), part["lo"], part["hi"], np.unique(part["key"], return_inverse=True)[1], rank, length)
        some = np.flatnonzero(least <= most)
        told = [t[c].combine_chunks().take(pa.array(some)) for c in PLACE]
        return pa.record_batch([*told, pa.array(least[some].astype(np.int32)), pa.array(most[some].astype(np.int32))], names=[*PLACE, "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole:
                yield judged(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield judged(pa.Table.from_batches(held))

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "lo", "hi", "c", "ctx", "a", "doc", "th", "at").mapInArrow(run, "c binary, doc long, th long, at long, least int, most int")


def compared(work: DataFrame, sizes: DataFrame, length: int, most: int) -> DataFrame:
    """verdicts of contexts dealt by `key`, where `sizes` (key, n, wide) has the keys of two or more.

    A key of more than `most` is split by longer shared strings; there are at most rows / most of them. What a context
    shares whole with an earlier one leaves at each split, so that of a passage only its edges are split on.
    """
    kept = ["key", "lo", "hi", "c", "ctx", "a", "doc", "th", "at"]
    found, spent = [], []
    while True:
        large = sizes.filter(F.col("n") > most)
        among = lambda rule, how="left_semi": work.join(F.broadcast(large.filter(rule).select("key")), "key", how)  # noqa: E731, B023
        found.append(stored(verdicts(among(F.lit(True), "left_anti"), length), "verdicts"))
        if large.isEmpty():
            break
        found.append(stored(same_window(among(~F.col("wide")), length), "verdicts"))
        # The windows with lo to hi bytes before the seed share the string from lo bytes before it to length - hi after it.
        halves = F.expr("array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 + 1 as lo, hi))")
        low, high = (lambda lo: F.greatest(lo, F.lit(length) - F.length("ctx") + F.col("a"))), (lambda hi: F.least(hi, "a"))
        held = among(F.col("wide")).withColumn("p", F.explode(F.filter(halves, lambda p: low(p["lo"]) <= high(p["hi"])))).withColumns({"lo": F.col("p.lo").cast("int"), "hi": F.col("p.hi").cast("int")})
        key = F.xxhash64("key", "lo", "hi", F.expr(f"substring(ctx, a - lo + 1, lo + {length} - hi)"))
        cut = stored(held.withColumn("key", key).withColumns({"low": low("lo"), "high": high("hi")}).select(*kept, "low", "high"), "cut")
        split = stored(twins(cut, length), "split")
        forget(cut)
        found.append(split.filter("twin").select(*PLACE, F.col("low").alias("least"), F.col("high").alias("most")))
        work = split.filter("not twin").select(kept)
        sizes = stored(work.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("hi") > F.col("lo")).alias("wide")).filter("n > 1"), "sizes")
        spent += [split, sizes]
    out = stored(reduce(DataFrame.unionByName, found).groupBy(*PLACE).agg(F.min("least").alias("least"), F.max("most").alias("most")), "verdict")
    forget(*[t for t in found if hasattr(t, "stored_at")], *spent)
    return out


def twins(rows: DataFrame, length: int) -> DataFrame:
    """`rows` with `twin`: whether an earlier context has equal bytes in all windows with `low` to `high` bytes before the seed.

    Then all those windows repeat, and only the earliest context goes on: a range that lies
    within a shared passage is one row from then on, whoever holds it.
    """
    by = ["key", "low", "high", "w"]
    placed = rows.withColumn("w", F.expr(f"substring(ctx, a - high + 1, {length} + high - low)")).withColumn("place", F.struct(F.col("doc").isNull().alias("none"), "doc", "th", F.col("at") + F.col("a")))
    first = placed.groupBy(*by).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return placed.join(first, by, "left").withColumn("twin", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("w", "place", "first")


def same_window(rows: DataFrame, length: int) -> DataFrame:
    """verdicts where one window of each context is left: all but the earliest context with its bytes."""
    windows = rows.withColumn("w", F.expr(f"substring(ctx, a - lo + 1, {length})")).withColumn("place", F.struct(F.col("doc").isNull().alias("none"), "doc", "th", F.col("at") + F.col("a")))
    first = windows.groupBy("w").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(first, "w").filter(F.col("place") > F.col("first")).select(*PLACE, F.col("lo").alias("least"), F.col("lo").alias("most"))


def may_repeat(there: DataFrame, keys, places, k: int, length: int) -> DataFrame:
    """Of the stored contexts, first ones (and some later ones, by chance) whose seed has several contexts, by `key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, p = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "p"))
            some = batch.filter(pa.array(keys.value.has(h) & places.value.has(p))).drop_columns(["p"])
            if some.num_rows:  # of equal contexts in a batch, only the earliest can be a first one
                none = some.column("doc").is_null().to_numpy(zero_copy_only=False)
                order = np.lexsort((some.column("at").to_numpy(), some.column("th").to_numpy(), some.column("doc").fill_null(0).to_numpy(), none))
                _, first = np.unique(np.array(some.column("c").to_pylist(), dtype="S16")[order], return_index=True)
                yield some.take(pa.array(np.sort(order[first])))

    rows = there.select(F.col("h").alias("key"), F.lit(0).alias("lo"), F.lit(length - k).alias("hi"), "c", "ctx", "a", "doc", "th", "at", F.xxhash64(*PLACE).alias("p"))
    return rows.mapInArrow(run, "key long, lo int, hi int, c binary, ctx binary, a int, doc long, th long, at long")


def later(held: DataFrame, places) -> DataFrame:
    """(c, doc, th, at, a, size): of contexts that are no first ones and of later units their stretches, joined where they overlap,
    as rows without c; the other contexts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("c").is_valid().to_numpy(zero_copy_only=False)
            maybe = own & places.value.has(batch.column("p").to_numpy().view(np.uint64))
            kept = batch.filter(pa.array(maybe)).drop_columns(["p"])
            yield kept
            gone = batch.filter(pa.array(~maybe))
            if not gone.num_rows:
                continue
            doc = gone.column("doc").fill_null(0).to_numpy()
            none, th, at, size = (gone.column(c).to_numpy(zero_copy_only=False) for c in ("none", "th", "at", "size"))
            order = np.lexsort((at, th, doc, none))
            doc, none, th, at, size = doc[order], none[order], th[order], at[order], size[order]
            turn = np.r_[True, (doc[1:] != doc[:-1]) | (none[1:] != none[:-1]) | (th[1:] != th[:-1])]
            shift = np.cumsum(turn) * (1 << 40)  # texts one after another, so that a running end serves all
            end = np.maximum.accumulate(at + size + shift)
            opens = turn | np.r_[True, (at + shift)[1:] > end[:-1]]
            first = np.flatnonzero(opens)
            last = np.r_[first[1:], len(at)] - 1
            n = len(first)
            yield pa.record_batch([pa.nulls(n, pa.binary()), gone.column("doc").take(pa.array(order[first])), pa.array(th[first]), pa.array(at[first]), pa.nulls(n, pa.int32()), pa.array(end[last] - shift[last] - at[first]), pa.array(none[first])], schema=kept.schema)

    rows = held.select("c", "doc", "th", "at", "a", "size", F.col("doc").isNull().alias("none"), F.xxhash64(*PLACE).alias("p"))
    return rows.mapInArrow(run, "c binary, doc long, th long, at long, a int, size long, none boolean")


def spans(texts: DataFrame, k: int = SEED, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc, th, start, stop): stretches of texts (doc, th, t) that earlier strings cover; they may overlap."""
    units = first_units(texts, k, length)
    twice = met_twice(texts, units, k, length)
    held = stored(repeated_contexts(texts, units, twice, k, length), "contexts")
    units.destroy()
    twice.destroy()
    there = held.filter("c is not null")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "at", "h")
    firsts = stored(there.groupBy("c").agg(F.min(place).alias("f"), F.count("*").alias("n")).select("c", "n", "f.*"), "firsts")
    sizes = stored(firsts.groupBy(F.col("h").alias("key")).agg(F.count("*").alias("n"), F.lit(length > k).alias("wide")).filter("n > 1"), "sizes")
    places, keys = marks(firsts.select(F.xxhash64(*PLACE).alias("p")), "p"), marks(sizes, "key")
    work = stored(may_repeat(there, keys, places, k, length), "asked")
    keys.destroy()
    told = compared(work, sizes, length, most)
    forget(work, sizes)
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th")) & (F.col("at") == F.col("of_at"))
    of = firsts.select(F.col("c").alias("of_c"), "n", *[F.col(x).alias(f"of_{x}") for x in PLACE[1:]])
    told_of = stored(of.join(told, (F.col("c") == F.col("of_c")) & same, "left").filter("n > 1 or least is not null").select("of_c", "of_doc", "of_th", "of_at", "least", "most"), "told")
    rest = stored(later(held, places), "later")
    places.destroy()
    own = rest.filter("c is not null").join(told_of, F.col("c") == F.col("of_c"))
    start = F.when(same, F.col("at") + F.col("a") - F.col("most")).otherwise(F.col("at"))
    stop = F.when(same, F.col("at") + F.col("a") + length - F.col("least")).otherwise(F.col("at") + F.col("size"))
    whole = rest.filter("c is null").select("doc", "th", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))
    found = stored(own.select("doc", "th", start.alias("start"), stop.alias("stop")).filter("start is not null").unionByName(whole), "spans")
    forget(held, firsts, told, told_of, rest)
    return found


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, length: int = LENGTH, most: int = MOST, few_spans: int = FEW_SPANS) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs of bytes, start and stop) and kept (the other bytes) of every row of `df`.

    The spans of a document go to its text by a broadcast while all documents have at
    most `few_spans` (16 bytes each), else both sides are dealt by document.
    """
    texts = sought(df, id_col, text_col)
    found = spans(texts, seed, length, most)
    every = found.count()
    by_doc = found.groupBy(F.col("doc").alias("of_doc"), F.col("th").alias("of_th")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    by_doc = F.broadcast(by_doc) if every <= few_spans else by_doc
    joined = texts.join(by_doc, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                removed, kept = [], []
                for data, own in zip(some.column("t"), some.column("spans"), strict=True):
                    runs = merged([(s["start"], s["stop"]) for s in own.as_py() or ()])
                    data = data.as_py()
                    edges = [0, *[x for r in runs for x in r], len(data)]
                    removed.append([{"start": s, "stop": e} for s, e in runs])
                    kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                size = pa.array([len(x.as_py()) for x in some.column("t")], pa.int64())
                yield pa.record_batch([some.column("doc"), size, pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("doc", "t", "spans").mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: bigint, stop: bigint>>, kept binary")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of stretches that overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out
