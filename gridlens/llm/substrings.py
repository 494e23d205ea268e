"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are the k-word runs whose hash falls in one of `window` classes: which run
is a seed depends on its own words only, so an equal run is a seed in every
text. A seed found in several places is joined to its first place (least
document, then position), and in its own document to the place before it. The
matches of a document with an earlier one are chained: ordered matches, with a
small cost for the gaps between them, by dynamic programming through a Fenwick
tree of prefix maxima. Chains of two matches or more are aligned from a seed on
to both sides, through edits (furthest-reaching points by number of edits, given
up once the score is DROP under its best); of the alignment the longest part
around the seed that keeps `min_identity` counts, if it has `min_words` words.

Seeds alone lose a repeat whose parts stand first in different documents. So
every run of `min_words` words that holds a word outside the passages found, and
whose seeds all have an earlier place, is joined to its own first place in the
corpus (a later place in one document: to the place before it), and aligned from there. (A run with a seed that has no earlier place has
none itself.) Every word of an exact repeat is in a passage.

An alignment works on slices: the words of a chain and MARGIN words to both sides.
If it comes to the end of a slice that is not the end of the text, that pair is
aligned again on the whole texts, so the margin changes no result.

Nulls and edge cases: null and empty texts and texts under k words have no
seeds; a null id takes no part; of rows that repeat an id the longest text counts
(ties: the greatest), the others are neither searched nor cut; a passage that
repeats within a document is found there. Documents with equal texts repeat the one
of least id. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text
from gridlens.session import among, forget, stored

K, WINDOW = 5, 4
MIN_WORDS, MIN_IDENTITY = 50, 0.8
MAX_GAP = 60
#: what a matched word of a chain is worth in skipped words: one seed pays for the longest gap.
WORTH = 32
#: an edit costs so many matched words, and an end is given up that far under its best.
EDIT, DROP = 2, 20
MARGIN = 96
BITS = 28
PASSAGE = "doc_id long, start long, stop long, first_doc long, first_start long, first_stop long, matched long"
SLICES = "doc long, first_doc long, ps binary, fs binary, f_low long, f_high long, at long, before boolean, after boolean, a binary"
_ODD = 0x9E3779B97F4A7C15


def sampled(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the seeds of one word sequence."""
    h = text.grams(words, k)
    at = np.flatnonzero((h >> np.uint64(7)) % np.uint64(window) == 0)
    return h[at], at.astype(np.int64)


def seeds(docs: DataFrame, k: int, window: int) -> tuple[DataFrame, object]:
    """The seeds that may repeat (seed, doc, pos, before), and the bitmap of those that do.

    Texts are read twice: seeds alone are counted first, so that only those in the
    bitmap are written and dealt out with their places."""

    def find(bits):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                h, at = text.batch_words(batch["text"])
                parts = []
                for doc, i, j in zip(batch["doc_id"], at, at[1:], strict=False):
                    g, p = sampled(h[i:j], k, window)
                    if bits is not None and len(g):
                        here = within(bits.value, g)
                        g, p = g[here], p[here]
                    if len(g):
                        parts.append((doc, g, p))
                if parts and bits is None:
                    yield pd.DataFrame({"seed": np.concatenate([p[1] for p in parts]).view(np.int64)})
                elif parts:
                    yield pd.DataFrame(
                        {
                            "seed": np.concatenate([p[1] for p in parts]).view(np.int64),
                            "doc": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int64),
                            "pos": np.concatenate([p[2] for p in parts]),
                            "before": np.concatenate([before(p[1], p[2]) for p in parts]),
                        }
                    )

        return run

    twice = docs.mapInArrow(text.in_slices(find(None), "seed long"), "seed long").groupBy("seed").count().filter("count > 1")
    bits = bitmap(twice, "seed")
    return stored(docs.mapInArrow(text.in_slices(find(bits), "seed long, doc long, pos long, before long"), "seed long, doc long, pos long, before long"), "seeds"), bits


def before(h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each seed of a document the place of the same seed before it, or -1."""
    order = np.lexsort((pos, h))
    out = np.full(len(h), -1, np.int64)
    same = h[order][1:] == h[order][:-1]
    out[order[1:][same]] = pos[order[:-1][same]]
    return out


def stretch_ends(pos: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which places begin or end a stretch of neighbouring places whose places before are neighbours too."""
    on = (np.diff(pos) == 1) & (np.diff(own) == 1) & (own[:-1] >= 0) if len(pos) else np.empty(0, bool)
    return (own >= 0) & ~(np.r_[False, on][: len(pos)] & np.r_[on, False][: len(pos)])


def repeated(found: DataFrame) -> DataFrame:
    """(seed, first, hi): first place and last document of every seed with two places or more."""
    return found.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("hi"), F.count("*").alias("n")).filter("n > 1").drop("n")


def matches(found: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, pos, first_doc, first_pos): every seed with its first place in an earlier
    document, and with the place before it in its own (so that a short period is one
    long passage, a period behind itself)."""
    other = found.join(first.filter("first.doc < hi").drop("hi").hint("merge"), "seed").filter("doc <> first.doc").select("doc", "pos", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    own = found.filter("before >= 0").select("doc", "pos", F.col("doc").alias("first_doc"), F.col("before").alias("first_pos"))
    return other.union(own)


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-(1 << 60), -1)] * (n + 1)

    def put(self, i: int, value: tuple[int, int]) -> None:
        i += 1
        while i <= self.n:
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[int, int]:
        """The best over positions 0..i."""
        i, out = i + 1, (-(1 << 60), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def _apart(run: np.ndarray, side: np.ndarray, gap: int) -> list[np.ndarray]:
    """A run cut where neighbours on one side are further apart than `gap`."""
    run = run[np.argsort(side[run], kind="stable")]
    return np.split(run, np.flatnonzero(np.diff(side[run]) > gap) + 1)


def chains(pos: np.ndarray, first: np.ndarray, k: int = K, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Chains of matches (indices, in order), each match in one at most.

    The score of a chain is WORTH k for each match less the words skipped on either
    side; as the skipped words of a gap are the difference of pos + first, each
    match enters the tree with that sum added, and a prefix maximum over `first`
    finds its best predecessor. Runs of matches further apart than `max_gap`
    words in either document never join, so each run has a tree of its own.
    """
    order = np.lexsort((first, pos))
    pos, first = pos[order], first[order]
    steps = np.diff(pos), np.diff(first)
    if all((d > 0).all() and (d <= max_gap + k).all() for d in steps):
        return [order]  # one ordered run: every match pays for its gap, so all belong to the best chain
    out, runs = [], [np.arange(len(pos))]
    for side in (pos, first, pos):
        runs = [np.sort(part) for run in runs for part in _apart(run, side, max_gap + k)]
    for run in runs:
        ranks = np.unique(first[run], return_inverse=True)[1].tolist()
        p, f = pos[run].tolist(), first[run].tolist()
        tree, score, back = Fenwick(len(run)), [0] * len(run), [-1] * len(run)
        i = 0
        while i < len(run):
            j = i
            while j < len(run) and p[j] == p[i]:
                j += 1
            for x in range(i, j):
                at, prev = tree.top(ranks[x] - 1) if ranks[x] else (0, -1)
                gain = at - (p[x] + f[x]) + WORTH * k if prev >= 0 else 0
                fits = prev >= 0 and p[x] - p[prev] <= max_gap + k and f[x] - f[prev] <= max_gap + k
                score[x] = WORTH * k + (gain if fits and gain > 0 else 0)
                back[x] = prev if fits and gain > 0 else -1
            for x in range(i, j):
                tree.put(ranks[x], (score[x] + p[x] + f[x], x))
            i = j
        used = [False] * len(run)
        for x in sorted(range(len(run)), key=lambda v: -score[v]):
            chain = []
            while x >= 0 and not used[x]:
                used[x] = True
                chain.append(x)
                x = back[x]
            if chain:
                out.append(order[run[chain[::-1]]])
    return out


def extend(a: list[int], b: list[int], low: int, high: int) -> tuple[list[tuple[int, int, int, int]], bool, bool]:
    """Equal runs of an alignment of prefixes of a and b: (place in a, place in b, words, edits up to there),
    and whether the search came to the end of a, and of b.

    Point (e, d) is the furthest place in `a` that e edits reach on diagonal d (place in
    a less place in b, low <= d <= high). The alignment ends at the best score, EDIT an
    edit less than the words that agree; points DROP under the best are given up.
    """
    n, m, waves, best = len(a), len(b), [], (0, 0, 0, 0)
    wave, top = {0: (0, 0)}, 0
    end_a = end_b = False
    while wave:
        here = {}
        e = len(waves)
        for d, (i, came) in wave.items():
            j = i - d
            start = i
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            end_a |= i >= n
            end_b |= j >= m
            s = (i + j) // 2 - (EDIT + 1) * e
            if s >= top - DROP:
                here[d] = (start, i, came)
                if s > top:
                    top, best = s, (s, e, d, i)
        waves.append(here)
        wave = {}
        for d, (_, i, _) in here.items():
            for to, at in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):
                if low <= to <= high and at <= n and at - to <= m and (to not in wave or at > wave[to][0]):
                    wave[to] = (at, d)
    _, e, d, _ = best
    out = []
    while e >= 0:
        start, stop, came = waves[e][d]
        out.append((start, start - d, stop - start, e))
        d, e = came, e - 1
    return [r for r in out[::-1] if r[2]], end_a, end_b


class Slice:
    """Words [at, at + len(words)) of a text; `more`: whether the text goes on before and after them."""

    def __init__(self, words: bytes, at: int = 0, before: bool = False, after: bool = False):
        self.words, self.at, self.more = np.frombuffer(words, np.uint64).tolist(), at, (before, after)


def around(a: Slice, b: Slice, p: int, f: int, own: bool, min_identity: float) -> tuple[int, int, int, int, int] | None:
    """(start, stop, first_start, first_stop, edits) of the longest alignment through word p of a
    and word f of b that keeps min_identity, or None if a slice is too short to tell.
    `own`: b is a, which must not be aligned with itself."""
    far = len(a.words) + len(b.words)
    shift, x, y = p - f, p - a.at, f - b.at
    right, end_a, end_b = extend(a.words[x:], b.words[y:], 1 - shift if own else -far, far)
    if end_a and a.more[1] or end_b and b.more[1]:
        return None
    left, end_a, end_b = extend(a.words[:x][::-1], b.words[:y][::-1], -far, shift - 1 if own else far)
    if end_a and a.more[0] or end_b and b.more[0]:
        return None
    rights = [(x + n, y + n, e) for x, y, n, e in right] or [(0, 0, 0)]
    lefts = [(0, 0, 0), *[(x + n, y + n, e) for x, y, n, e in left]]
    x, y = lefts[-1], rights[-1]
    if x[2] + y[2] > x[0] + y[0] - min_identity * (x[0] + y[0]):
        most, spare = np.array([v[0] for v in lefts]), np.array([v[0] - v[2] - min_identity * v[0] for v in lefts])
        best = -1
        for v in rights:  # the first run of the right side is the seed itself and always stays
            fits = np.where(spare + (v[0] - v[2] - min_identity * v[0]) > -1e-9, most, -1)
            at = int(fits.argmax())
            if fits[at] >= 0 and fits[at] + v[0] > best:
                best, x, y = fits[at] + v[0], lefts[at], v
    return p - x[0], p + y[0], f - x[1], f + y[1], x[2] + y[2]


def align(a: Slice, b: Slice, pos: list[int], first: list[int], own: bool, k: int = K, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, run: int | None = None) -> list[tuple[int, int, int, int, int]] | None:
    """(start, stop, first_start, first_stop, edits) of the passages through the matches of a pair; None as in `around`.
    `run`: matches are runs of so many words, and those wholly within the passages found so far are done."""
    found, seen, done = [], [], bytearray(len(a.words))
    for p, f in zip(pos, first, strict=True):
        if run and 0 not in done[p - a.at : p - a.at + run]:
            continue
        x, y = p - a.at, f - b.at
        if a.words[x : x + k] != b.words[y : y + k] or x + k > len(a.words) or any(s <= p and p + (run or k) <= e and fs <= f and f + (run or k) <= fe and abs((p - f) - (s - fs)) <= 2 * edits for s, e, fs, fe, edits in seen):
            continue
        one = around(a, b, p, f, own, min_identity)
        if one is None:
            return None
        seen.append(one)
        s, e, _, _, edits = one
        if e - s >= min_words and e - s - edits >= min_identity * (e - s):
            found.append(one)
            done[s - a.at : e - a.at] = bytes([1]) * (e - s)
    return found


def bitmap(df: DataFrame, column: str):
    """Which of 2**BITS classes the values of a column fall in, broadcast; its size does not grow with the table."""
    cells = df.select(F.shiftrightunsigned(column, 64 - BITS).alias("c")).groupBy(F.expr("c >> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(c & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[cells["at"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)


def within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = h >> np.uint64(64 - BITS)
    return (bits[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1) > 0


def long_runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, at a cost that does not grow with n."""
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(words), _ODD, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - n, pow(_ODD, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(words * up[:-1], dtype=np.uint64)]
    return text.mix((total[n:] - total[:-n]) * down)


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flags)]


def _packed(positions: Column) -> Column:
    """An array of places as one binary, four bytes each, highest first."""
    return F.to_binary(F.array_join(F.transform(positions, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit("hex"))


def exact_runs(source: DataFrame, found: DataFrame, met: DataFrame, seen, k: int, window: int, n: int) -> DataFrame:
    """(doc, pos, first_doc, first_pos): runs of n words that no passage of `found` holds whole, with their first place.
    Runs with a seed that does not repeat (`seen`), or has no earlier place (not in `met`), have none themselves.
    Of a run with several such places in a document the first is joined to the corpus, and each later one to the place
    before it (`own`), of which the first and last of every stretch are given: a word said a thousand times asks once."""
    cuts = spans(found).groupBy(F.col("doc_id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    hits = met.groupBy(F.col("doc").alias("doc_id")).agg(_packed(F.collect_set("pos")).alias("hits"))
    marks = stored(hits.join(cuts, "doc_id", "left"), "marks")

    def runs(asked):
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                h, at = text.batch_words(batch["text"])
                marked = zip(batch["cuts"], batch["hits"], strict=True) if asked is None else [(None, None)] * len(batch)
                parts = []
                for doc, (cuts, hits), i, j in zip(batch["doc_id"], marked, at, at[1:], strict=False):
                    if j - i < n:
                        continue
                    words = h[i:j]
                    g, p = sampled(words, k, window)
                    odd = np.zeros(len(words), bool)
                    if asked is None:
                        odd[p] = True
                        if hits is not None:
                            odd[np.frombuffer(hits, ">u4")] = False
                    else:
                        odd[p[~within(seen.value, g)]] = True
                    odd = _counts(odd)
                    fits = odd[n - k + 1 : len(words) - k + 2] == odd[: len(words) - n + 1]
                    if asked is None:
                        free = np.ones(len(words), bool)
                        for c in cuts if cuts is not None else ():
                            free[c["start"] : c["stop"]] = False
                        free = _counts(free)
                        fits &= free[n:] > free[:-n]
                    if not fits.any():
                        continue
                    r = long_runs(words, n)
                    if asked is not None:
                        fits &= within(asked.value, r)
                    p = np.flatnonzero(fits)
                    own = before(r[p], p)
                    kept = own < 0 if asked is not None else (own < 0) | stretch_ends(p, own)
                    parts.append((doc, r[p[kept]], p[kept], own[kept]))
                if parts:
                    yield pd.DataFrame({"run": np.concatenate([x[1] for x in parts]).view(np.int64), "doc": np.repeat([x[0] for x in parts], [len(x[2]) for x in parts]).astype(np.int64), "pos": np.concatenate([x[2] for x in parts]), "own": np.concatenate([x[3] for x in parts])})

        return find

    schema = "run long, doc long, pos long, own long"
    inside = stored(source.join(marks.hint("merge"), "doc_id", "left").mapInArrow(text.in_slices(runs(None), schema), schema), "asked")
    asked = inside.filter("own < 0")
    least = stored(source.mapInArrow(text.in_slices(runs(bitmap(asked, "run")), schema), schema).groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    forget(marks)
    other = asked.join(least, "run").filter("struct(doc, pos) <> first").select("doc", "pos", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    return other.union(inside.filter("own >= 0").select("doc", "pos", F.col("doc").alias("first_doc"), F.col("own").alias("first_pos")))


def chained(links: DataFrame, pick, least: int) -> DataFrame:
    """(doc, first_doc, ps, fs): of each pair of documents with `least` matches or more the matches that `pick` (of pos, first) leaves."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc", "first_doc", "ps", "fs"]

        def of(rows: list[np.ndarray]) -> pd.DataFrame:
            doc, first_doc, pos, first = rows
            cuts = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (first_doc[1:] != first_doc[:-1])) + 1, len(doc)]
            long, found = np.flatnonzero(np.diff(cuts) >= least), []
            for x, y in zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
                if len(c := pick(pos[x:y], first[x:y])):
                    found.append((doc[x], first_doc[x], pos[x:y][c].astype("<i8").tobytes(), first[x:y][c].astype("<i8").tobytes()))
            return pd.DataFrame(found, columns=columns).astype({"doc": "int64", "first_doc": "int64"})

        held = None
        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("doc", "first_doc", "pos", "first_pos")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = int(np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])[-1]) if len(rows[0]) else 0
            held = [x[last:] for x in rows]
            if last:
                yield of([x[:last] for x in rows])
        if held is not None and len(held[0]):
            yield of(held)

    return links.repartition("doc", "first_doc").sortWithinPartitions("doc", "first_doc", "pos").mapInPandas(chain, "doc long, first_doc long, ps binary, fs binary")


def aligned(source: DataFrame, links: DataFrame, pick, least: int, k: int, min_words: int, min_identity: float, run: int | None = None) -> DataFrame:
    """Passages through the matches of each pair of documents, stored."""
    chains_ = stored(chained(links, pick, least), "chains")
    firsts = stored(chains_.select(F.col("first_doc").alias("doc_id")).distinct(), "firsts")

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, at = text.batch_words(batch["text"])
            yield pd.DataFrame({"first_doc": batch["doc_id"], "words": [h[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]})

    words = stored(among(source, firsts, "doc_id").mapInArrow(text.in_slices(sequences, "first_doc long, words binary"), "first_doc long, words binary"), "words")
    done = stored(measured(source, chains_, words, MARGIN, k, min_words, min_identity, run), "measured")
    again = stored(done.filter("start is null").select("doc_id", "first_doc").distinct(), "again")
    result = done.filter("start is not null")
    if again.count():
        rest = chains_.join(again.withColumnRenamed("doc_id", "doc"), ["doc", "first_doc"], "left_semi")
        result = result.union(stored(measured(source, rest, words, None, k, min_words, min_identity, run), "measured"))
    forget(chains_, words)
    return result


def measured(source: DataFrame, chains_: DataFrame, words: DataFrame, margin: int | None, k: int, min_words: int, min_identity: float, run: int | None) -> DataFrame:
    """Passages of the chains, aligned on slices of `margin` words around them (None: on whole texts);
    of a pair whose slices are too short one row with a null start. Joins with texts and
    words are merges at every size, as both sides grow with the corpus."""
    low = F.lit(0) if margin is None else F.greatest(F.lit(0), F.col("f_low") - margin)
    high = F.col("n") if margin is None else F.least(F.col("n"), F.col("f_high") + k + margin)
    asks = chains_.groupBy("doc").agg(F.collect_list(F.struct("first_doc", "ps", "fs")).alias("asks"))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc", "first_doc", "ps", "fs", "f_low", "f_high", "at", "before", "after", "a"]
        for batch in batches:
            h, at = text.batch_words(batch["text"])
            found = []
            for doc, asks, i, j in zip(batch["doc_id"], batch["asks"], at, at[1:], strict=False):
                for ask in asks:
                    p, f = np.frombuffer(ask["ps"], "<i8"), np.frombuffer(ask["fs"], "<i8")
                    x, y = (0, int(j - i)) if margin is None else (max(0, int(p.min()) - margin), min(int(j - i), int(p.max()) + k + margin))
                    found.append((doc, ask["first_doc"], ask["ps"], ask["fs"], int(f.min()), int(f.max()), x, x > 0, y < j - i, h[i + x : i + y].tobytes()))
                if len(found) >= 5_000:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            if found:
                yield pd.DataFrame(found, columns=columns)

    wide = source.join(asks.withColumnRenamed("doc", "doc_id").hint("merge"), "doc_id")
    mine = wide.mapInArrow(text.in_slices(slices, SLICES), SLICES)
    both = mine.join(words.hint("merge"), "first_doc").withColumn("n", (F.length("words") / 8).cast("long")).withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    pairs = both.select("doc", "first_doc", "ps", "fs", "at", "before", "after", "a", "low", "n", "high", F.expr("substring(words, cast(low * 8 + 1 as int), cast((high - low) * 8 as int))").alias("b"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc, first_doc, ps, fs, at, before, after, a, low, n, high, b in batch.itertuples(index=False):
                got = align(Slice(a, at, before, after), Slice(b, low, low > 0, high < n), np.frombuffer(ps, "<i8").tolist(), np.frombuffer(fs, "<i8").tolist(), doc == first_doc, k, min_words, min_identity, run)
                if got is None:
                    found.append((doc, None, None, first_doc, None, None, None))
                else:
                    found += [(doc, s, e, first_doc, x, y, e - s - edits) for s, e, x, y, edits in got]
            yield pd.DataFrame(found, columns=["doc_id", "start", "stop", "first_doc", "first_start", "first_stop", "matched"]).astype(dict.fromkeys(["start", "stop", "first_start", "first_stop", "matched"], "Int64"))

    return pairs.mapInPandas(measure, PASSAGE)


def repeated_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id__, mark__): of ids on several rows the text that counts, the longest, by its hash."""
    ids = docs.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).alias("t")).filter("id__ is not null")
    again = stored(ids.groupBy("id__").count().filter("count > 1").select("id__"), "again")
    rows = among(ids, again, "id__", most=200_000)
    return stored(rows.groupBy("id__").agg(F.max(F.struct(F.length("t").alias("n"), "t")).alias("top")).select("id__", F.xxhash64("top.t").alias("mark__")), "marks")


def counted(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): one row for each id that is not null."""
    rows = docs.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).alias("text")).filter("id__ is not null")
    if marks.count():
        kept = among(rows, marks, "id__", "inner", most=200_000).filter(F.xxhash64("text") == F.col("mark__")).groupBy("id__").agg(F.max("text").alias("text"))
        rows = among(rows, marks, "id__", "left_anti", most=200_000).unionByName(kept)
    return rows.withColumnRenamed("id__", "doc_id")


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Repeated passages: words [start, stop) of doc_id repeat [first_start, first_stop) of first_doc.

    Shuffles: seeds by hash (counted; those that repeat are then joined, and
    a hot seed is split by the join), matches by document pair, slices around chains by first document,
    and long runs outside the passages of the seeds.
    """
    source = counted(docs, repeated_ids(docs, id_col, text_col), id_col, text_col)
    found, seen = seeds(source, k, window)
    first = stored(repeated(found), "first")  # the join then shuffles plain rows, of which AQE splits a hot seed
    met = stored(matches(found, first), "matches")
    forget(found, first)

    def in_chains(pos: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *[c for c in chains(pos, at, k) if len(c) > 1]]).astype(np.int64)

    def all_(pos: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.arange(len(pos))

    fuzzy = aligned(source, met, in_chains, 2, k, min_words, min_identity)
    runs = exact_runs(source, fuzzy, met, seen, k, window, min_words)
    exact = aligned(source, runs, all_, 1, k, min_words, min_identity, min_words)
    forget(met)
    return fuzzy.union(exact)


def spans(found: DataFrame) -> DataFrame:
    """The union of the passages of each document: doc_id, start, stop, n_words."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.select("doc_id", "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"))


def cut(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated passages taken out of their texts; the first copy stays.

    A document of which nothing is left goes; one that had no words stays, and so do
    rows of a repeated id whose text is not the one that counts.
    """
    id_, cuts_, mark_ = (text.fresh(docs, name) for name in ("id", "cuts", "mark"))
    lists = spans(found).groupBy(F.col("doc_id").alias("id__")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts_))
    cuts = stored(lists.join(repeated_ids(docs, id_col, text_col).withColumnRenamed("mark__", mark_), "id__", "left").withColumnRenamed("id__", id_), "cuts")
    joined = among(docs.withColumn(id_, F.col(id_col).cast("long")), cuts, id_, "left", most=200_000).drop(id_)
    ours = F.col(cuts_).isNotNull() & (F.col(mark_).isNull() | (F.col(mark_) == F.xxhash64(F.col(text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, places in zip(batch.column(text_col).to_pylist(), batch.column(cuts_).to_pylist(), strict=True):
                data = text.encode(t)
                _, s, e = text.words_of(data)
                out, at = [], 0
                for c in places:
                    out.append(data[at : s[c["start"]]])
                    at = int(e[c["stop"] - 1])
                texts.append((b"".join(out) + data[at:]).decode("utf-8", "replace"))
            names = [n for n in batch.schema.names if n != cuts_]
            columns = [pa.array(texts, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    changed = joined.filter(ours).drop(mark_).mapInArrow(run, docs.schema)
    return joined.filter(~ours).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(changed)
