"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit distance.

A document is contaminated by an item if some window of it lies within
floor(rate x item words) word edits of the item. Windows as long as an item are
taken at every word. The CGK random walk embeds a word sequence: at each step it
puts out the word it stands on and moves on if a random bit of (step, word) says
so, which turns edits into few differing places. Each of `repeats` walks samples
a few places of the embedding into a bucket key; windows and items that share a
key are compared by exact edit distance. The samples and repeats are set for each item
length so that simulated pairs at the full distance are found with probability
`recall` or more (held against planted passages in tests).

Before windows are embedded, the q-gram count bound drops those that cannot
match: d edits leave at least n - q + 1 - qd of an item's n - q + 1 runs of q
words (q = 2 and 3). It loses nothing and keeps the work on clean text to a few
array operations. Case and punctuation are no part of a word.

The benchmark is the stated query set: it is taken in blocks of `block` items,
each block against all documents, so what a task holds is bounded however large
the benchmark is. Documents are read in one narrow pass a block, no shuffle.

Nulls and edge cases: null and empty texts match nothing; items under
`min_item_words` words cannot be told from chance and match nothing; an
item in a script without spaces is few words. Texts of any length are searched whole.
Repeated items and documents give a row each; null ids are carried along; an empty table
gives no rows; of windows at the same distance the first counts. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text
from gridlens.session import stored

RATE = 0.2
RECALL = 0.99
#: places a repeat samples, most first: fewer are taken where a length would need over MANY repeats.
SAMPLES, MANY = (3, 2, 1), 128
#: simulated pairs and walks of each by which the repeats of a length are set.
PAIRS, TRIALS = 48, 128
FOUND = "doc_id long, item_id long, start long, words long, edits long"
_OTHER = re.compile(r"\W+")
_ODD = np.uint64(0xD6E8FEB86659FD93)


def plain(t: str | None) -> str:
    """Letters and digits in lower case, everything else white space."""
    return _OTHER.sub(" ", t.lower()) if isinstance(t, str) else ""


class Walks:
    """The random walks and the places each repeat samples, made from a seed for each item length."""

    def __init__(self, rate: float = RATE, recall: float = RECALL, seed: int = 4):
        self.rate, self.recall, self.seed = rate, recall, seed
        self.lanes = np.random.default_rng(seed).integers(1, 2**63, max(SAMPLES), np.uint64) | np.uint64(1)
        self.plans: dict[int, tuple[int, int]] = {}

    def plan(self, n: int) -> tuple[int, int]:
        """(samples, repeats) with which items of n words at the full distance reach the recall.

        Measured on PAIRS simulated pairs: of each, how often a walk agrees in a place of
        the embedding, which gives the chance of a repeat to put both in one bucket.
        """
        if n not in self.plans:
            rng = np.random.default_rng([self.seed, n, 1])
            items, near = zip(*(self._pair(n, rng) for _ in range(PAIRS)), strict=True)
            both = np.concatenate([np.stack(items), np.stack(near)])
            same = np.zeros((TRIALS, PAIRS))
            for word in self._walked(both, rng.integers(0, 2**63, (2 * n, TRIALS, 1), np.uint64)):
                same += (word[:, :PAIRS] == word[:, PAIRS:]) & (word[:, :PAIRS] > 0)
            share = same / (2 * n)
            for samples in SAMPLES:
                chance, repeats = (share**samples).mean(0), 1
                while ((1 - chance) ** repeats).mean() > 1 - self.recall:
                    repeats += 1
                if repeats <= MANY or samples == SAMPLES[-1]:
                    break
            self.plans[n] = samples, repeats
        return self.plans[n]

    def _pair(self, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
        item = rng.integers(1, 2**63, n, np.uint64)
        words = item.tolist()
        for _ in range(int(self.rate * n)):
            at, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[at : at + 1] = [[], [int(rng.integers(1, 2**63))], [words[at], int(rng.integers(1, 2**63))]][kind]
        words += rng.integers(1, 2**63, n, np.uint64).tolist()
        return item, np.array(words[:n], np.uint64)

    def _walked(self, windows: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        """For each step the words that the walks stand on; 0 past the end."""
        m, n = windows.shape
        padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
        at, row = np.zeros((bits.shape[1], m), np.int64), np.arange(m)
        for turn in bits:
            word = padded[row, at]
            yield word
            at = np.minimum(at + ((word ^ turn) * _ODD >> np.uint64(63)).astype(np.int64), n)

    def keys(self, windows: np.ndarray, side: int) -> np.ndarray:
        """(repeats, m) bucket keys of m word sequences of one length. A place past the end of a
        sequence agrees with none of the other side (0: items, 1: windows)."""
        m, n = windows.shape
        samples, repeats = self.plan(n)
        rng = np.random.default_rng([self.seed, n])
        bits = rng.integers(0, 2**63, (2 * n, repeats, 1), np.uint64)
        places = np.sort(rng.integers(0, 2 * n, (repeats, samples)), axis=1)
        total = np.zeros((repeats, m), np.uint64)
        for j, word in enumerate(self._walked(windows, bits[: int(places.max()) + 1])):
            for k in range(samples):
                hit = np.flatnonzero(places[:, k] == j)
                if len(hit):
                    here = word[hit]
                    total[hit] += text.mix(np.where(here > 0, here, np.uint64(side))) * self.lanes[k]
        return text.mix(total + (np.arange(repeats, dtype=np.uint64) * _ODD)[:, None])


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(edits, words used) of the item against the best beginning of the window."""
    if len(window) >= len(item) and np.array_equal(item, window[: len(item)]):
        return 0, len(item)
    steps = np.arange(len(window) + 1)
    row, best = steps.copy(), steps.copy()
    for i, x in enumerate(item, 1):
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (window != x), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """A block of items: word sequences, their pairs of words, and bucket keys by length."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float, min_item_words: int, walks: Walks):
        self.walks, self.rate = walks, rate
        h, at = text.batch_words([plain(t) for _, t in items])
        self.items: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (item, _), i, j in zip(items, at, at[1:], strict=False):
            if j - i >= min_item_words:
                self.items.setdefault(int(j - i), []).append((item, h[i:j]))
        self.postings = {q: self._postings(q) for q in (2, 3)}
        self.keys: dict[int, dict[int, list[int]]] = {}
        for n, group in self.items.items():
            known = self.keys[n] = {}
            for row in walks.keys(np.stack([w for _, w in group]), 0):
                for k, key in enumerate(row.tolist()):
                    known.setdefault(key, []).append(k)

    def _postings(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted grams, where each one's items begin, the items, and by item its length and least count.

        An item is under q = 3 if that leaves a count to ask for, else under q = 2.
        """
        grams, owner, length, least = [], [], [], []
        for n, group in self.items.items():
            d = int(self.rate * n)
            if (3 if n - 2 - 3 * d > 0 else 2) != q:
                continue
            for _, words in group:
                g = np.unique(text.grams(words, q))
                grams.append(g)
                owner.append(np.full(len(g), len(length)))
                length.append(n)
                least.append(max(1, n - q + 1 - q * d))
        if not grams:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none, none, none
        g, o = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(g, kind="stable")
        values, first = np.unique(g[order], return_index=True)
        return values, np.r_[first, len(g)], o[order], np.array(length), np.array(least)

    def _starts(self, h: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, the starts of windows that hold enough grams of one item."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (values, first, owner, length, least) in self.postings.items():
            g = text.grams(h, q)
            if not len(values) or not len(g):
                continue
            known = np.minimum(np.searchsorted(values, g), len(values) - 1)
            pos = np.flatnonzero(values[known] == g)
            doc = np.searchsorted(at, pos, "right") - 1
            inside = pos + q <= at[doc + 1]
            pos, doc = pos[inside], doc[inside]
            many = first[known[pos] + 1] - first[known[pos]]
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item = owner[np.repeat(first[known[pos]], many) + offset]
            pos, doc = np.repeat(pos, many), np.repeat(doc, many)
            order = np.lexsort((pos, item))
            pos, doc, item = pos[order], doc[order], item[order]
            j = np.arange(len(pos)) + least[item] - 1
            ok = j < len(pos)
            e, j = np.flatnonzero(ok), j[ok]
            room = length[item[e]] - q
            ok = (item[j] == item[e]) & (doc[j] == doc[e]) & (pos[j] - pos[e] <= room)
            e, j, room = e[ok], j[ok], room[ok]
            low = np.maximum(at[doc[e]], pos[j] - room)
            for n in np.unique(length[item[e]]).tolist():
                own = length[item[e]] == n
                lo, hi = low[own], pos[e][own]
                size = hi - lo + 1
                found.setdefault(n, []).append(np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        return {n: np.unique(np.concatenate(parts)) for n, parts in found.items()}

    def search(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, start, words, edits): the closest window of each pair, over a batch of documents."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, starts in self._starts(h, at).items() if self.items else ():
            d = int(self.rate * n)
            doc = np.searchsorted(at, starts, "right") - 1
            stop = np.minimum(at[doc + 1], starts + n)
            near = stop - starts >= n - d
            starts, doc, stop = starts[near], doc[near], stop[near]
            for cut in range(0, len(starts), 512):
                self._block(h, at, n, d, self.items[n], starts[cut : cut + 512], doc[cut : cut + 512], stop[cut : cut + 512], best)
        for (k, item), (edits, start, words) in best.items():
            yield k, item, start, words, edits

    def _block(self, h, at, n, d, group, starts, doc, stop, best) -> None:
        place = starts[:, None] + np.arange(n)
        inside = place < stop[:, None]
        windows = np.where(inside, h[np.minimum(place, len(h) - 1)], np.uint64(0))
        candidates = set()
        known = self.keys[n]
        for row in self.walks.keys(windows, 1):
            for w, key in enumerate(row.tolist()):
                for k in known.get(key, ()):
                    candidates.add((w, k))
        for w, k in sorted(candidates, key=lambda c: (not np.array_equal(group[c[1]][1], windows[c[0]]), c)):
            item, words = group[k]
            where = int(doc[w])
            if best.get((where, item), (n,))[0] == 0:
                continue
            begin = int(starts[w])
            edits, used = edit_distance(words, h[begin : min(int(at[where + 1]), begin + n + d)])
            if edits <= d:
                found = (edits, begin - int(at[where]), used)
                if found < best.get((where, item), (n + 1, 0, 0)):
                    best[where, item] = found


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_item_words: int = 5, block: int = 20_000, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start (word), words, edits of every item that a document holds."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    blocks = max(1, -(-items.count() // block))
    source = docs.select(text.as_key(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))

    walks = Walks(rate, recall)

    def against(part: int) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == part).collect()
        index = Index([(r["i"], r["t"]) for r in rows], rate, min_item_words, walks)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            text.let_go()
            for batch in batches:
                h, at = text.batch_words([plain(t) for t in batch["text"]])
                ids = text.exact(batch["doc_id"])
                found = [(k, item, start, words, edits) for k, item, start, words, edits in index.search(h, at)]
                yield pd.DataFrame([x[2:] for x in found], columns=["start", "words", "edits"]).assign(doc_id=text.longs([ids[x[0]] for x in found]), item_id=text.longs([x[1] for x in found]))

        return source.mapInPandas(run, FOUND)

    if blocks == 1:
        return against(0)
    return reduce(DataFrame.unionByName, [stored(against(b), "found") for b in range(blocks)])  # one after the other
