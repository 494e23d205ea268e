"""Hard negatives by inverted lists, exact whatever the lists.

K-means on a bounded sample gives centroids; every row goes to the list of its
nearest one, and each list keeps its radius, the largest distance of a row from
the centroid. By Cauchy-Schwarz no row of a list scores above
`q.c + |q| r` for an anchor q, nor below `q.c - |q| r`. Anchors are asked in
blocks of bounded size against all lists: first the lists with the highest
bounds, which gives a k-th score, then the others, except lists whose bound
falls strictly below that score (an equal one may hold a tie with a smaller
id) and lists outside the window of scores. Within a task the k-th score rises as lists are
visited. Lists are dealt out by range of (list, id), so that a list with a
third of all rows is many tasks.

Scores are products of whole numbers and exact: doubles carry them while they
are below 2^53, 64-bit integers beyond, and more is an error.

Defined results: rows with a null label, a null vector or a component that is
null or not finite take no part. Rows without an id come after all ids on ties
and are no anchors. A row is another row than the anchor if its id differs;
repeated rows count as often as they stand there, repeated anchor rows are asked once.
A window that is empty (a positive score below 0) gives no row. Vectors of
several lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.vectors import EXACT_DOUBLE, EXACT_LONG, doubles, floors, matrix
from gridlens.session import forget, stored

LEAST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ROWS, ASKS = 4096, 256
FOUND = "a int, slot int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def k_means(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k centroids of a sample, from rows at even distances among the different ones."""
    different = np.unique(sample, axis=0).astype(np.float64)
    sample = sample.astype(np.float64)
    centres = different[np.linspace(0, len(different) - 1, min(k, len(different))).astype(int)]
    for _ in range(rounds):
        at = ((centres**2).sum(1)[None, :] - 2 * sample @ centres.T).argmin(1)
        n = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        first = np.r_[0, np.cumsum(n)[:-1]][n > 0]
        centres[n > 0] = np.add.reduceat(sample[order], first) / n[n > 0][:, None]
    return centres


def lists(rows: DataFrame, centres: np.ndarray, scale: int) -> DataFrame:
    """(list, far, vec_id, label, v) of rows (vec_id, label, v): the nearest centroid, the distance from it, whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = floors(matrix(some.column("v"), centres.shape[1]), scale)
                near = ((centres**2).sum(1)[None, :] - 2 * x.astype(np.float64) @ centres.T).argmin(1)
                far = np.sqrt(((x - centres[near]) ** 2).sum(1))
                v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, centres.shape[1], dtype=np.int32) if centres.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(x.ravel()))
                yield pa.record_batch([pa.array(near.astype(np.int32)), pa.array(far), some.column("vec_id"), some.column("label"), v], names=["list", "far", "vec_id", "label", "v"])

    placed = rows.mapInArrow(run, "list int, far double, vec_id long, label long, v array<bigint>")
    return placed.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")


class Best:
    """The k best (score, smaller id) of each of n asks so far, of scores from `least` to `most`."""

    def __init__(self, n: int, k: int, least: np.ndarray, most: np.ndarray):
        self.k, self.least, self.most = k, least.copy(), most
        self.scores, self.ids = np.full((n, k), LEAST), np.full((n, k), LAST)

    def offer(self, asks: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Scores (ask, row) of rows with `ids`, where allowed."""
        fit = allowed & (scores >= self.least[asks][:, None]) & (scores <= self.most[asks][:, None])
        crowded = np.flatnonzero(fit.sum(1) > 4 * self.k)
        if len(crowded):  # of many, only those that reach the k-th of this slice can stay
            kth = np.partition(np.where(fit[crowded], scores[crowded], LEAST), -self.k, axis=1)[:, -self.k]
            fit[crowded] &= scores[crowded] >= kth[:, None]
        i, j = np.nonzero(fit)
        if not len(i):
            return
        touched, back = np.unique(i, return_inverse=True)
        own = asks[touched]
        who = np.r_[back, np.repeat(np.arange(len(own)), self.k)]
        score, name = np.r_[scores[i, j], self.scores[own].ravel()], np.r_[ids[j], self.ids[own].ravel()]
        order = np.lexsort((name, ~score, who))  # ~ turns whole numbers around without overflow
        who, score, name = who[order], score[order], name[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.scores[own[who[keep]], place[keep]] = score[keep]
        self.ids[own[who[keep]], place[keep]] = name[keep]
        self.least[own] = np.maximum(self.least[own], self.scores[own, -1])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT_DOUBLE:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < EXACT_LONG:
        return q @ x.T
    raise OverflowError("scores do not fit 64 bits")


def visit(table: DataFrame, anchors: dict, seen: np.ndarray, k: int, least: np.ndarray, most: np.ndarray, same: bool) -> DataFrame:
    """(a, slot, id, score): what the lists marked in `seen` (anchor, list) hold within [least, most] (anchor, slot), the k best a task."""
    v, labels, names, slots = anchors["v"], anchors["label"], anchors["id"], least.shape[1]
    marks, width = np.packbits(seen, axis=0), v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(v), k, least[:, s], most[:, s]) for s in range(slots)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                places, x = some.column("list").to_numpy(), matrix(some.column("v"), width)
                label = some.column("label").to_numpy()
                ids = some.column("vec_id").fill_null(LAST).to_numpy()
                for c in np.unique(places):
                    part = places == c
                    asked = np.flatnonzero(np.unpackbits(marks[:, c], count=len(v)))
                    for cut in range(0, len(asked), ASKS):
                        own = asked[cut : cut + ASKS]
                        scores = products(v[own], x[part])
                        allowed = ((labels[own][:, None] == label[part][None, :]) == same) & (names[own][:, None] != ids[part][None, :])
                        for b in best:
                            b.offer(own, scores, allowed, ids[part])
        for s, b in enumerate(best):
            a, r = np.nonzero(b.scores > LEAST)
            yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(np.full(len(a), s, np.int32)), pa.array(b.ids[a, r]), pa.array(b.scores[a, r])], names=["a", "slot", "id", "score"])

    reached = [int(c) for c in np.flatnonzero(seen.any(0))]
    some = table if len(reached) == seen.shape[1] else table.filter(F.col("list").isin(reached))
    return some.select("list", "vec_id", "label", "v").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each ask, of those that the tasks found."""
    line = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def search(table: DataFrame, anchors: dict, upper: np.ndarray, lower: np.ndarray, k: int, least: np.ndarray, most: np.ndarray, same: bool, first: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The k best of each ask (anchor, slot), and the tables they come from, in two visits: the `first` lists by upper bound, then those that may still hold one."""
    may = ((upper[:, :, None] >= least[:, None, :]) & (lower[:, :, None] <= most[:, None, :]) & (least <= most)[:, None, :]).any(2)
    order = np.argsort(np.where(may, -upper, np.inf), axis=1, kind="stable")[:, :first]
    early = np.zeros_like(may)
    np.put_along_axis(early, order, True, axis=1)
    one = stored(visit(table, anchors, early & may, k, least, most, same), "visited")
    kth = least.copy()
    for r in ranked(one, k).filter(F.col("rank") == k).collect():  # at most one an ask of the block
        kth[r["a"], r["slot"]] = max(kth[r["a"], r["slot"]], r["score"])
    open_ = ((upper[:, :, None] >= kth[:, None, :]) & (lower[:, :, None] <= most[:, None, :]) & (least <= most)[:, None, :]).any(2)
    two = stored(visit(table, anchors, open_ & ~early, k, kth, most, same), "visited")
    return ranked(one.unionByName(two), k), (one, two)


def mine(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, shifted: int = 7, labels: int = 10, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = 8192, most_lists: int = 1024, block: int = 4096, first: int = 4) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The centroids come from the `sample` rows of least hash, at most one list for
    the square root of all rows; every row is indexed. `block` anchors are asked at a
    time; a block's anchors, their positives and k-th scores are all that the driver holds.
    """
    spark, name = df.sparkSession, F.col(id_col).cast("long")
    label = F.col(label_col).cast("long")
    moved = F.when(name % shifted == 0, (label + 1) % labels).otherwise(label)
    rows = df.select(name.alias("vec_id"), moved.alias("label"), doubles(F.col(vector_col)).alias("v")).filter("label is not null and v is not null")
    sampled = rows.select("v", "vec_id", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id", "v").limit(sample).collect()
    if not sampled:
        return spark.createDataFrame([], RESULT)
    if any(len(r["v"]) != len(sampled[0]["v"]) for r in sampled):
        raise ValueError("vectors of several lengths in one table")
    centres = k_means(floors(np.array([r["v"] for r in sampled], np.float64).reshape(len(sampled), -1), scale), max(1, min(most_lists, int(rows.count() ** 0.5))))
    table = stored(lists(rows, centres, scale), "lists")
    radii = np.zeros(len(centres))
    for r in table.groupBy("list").agg(F.max("far").alias("far")).collect():
        radii[r["list"]] = r["far"]
    asked = table.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v").distinct()
    blocks = -(-asked.count() // block)
    results = []
    for part in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == part).orderBy("vec_id", "label", "v").collect()
        if not some:
            continue
        anchors = {"id": np.array([r["vec_id"] for r in some]), "label": np.array([r["label"] for r in some]), "v": np.array([r["v"] for r in some], np.int64).reshape(len(some), -1)}
        q = anchors["v"].astype(np.float64)
        middle, reach = q @ centres.T, np.linalg.norm(q, axis=1)[:, None] * radii[None, :]
        slack = 1.0 + 1e-9 * (np.abs(middle) + reach)  # more than rounding can take off a bound
        upper, lower = middle + reach + slack, middle - reach - slack
        if max(np.abs(upper).max(), np.abs(lower).max()) >= EXACT_LONG:
            raise OverflowError("scores may not fit 64 bits")
        n = len(some)
        top, held = search(table, anchors, upper, lower, positives, np.full((n, 1), LEAST + 1), np.full((n, 1), LAST), True, first)
        pairs = top.collect()  # at most `positives` an anchor of the block
        forget(*held)
        score = np.full((n, positives), LEAST)
        paired = np.full((n, positives), LAST)
        for r in pairs:
            score[r["a"], r["rank"] - 1], paired[r["a"], r["rank"] - 1] = r["score"], r["id"]
        told = score > LEAST
        if not told.any():
            continue
        least = np.array([[-(-low * int(x) // 100) if ok else LAST for x, ok in zip(a, b, strict=True)] for a, b in zip(score, told, strict=True)])
        most = np.array([[high * int(x) // 100 if ok else LEAST for x, ok in zip(a, b, strict=True)] for a, b in zip(score, told, strict=True)])
        found, held = search(table, anchors, upper, lower, negatives, least, most, False, first)
        positive = spark.createDataFrame([(i, s, int(anchors["id"][i]), None if paired[i, s] == LAST else int(paired[i, s]), int(score[i, s])) for i, s in zip(*np.nonzero(told), strict=True) for i, s in [(int(i), int(s))]], "a int, slot int, anchor_id long, positive_id long, positive_score long")
        one = found.join(F.broadcast(positive), ["a", "slot"])  # bounded by the block
        results.append(stored(one.select("anchor_id", "positive_id", "rank", F.when(F.col("id") != LAST, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
        forget(*held)
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], RESULT)
