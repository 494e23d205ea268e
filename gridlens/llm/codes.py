"""Vector code compression: each part of a vector as the index of its nearest codebook entry.

The codebooks, of a size set by parameters alone, are broadcast with the task's
function. Arrow batches take all squared distances of a slice by norm expansion,
|x|^2 - 2 x.c + |c|^2, with exact 64-bit matrix products, and the first index
of the least. Every task adds up its parts by entry; these sums are merged by a
grouped shuffle each round, and only the merged sums, as many as the codebooks
have numbers, reach the driver.

Defined results: a null vector or one with a null, NaN or infinite component is
left out. A null vec_id comes last among the first entries; rows of one vec_id
are ordered by their vectors. With fewer rows than entries the codebooks are
that short; an empty table gives an empty result. Null labels are one label.
Vectors of several lengths, or of a length that the parts do not divide, and
components whose squared distances pass 64 bits, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.vectors import doubles, floors, matrix
from gridlens.session import stored

SLICE = 4096
CODED = "vec_id long, label {label}, code string, error long"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of the least squared distance, that distance) of each row of `x` to the entries of `book`."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * peak * peak * max(1, x.shape[1]) >= 2**63:
        raise OverflowError("squared distances do not fit 64 bits")
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def parted(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, each with its integer vectors cut into parts (part, row, place)."""
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            x = floors(matrix(some.column("v"), parts * width), scale)
            yield some, np.ascontiguousarray(x.reshape(-1, parts, width).swapaxes(0, 1))


def entry_sums(rows: DataFrame, books: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the parts that fall to each entry, over all rows."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for _, cut in parted(batches, books, scale):
            for p in range(parts):
                at, _ = nearest(cut[p], books[p])
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(order) else order
                if len(order):
                    sums[p, at[order[first]], :width] += np.add.reduceat(cut[p][order], first)
                    sums[p, :, width] += np.bincount(at, minlength=entries)
        slot = np.flatnonzero(sums)
        yield pa.record_batch({"slot": pa.array(slot, pa.int64()), "value": pa.array(sums.ravel()[slot], pa.int64())})

    merged = rows.select("v").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(books.shape[0] * entries * (width + 1), np.int64)
    out[merged["slot"].to_numpy()] = merged["value"].to_numpy()
    out = out.reshape(parts, entries, width + 1)
    return out[:, :, :width], out[:, :, width]


def fit(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray | None:
    """Codebooks (part, entry, place) of rows (vec_id, v); None without rows."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    if width % parts or any(len(r["v"]) != width for r in first):
        raise ValueError(f"{parts} equal parts need vectors of one length that {parts} divides")
    start = floors(np.array([r["v"] for r in first], np.float64).reshape(len(first), width), scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds):
        sums, counts = entry_sums(rows, books, scale)
        used = counts[:, :, None] > 0
        books = np.where(used, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int, label: str) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(books.shape[1])], object)
        for some, cut in parted(batches, books, scale):
            code, error = np.full(some.num_rows, "", object), np.zeros(some.num_rows, np.int64)
            for p in range(books.shape[0]):
                at, far = nearest(cut[p], books[p])
                code, error = code + hexes[at], error + far
            yield pa.record_batch([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, CODED.format(label=label))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, few_labels: int = 100_000) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a whole vector.

    The sums by label go to the rows by a broadcast while there are at most
    `few_labels` of them (a label and a number each), else by a join, whose hot labels AQE splits.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), doubles(F.col(vector_col)).alias("v")).filter("v is not null")
    kind = rows.schema["label"].dataType.simpleString()
    books = fit(rows, parts, entries, rounds, scale)
    if books is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(rows, books, scale, kind), "coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= few_labels else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
