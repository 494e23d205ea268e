"""Toxicity by compression distance.

Two zstandard dictionaries are made of labelled texts: one for ordinary windows,
one for toxic ones. A window of a text is compressed with each; the
fewer bytes it takes with the toxic dictionary than with the ordinary one, the
closer it is to toxic text. The largest differences of a text pass through a
calibrated logistic curve that was fitted on labelled texts kept out of the
dictionaries, so the score is a probability and 0.5 is the threshold.

Both dictionaries are trained by zstandard, each on texts of its own class. They
share a base trained on ordinary windows, so that common words cost the same with
either, and end in a part of equal size: trained on further ordinary windows in
one, and in the other, with a search over the trainer's parameters, on the telling
words of toxic texts (those with a 6-byte gram that toxic texts hold and ordinary
texts of the sample hardly do; trained on all windows of toxic texts, a dictionary
fills with ordinary words and separates nothing). Windows are single words, and
runs of two of which one word shares a piece with the toxic dictionary's own
part: no other run takes fewer bytes with it, and only such differences count. A carrier that either dictionary holds goes before and after each
window, so that even a short window is compressed and not stored, and differences
are taken per byte of window.

What it cannot see: toxic phrases all of whose words are ordinary, and words of 3
bytes or fewer, unless they are telling together with their spaces.

Only `text` is an input of a score. Null and empty texts have no windows and get
the curve's value for no difference; texts of any length are scored whole, window
by window. Repeated ids are scored row by row, equal texts get equal scores. Without
labels of both kinds the score is 0. Null labels are left out, a document
labelled both ways counts as toxic, and of an id on several rows the greatest text
is learned from. An empty table gives no rows; columns named score or window_diff, in any case of letters, are
replaced, all others are carried along as they are.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gridlens.llm.text import let_go

LEVEL = 3
#: a difference is counted in bytes saved per so many bytes of window.
SHARE = 20
STEPS = range(5, 18)
GRAM = 6
#: the shortest match that is looked for in the toxic dictionary's own part, in bytes.
MATCH = 4
#: fixed value: the last bytes of a trained dictionary's head (its three repeat offsets), after which the content begins.
HEAD_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
CARRIER = bytes(range(1, 32))
WORD = re.compile(r"\w+")
_cache: dict = {}


@dataclass(frozen=True)
class Model:
    """Dictionaries and curve; a few tens of kilobytes."""

    key: int
    ordinary: bytes
    toxic: bytes
    width: int
    weights: tuple[float, ...]


def windows(text: str | None, width: int, near=lambda word: True) -> list[str]:
    """The different words of a text and its different runs of `width` words of which one is `near`, in lower case."""
    words = WORD.findall(text.lower()) if isinstance(text, str) else []
    if width == 1:
        return list(dict.fromkeys(words))
    here = [near(w) for w in words]
    starts = sorted({i for p, x in enumerate(here) if x for i in range(max(0, p - width + 1), min(p, len(words) - width) + 1)}) if True in here else ()
    return list(dict.fromkeys([*words, *(" ".join(words[i : i + width]) for i in starts)]))


def chunks(text: str, width: int = 8) -> list[str]:
    """A text cut into runs of `width` words."""
    words = WORD.findall(text.lower())
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS if hasattr(zstandard, "FORMAT_ZSTD1_MAGICLESS") else 1, write_content_size=False, write_checksum=False, write_dict_id=False)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def trained(samples: list[bytes], size: int, **search) -> bytes:
    """Content of a dictionary that zstandard trains on the samples; too few samples are taken as they are."""
    try:
        made = zstandard.train_dictionary(size + 1024, samples, d=6, **(search or {"k": 32})).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return made[made.rfind(HEAD_END) + len(HEAD_END) :][-size:]


class Distance:
    """Byte differences (ordinary minus toxic) of windows, remembered up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)
        self.width, self.most, self.known, self.held = model.width, most, {}, {}
        shared = len(os.path.commonprefix([model.ordinary, model.toxic]))
        self.own = {model.toxic[i : i + MATCH] for i in range(max(0, shared - MATCH + 1), len(model.toxic) - MATCH + 1)}

    def near(self, word: str) -> bool:
        """Whether the toxic dictionary's own part holds a piece of the word that could be a match."""
        found = self.held.get(word)
        if found is None:
            if len(self.held) >= self.most:
                self.held.clear()
            b = f" {word} ".encode("utf-8", "surrogatepass")
            found = self.held[word] = any(b[i : i + MATCH] in self.own for i in range(len(b) - MATCH + 1))
        return found

    def __call__(self, window: str) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            data = CARRIER + b" " + window.encode("utf-8", "surrogatepass") + b" " + CARRIER
            d = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
            found = self.known[window] = SHARE * d // (len(data) - 2 * len(CARRIER))
        return found

    def features(self, text: str | None) -> list[int]:
        """The three largest differences, at least 0, largest first."""
        known, best = self.known, [0, 0, 0]
        for w in windows(text, self.width, self.near):
            d = known.get(w)
            if d is None:
                d = self(w)
            if d > best[2]:
                best = sorted((*best, d), reverse=True)[:3]
        return best


def _grams(words) -> set[bytes]:
    return {b[i : i + GRAM] for w in words for b in [f" {w} ".encode("utf-8", "surrogatepass")] for i in range(len(b) - GRAM + 1)}


def telling(toxic: list[str], ordinary: list[str], ratio: float = 20.0) -> list[bytes]:
    """The words of toxic texts with a gram that these favour, once for each text that holds them."""
    least = max(3, -(-3 * len(toxic) // 100))
    sets = [list(dict.fromkeys(WORD.findall(t.lower()))) for t in toxic]
    there = Counter(g for ws in sets for g in _grams(ws))
    here = Counter(g for t in ordinary for g in _grams(WORD.findall(t.lower())) if there[g] >= least)
    favoured = {g for g, n in there.items() if n >= least and n * len(ordinary) >= ratio * max(1, here[g]) * len(toxic)}
    return [f" {w} ".encode("utf-8", "surrogatepass") for words in sets for w in words if not favoured.isdisjoint(_grams([w]))]


def _design(features: np.ndarray) -> np.ndarray:
    """One step for each value of the largest difference, and the next two as they are."""
    return np.c_[np.ones(len(features)), *[features[:, 0] >= k for k in STEPS], np.minimum(features[:, 1:], STEPS[-1]) / 6.0].astype(float)


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic regression by Newton's method; weights other than the intercept stay at or above 0."""
    x = _design(features)
    n = x.shape[1]
    w, free = np.zeros(n), np.ones(n, bool)
    for _ in range(4):
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = np.r_[0.0, np.full(n - 1, ridge)]
            grad = (x.T @ (p - labels) + pull * w)[free]
            hess = ((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6))[np.ix_(free, free)]
            step = np.linalg.solve(hess, grad)
            w[free] -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        low = (w < 0) & (np.arange(n) > 0)
        if not low.any():
            break
        free &= ~low
        w[low] = 0
    return tuple(float(v) for v in w)


def train(rows: list[tuple[int, str]], *, width: int = 2, base_size: int = 8192, tail_size: int = 2048) -> Model | None:
    """A model of (label, text) rows. Three of four rows make the dictionaries, the fourth the curve."""
    rows = [(y, t or "") for y, t in rows]
    toxic, ordinary = ([t for y, t in rows if y == v] for v in (1, 0))
    if not toxic or not ordinary:
        return None
    part = lambda ts: ([t for i, t in enumerate(ts) if i % 4], ts[::4]) if len(ts) > 3 else (ts, ts)
    (tox, tox_out), (plain, plain_out) = part(toxic), part(ordinary)
    spread = lambda ts: [f" {w} ".encode("utf-8", "surrogatepass") for t in ts for w in chunks(t)]
    half = len(plain) // 2
    base = trained(spread(plain[:half]), base_size)
    tail = trained(telling(tox, plain), tail_size, steps=40)
    fill = trained(spread(plain[half:]), max(len(tail), 512))[-len(tail) :] if tail else b""
    blank = Model(hash((base, fill, tail)), base + fill, base + tail, width, ())
    far = Distance(blank)
    x = np.array([far.features(t) for t in tox_out + plain_out])
    y = np.r_[np.ones(len(tox_out)), np.zeros(len(plain_out))]
    return Model(blank.key, blank.ordinary, blank.toxic, width, fit_curve(x, y))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 4000) -> list[tuple[int, str]]:
    """At most `per_label` labelled texts of each label, by hash of the id, none of the held-out fold.

    This is the bound of the fit: 2 x per_label whole texts reach the driver, one for
    each id, however large the tables are.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    picked = known.filter(F.col("y") == 1).orderBy(F.xxhash64("id"), "id").limit(per_label).unionByName(known.filter(F.col("y") == 0).orderBy(F.xxhash64("id"), "id").limit(per_label))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("t").alias("t")).collect()
    return [(r["y"], r["t"]) for r in sorted(found, key=lambda r: r["id"])]


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` that are not named so, with score (double) and window_diff (int) added."""
    added = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "window_diff")]
    if model is None:
        return docs.select(*added, F.lit(0.0).alias("score"), F.lit(0).alias("window_diff"))
    kept = docs.select(*added)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("window_diff", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        far = _cache.get(model.key)
        if far is None:
            _cache.clear()
            far = _cache[model.key] = Distance(model)
        for batch in batches:
            x = np.array([far.features(t.as_py()) for t in batch.column(text_col)]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(x[:, 0].astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema)
