"""N-gram Jaccard join with signature trees.

Two documents link when their sets of word shingles overlap by at least the
threshold (4/5). Documents of equal sets form a class, and only one
representative of each class goes on. The join then runs in three steps:

1. Routing. By the prefix principle two linked sets share a shingle among the
   first n - ceil(4n/5) + 1 of either, in any fixed order of shingles. The order
   used puts shingles that are frequent in some part of the corpus last, so that
   shared passages rarely route; only the others are counted in one shuffle. Buckets are the shingles with two sets or more.
2. Neighbours. Sets that lie next to each other in a bucket (ordered by a
   min-hash and size) are compared, and what links is joined into components.
   Groups of copies collapse here with work in proportion to their size.
3. Signature trees. Sets of different components in a bucket are compared by
   trees: a leaf holds a set's bitmap and size, a node the OR and the AND of the
   bitmaps below and the range of sizes. Bits that all sets of one node have and
   no set of the other are members without partner, which bounds the overlap of
   every pair below; nodes are entered together only if that could suffice, and
   leaf pairs that stay are compared exactly. A bucket of up to LEAVES sets is one
   node whose leaves are compared at once. A bucket with more sets than a block is
   cut into blocks, and pairs of blocks are groups of their own, so no bucket is
   capped and none meets in a task.
   Blocks are cut by size: sets whose sizes cannot link share no block pair.
   The trees are walked twice: first each set is compared with its closest
   partner only and what links is joined, so that groups of copies become one
   component; then every pair that still lies in different components is.

No step is approximate: every pair of linked sets in different components
reaches an exact comparison of the whole sets.

Nulls and edge cases: null and empty texts have no shingles and link with
nothing; fewer words than n are one shingle; a row without id takes no part and
gets no component (null). Rows that repeat an id are a set each; all sets of an id
are linked with each other, so every row of an id gets the same component. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm import components, text
from gridlens.session import among, forget, stored

N = 5
NUM, DEN = 4, 5
LEAVES = 16
#: node pairs that are looked at together: 8 MB of bitmaps a side.
PAIRS = 16_384
#: sizes that can link lie in one or in two neighbouring bands: the base is a little over DEN / NUM.
BAND = 1.26
FACTS = ["node", "comp", "n", "minhash", "bits"]
KEY = ["n_shingles", "key_a", "key_b"]
SETS = "doc_id long, n_shingles long, key_a long, key_b long, shingles binary"
COLUMNS = ["key_a", "key_b", "minhash", "prefix", "hot_prefix", "bits"]
SHAPE = "doc_id long, n_shingles long, key_a long, key_b long, minhash long, prefix array<long>, hot_prefix array<long>, bits binary"


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection with which sets of these sizes link: DEN i >= NUM (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def sizes_fit(a: int, b: int) -> bool:
    return DEN * min(a, b) >= NUM * max(a, b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact comparison of two sorted sets."""
    if not len(a) or not len(b) or not sizes_fit(len(a), len(b)):
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(len(a), len(b))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of 64 to 4096 bits, four bits for each member rounded up to a power of two."""
    bits = 1 << min(12, max(6, int(4 * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(shingles >> np.uint64(40)) % np.uint64(bits)] = True
    return np.packbits(out)


def frequent(docs: DataFrame, id_col: str, text_col: str, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Shingles that several documents of one partition hold: the ones to put last in the order.

    Any order gives right results, so this list only steers; its size is bounded
    by `most` (1.6 MB), the most frequent first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held, size = [], [], 0

        def folded(parts):
            values, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(counts, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)).astype(np.int64)
            return values, total

        for batch in batches:
            h, at = text.batch_words(batch["text"])
            held += [text.shingle_set(h[i:j], N) for i, j in zip(at, at[1:], strict=False)]
            size += len(h)
            if size > 1_000_000:
                seen.append(_tops(held, 2))
                held, size = [], 0
        if held:
            seen.append(_tops(held, 2))
        if seen:
            values, total = folded(seen)
            keep = total >= least
            yield pd.DataFrame({"h": values[keep].view(np.int64), "n": total[keep]})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(text.in_slices(count, "h long, n long"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "h").limit(most).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _tops(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    keep = counts >= least
    return values[keep], counts[keep]


def shapes(docs: DataFrame, last: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """What the join needs of each document: size, two keys of the whole set, a min-hash, the prefix, the bitmap."""

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, at = text.batch_words(batch["text"])
            rows, ids = [], text.exact(batch["id"])
            for i, j in zip(at, at[1:], strict=False):
                s = text.shingle_set(h[i:j], N)
                if not len(s):
                    rows.append((0, 0, 0, 0, [], [], b""))
                    continue
                rows.append((len(s), *_keys(s), *_prefix(s, last), bitmap(s).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", *COLUMNS]).assign(doc_id=text.longs(ids))[["doc_id", "n_shingles", *COLUMNS]]

    return docs.select(text.as_key(F.col(id_col)).alias("id"), F.col(text_col).alias("text")).mapInArrow(text.in_slices(shape, SHAPE), SHAPE)


def _keys(s: np.ndarray) -> tuple[int, int, int]:
    """Two keys of a whole set and its min-hash."""
    m = text.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(s.sum().astype(np.int64)), int(m.sum().astype(np.int64)), int(m.min().astype(np.int64))


def _prefix(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a set is routed by, the first of the order (not frequent, hash): plain and frequent ones."""
    n = len(s)
    take = n - -(-NUM * n // DEN) + 1
    hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, bool)
    plain = s[~hot][:take]
    return plain.view(np.int64), s[hot][: take - len(plain)].view(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc_id and key columns), made anew from their texts."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, at = text.batch_words(batch["text"])
            sets = [text.shingle_set(h[i:j], N) for i, j in zip(at, at[1:], strict=False)]
            keys = [_keys(s) if len(s) else (0, 0, 0) for s in sets]
            yield pd.DataFrame({"doc_id": batch["id"], "n_shingles": list(map(len, sets)), "key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys], "shingles": [s.tobytes() for s in sets]})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    made = among(source, wanted.select(F.col("doc_id").alias("id")).distinct(), "id").mapInArrow(text.in_slices(make, SETS), SETS)
    return among(made, wanted, ["doc_id", *KEY], "inner").select("node", "shingles").dropDuplicates(["node"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def paired(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the facts of either end as <column>_a and <column>_b."""
    for end in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def verified(pairs: DataFrame, facts: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets link. Pairs that the bitmaps rule out need no sets."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [bound(x, y, n, m) >= 0 for x, y, n, m in zip(batch["bits_a"], batch["bits_b"], batch["n_a"], batch["n_b"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["shingles_a"], batch["shingles_b"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    asked = stored(ends(pairs), f"{name}-ends")
    likely = stored(
        paired(pairs, among(facts, asked, "node"), ["n", "bits"]).filter(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")).mapInPandas(sift, "a long, b long"), f"{name}-likely"
    )
    nodes = stored(among(classes, stored(ends(likely), f"{name}-nodes"), "node").select("node", F.col("least").alias("doc_id"), *KEY), f"{name}-wanted")
    sets = stored(sets_of(docs, nodes, id_col, text_col), f"{name}-sets")
    links = stored(paired(likely, sets, ["shingles"]).mapInPandas(check, "a long, b long"), f"{name}-links")
    forget(asked, likely, nodes, sets)
    return links


class Tree:
    """A signature tree over sets of one width of bitmap: level 0 are the leaves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        self.order, self.place = order, np.argsort(order)
        bits, sizes = bits[order], sizes[order]
        self.bits, self.common, self.low, self.high = [bits], [bits], [sizes], [sizes]
        while len(self.bits[-1]) > 1:
            cuts = np.arange(0, len(self.bits[-1]), LEAVES)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cuts, axis=0))
            self.common.append(np.bitwise_and.reduceat(self.common[-1], cuts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))


def may_link(x: Tree, i: np.ndarray, lx: int, y: Tree, j: np.ndarray, ly: int) -> np.ndarray:
    """Of node pairs, those below which some pair can link.

    Bits that every set below one node has and no set below the other are members
    without partner: a pair's overlap is at most its size minus those. It has to
    reach NUM (a + b) / (NUM + DEN), and sizes must be in reach of each other.
    """
    fit = (DEN * x.high[lx][i] >= NUM * y.low[ly][j]) & (DEN * y.high[ly][j] >= NUM * x.low[lx][i])
    lone = np.bitwise_count(x.common[lx][i] & ~y.bits[ly][j]).sum(1)
    fit &= (NUM + DEN) * (x.high[lx][i] - lone) >= NUM * (x.high[lx][i] + y.low[ly][j])
    lone = np.bitwise_count(y.common[ly][j] & ~x.bits[lx][i]).sum(1)
    return fit & ((NUM + DEN) * (y.high[ly][j] - lone) >= NUM * (y.high[ly][j] + x.low[lx][i]))


def dual_traversal(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (positions in the trees' inputs) that the bounds do not exclude."""
    lx, ly = len(x.bits) - 1, len(y.bits) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    found_i, found_j = [], []
    todo = [(i, j, lx, ly)]
    while todo:
        i, j, lx, ly = todo.pop()
        keep = may_link(x, i, lx, y, j, ly)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if lx == ly == 0:
            found_i.append(x.order[i])
            found_j.append(y.order[j])
            continue
        if lx >= ly:
            i, j = _below(i, j, len(x.bits[lx - 1]))
            lx -= 1
        else:
            j, i = _below(j, i, len(y.bits[ly - 1]))
            ly -= 1
        todo += [(i[k : k + PAIRS], j[k : k + PAIRS], lx, ly) for k in range(0, len(i), PAIRS)]
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _below(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes i, each with its partner j."""
    kids = (i[:, None] * LEAVES + np.arange(LEAVES)).ravel()
    partners = np.repeat(j, LEAVES)
    return kids[kids < n], partners[kids < n]


def tree_pairs(left: pd.DataFrame, right: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
    """Pairs (a < b, room) of nodes in different components that may link, from two blocks or within one."""
    same = right is None
    right = left if same else right
    for wa, a in left.groupby(left["bits"].str.len(), sort=False):
        for wb, b in right.groupby(right["bits"].str.len(), sort=False):
            if max(wa, wb) > 2 * min(wa, wb) or same and wa > wb:
                continue
            x, y = (_tree(t, min(wa, wb)) for t in (a, b))
            i, j = dual_traversal(x, y)
            na, nb = a["node"].to_numpy()[i], b["node"].to_numpy()[j]
            keep = a["comp"].to_numpy()[i] != b["comp"].to_numpy()[j]
            if same and wa == wb:
                keep &= na < nb
            i, j, na, nb = i[keep], j[keep], na[keep], nb[keep]
            room = [np.empty(0)]
            for k in range(0, len(i), PAIRS):
                p, q = x.place[i[k : k + PAIRS]], y.place[j[k : k + PAIRS]]
                room.append(_room(x.bits[0][p], y.bits[0][q], x.low[0][p], y.low[0][q]))
            yield pd.DataFrame({"a": np.minimum(na, nb), "b": np.maximum(na, nb), "room": np.concatenate(room)})


def _room(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How far the greatest possible overlap of each pair lies above the least with which it links, by size."""
    most = np.minimum(nx - np.bitwise_count(x & ~y).sum(1), ny - np.bitwise_count(y & ~x).sum(1))
    return most / (nx + ny) - NUM / (NUM + DEN)


def _tree(block: pd.DataFrame, width: int) -> Tree:
    bits = np.stack([_folded(np.frombuffer(x, np.uint8), width) for x in block["bits"]])
    n = block["n"].to_numpy(np.int64)
    return Tree(bits, n, np.lexsort((n, block["minhash"].to_numpy(), np.floor(np.log(n) / np.log(BAND)))))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width: positions are taken modulo it."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def bound(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """The leaf bound for one pair: its greatest overlap less the least with which it links."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    a, b = _folded(a, width), _folded(b, width)
    most = min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))
    return most - least_overlap(nx, ny)


def _small(rows: pd.DataFrame, group: np.ndarray, most: int) -> pd.DataFrame:
    """Pairs of many buckets of one node each (up to LEAVES sets), all at once."""
    node, comp, n, bits = rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy(), rows["bits"].to_numpy()
    tried = {}
    for d in range(1, most):
        i = np.flatnonzero(group[:-d] == group[d:])
        i = i[(comp[i] != comp[i + d]) & (DEN * np.minimum(n[i], n[i + d]) >= NUM * np.maximum(n[i], n[i + d]))]
        for x, y in zip(i.tolist(), (i + d).tolist(), strict=True):
            pair = (min(node[x], node[y]), max(node[x], node[y]))
            if pair not in tried:
                tried[pair] = bound(bits[x], bits[y], int(n[x]), int(n[y])) / int(n[x] + n[y])
    return pd.DataFrame([(a, b, room) for (a, b), room in tried.items() if room >= 0], columns=["a", "b", "room"]).astype({"a": "int64", "b": "int64", "room": float})


def _blocks(rows: pd.DataFrame, closest: bool) -> pd.DataFrame:
    """Pairs of all buckets and pairs of blocks in `rows`, which lie together by key; of each node the closest or all."""
    key = rows[["token", "i", "j"]].to_numpy()
    group = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))]
    small = np.bincount(group)[group] <= LEAVES
    found = [_small(rows[small], group[small], LEAVES)]
    for _, part in rows[~small].groupby(group[~small], sort=False):
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        left, right = (part, None) if i == j else (part[part["s"] == i], part[part["s"] == j])
        if len(left) and (right is None or len(right)):
            found += [_closest(f) if closest else f for f in tree_pairs(left, right)]
    pairs = pd.concat(found, ignore_index=True)
    return (_closest(pairs) if closest else pairs)[["a", "b"]].drop_duplicates().sort_values(["a", "b"])


def _closest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of each node the one with most room."""
    pairs = pairs.sort_values(["room", "a", "b"], ascending=[False, True, True])
    return pairs[~pairs.duplicated("a") | ~pairs.duplicated("b")]


def dealt(buckets: DataFrame, block: int) -> DataFrame:
    """Every set with the pairs of blocks (i, j) in which it is compared, and its own block s.

    A bucket of up to `block` sets is one block. A larger one is cut by size band and,
    within a band, by hash into blocks of about that size; a set meets the
    blocks of its own band and of the two next to it, the only ones in its reach.
    """
    one = buckets.filter(F.col("m") <= block).select("token", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("s"), *FACTS)
    large = buckets.filter(F.col("m") > block).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))))
    bands = large.groupBy("token", "band").agg(F.ceil(F.count("*") / block).alias("g"))
    maps = bands.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "g"))).alias("gs"))
    own = large.join(maps, "token").withColumn("s", F.col("band") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("gs")[F.col("band")]))
    blocks_of = lambda b: F.when(F.col("gs")[b].isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("gs")[b] - 1), lambda t: b * 1_000_000 + t)).otherwise(F.array().cast("array<bigint>"))
    met = own.withColumn("o", F.explode(F.concat(*[blocks_of(F.col("band") + d) for d in (-1, 0, 1)])))
    return one.unionByName(met.select("token", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", *FACTS))


def across(buckets: DataFrame, block: int, closest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that a bucket's signature trees leave over.

    A task reads the pairs of blocks it was dealt in order and holds one.
    """

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[["token", "i", "j"]].iloc[-1]
            open_ = ((rows["token"] == last["token"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])).to_numpy()
            held = rows[open_]
            if not open_.all():
                yield _blocks(rows[~open_].reset_index(drop=True), closest)
        if held is not None:
            yield _blocks(held.reset_index(drop=True), closest)

    return dealt(buckets, block).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node").mapInPandas(sweep, "a long, b long").distinct()


def differing(buckets: DataFrame) -> DataFrame:
    """Buckets in which different components meet; of buckets with the same members one."""
    marks = buckets.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("k")).filter("lo < hi")
    return marks.groupBy("x", "y", "k").agg(F.min("token").alias("token")).select("token")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its own id without links).

    A node is one row of each class of equal sets, so that rows which repeat an id
    stay apart; an id whose rows lie in several classes links them.
    """
    last = frequent(docs, id_col, text_col)
    shape = stored(shapes(docs, last, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "shapes")
    sizes = stored(shape.select("doc_id", *KEY), "sizes")
    some = shape.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy(*KEY).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("k")).select(*KEY, F.col("rep.doc_id").alias("least"), F.col("rep.row").alias("node"), "k"), "classes")
    copies = stored(some.select("row", *KEY).join(classes.filter("k > 1").select("node", *KEY), KEY).filter("row <> node").select("row"), "copies")
    single = among(some, copies, "row", "left_anti").withColumnRenamed("row", "node")
    facts = stored(single.select("node", F.col("n_shingles").alias("n"), "minhash", "bits"), "facts")
    plain = single.select(F.explode("prefix").alias("token"), "node")
    shared = plain.withColumn("k", F.count("*").over(Window.partitionBy("token"))).filter("k > 1").drop("k")
    routed = stored(shared.unionByName(single.select(F.explode("hot_prefix").alias("token"), "node")), "routed")
    forget(shape, copies)
    crowds = routed.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = stored(routed.join(crowds, "token").join(facts.drop("bits"), "node"), "buckets")
    forget(routed)
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / 1000))
    order = Window.partitionBy("token", spread).orderBy("minhash", "n", "node")
    near = buckets.select("node", F.lag("node").over(order).alias("other"), "n", F.lag("n").over(order).alias("n2")).filter(
        F.col("other").isNotNull() & (DEN * F.least("n", "n2") >= NUM * F.greatest("n", "n2"))
    )
    pairs = stored(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).filter("a < b").distinct(), "near")
    edges = stored(verified(pairs, facts, classes, docs, id_col, text_col, "near").unionByName(same_id(sizes, classes)), "edges")
    comp = components.connected(edges)
    forget(edges)
    for closest in (True, False):
        placed = among(buckets, comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        todo = stored(placed.join(differing(placed), "token"), "todo")
        bits = among(facts.select("node", "bits"), stored(todo.select("node").distinct(), "todo-nodes"), "node")
        more = stored(across(todo.join(bits, "node"), block, closest).join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = verified(more, facts, classes, docs, id_col, text_col, "far")
        comp = components.joined(comp, links)
        pairs = pairs.union(more)
        forget(todo, links)
    forget(buckets, facts)
    component = comp.join(classes, "node").groupBy("comp").agg(F.min("least").alias("component"))
    rooted = stored(classes.join(comp.join(component, "comp"), "node", "left").select(*KEY, F.coalesce("component", "least").alias("component")), "rooted")
    forget(comp, classes)
    id_ = F.col("doc_id")
    return sizes.join(rooted, KEY, "left").select("doc_id", "n_shingles", F.when(id_.isNull() | (F.col("n_shingles") == 0), id_).otherwise(F.col("component")).alias("component_id"))


def same_id(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat an id."""
    some = sizes.filter("n_shingles > 0 and doc_id is not null")
    again = stored(some.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    nodes = among(some, again, "doc_id").join(classes, KEY).select("doc_id", "node").distinct()
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return nodes.join(first, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
