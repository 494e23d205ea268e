"""Hard negatives and vector codes against plain versions, on odd rows and on lists that a bound can skip."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gridlens.llm import codes, negatives, oracles, queries
from tests.llm.test_oracles import rows

SCHEMA = "vec_id long, embedding array<float>, label int, a int, far double, `list` string"
nan, inf = math.nan, math.inf


def table(spark, found):
    return spark.createDataFrame([(i, v, k, 1, 0.5, "x") for i, v, k in found], SCHEMA)


def odd(n=420, width=8, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, width))
    found = [(i, (middles[i % 6] + rng.normal(size=width) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = found[5][1]
    found += [(1000 + i, same, 1) for i in range(150)]  # one vector many times: ties
    found += [(50, same, 2), (50, same, 2), (None, same, 3), (None, None, 1), (9000, [nan] * width, 1), (9001, [inf] * width, 1), (9002, [None] * width, 1), (9003, same, None), (9050, [0.0] * width, 0), (9100, [-x for x in same], 1)]
    return found


def mined(found, **options):
    """Each anchor against every row."""
    e = [(i, (k + 1) % 10 if i is not None and i % 7 == 0 else k, tuple(math.floor(256 * x) for x in v)) for i, v, k in found if v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: math.inf if i is None else i
    out = []
    for i, k, v in sorted({r for r in e if r[0] is not None and r[0] % 50 == 0}):
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), m, j) for j, m, w in e if j != i))
        for s, _, _, j in [r for r in scored if r[2] == k][:5]:
            fit = [(t, h) for t, _, m, h in scored if m != k and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank, h, -s, -t) for rank, (t, h) in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"first": 1, "most_lists": 3}, {"block": 3}, {"sample": 10}])
def test_hard_negatives_equal_brute_force(spark, options):
    found = odd()
    got = negatives.mine(table(spark, found), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == mined(found)


def test_lists_are_skipped_and_nothing_is_lost(spark):
    """Tight lists: the bound leaves most of them out, and the rows are those of all lists."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 16)) * 4
    found = [(i, (middles[i % 20] + rng.normal(size=16) * 0.01).tolist(), i % 3) for i in range(2000)]
    x = np.array([[math.floor(256 * c) for c in np.float32(v)] for _, v, _ in found])
    centres = negatives.k_means(x, 20)
    near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    radii = np.array([np.sqrt(((x[near == c] - centres[c]) ** 2).sum(1)).max(initial=0) for c in range(len(centres))])
    q = x[::50]
    upper = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii
    assert (upper < np.sort(q @ x.T, axis=1)[:, -6][:, None]).mean() > 0.5
    got = negatives.mine(table(spark, found)).collect()
    assert sorted((tuple(r) for r in got), key=str) == mined([(i, np.float32(v).tolist(), k) for i, v, k in found])


def coded(found, entries=256):
    e = sorted([(math.inf if i is None else i, [math.floor(1024 * x) for x in v], k) for i, v, k in found if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0], r[1]))
    width = len(e[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in e[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            at = [near(part(v, p), books[p])[1] for _, v, _ in e]
            for j in set(at):
                mine = [part(v, p) for (_, v, _), a in zip(e, at, strict=True) if a == j]
                books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, k in e:
        found_at = [near(part(v, p), books[p]) for p in range(4)]
        out.append((None if i == math.inf else i, "".join(f"{j:02x}" for _, j in found_at), sum(d for d, _ in found_at), k))
    return sorted(((i, c, d, sum(x[2] for x in out if x[3] == k), digest) for i, c, d, k in out), key=str)


@pytest.mark.parametrize("few_labels", [100, 0])
def test_vector_codes_equal_brute_force(spark, few_labels):
    found = odd(n=300)
    got = codes.compress(table(spark, found), few_labels=few_labels).collect()
    assert sorted((tuple(r) for r in got), key=str) == coded(found)


def test_few_rows_and_none(spark):
    few = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [0.1, -0.2, 0.0, 1.0], 7)]
    assert sorted((tuple(r) for r in codes.compress(table(spark, few)).collect()), key=str) == coded(few)
    for empty in ([], [(1, None, 1), (2, [nan], 1)]):
        assert codes.compress(table(spark, empty)).collect() == [] and negatives.mine(table(spark, empty)).collect() == []
    assert negatives.mine(table(spark, few)).collect() == []


@pytest.mark.parametrize("run", [codes.compress, negatives.mine])
def test_lengths_that_differ_are_an_error(spark, run):
    with pytest.raises(Exception, match="components|lengths|length"):
        run(table(spark, [(50, [1.0, 2.0, 3.0, 4.0], 1), (51, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 1)])).collect()


def test_what_passes_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(table(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])).collect()
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(table(spark, [(50, [3e7, 3e7], 1), (51, [3e7, 1.0], 1), (52, [2e7, 1.0], 2)])).collect()
    big = [(50, [5e6, 5e6], 1), (51, [5e6, 1.0], 1), (52, [4e6, 1.0], 2)]  # beyond 2^53, within 2^63
    assert sorted((tuple(r) for r in negatives.mine(table(spark, big)).collect()), key=str) == mined(big)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", odd(n=200))
    c.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    df, sql = queries.queries()[name](spark, str(tmp_path)), c.sql(oracles.oracle_sql()[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)
