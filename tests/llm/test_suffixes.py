"""Repeated byte strings against a plain version that looks at every window."""

import numpy as np
import pyarrow as pa
import pytest

from gridlens.llm import suffixes
from gridlens.llm.text import mix


def plain(docs, length):
    """(doc, bytes, removed runs, kept) for rows (doc, text)."""
    order = sorted({(d is None, d or 0, hashed, t) for d, t, hashed in docs})
    seen, told = set(), {}
    for key in order:
        data = (key[3] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        told[key] = (len(data), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), data if not len(data) else np.frombuffer(data, np.uint8)[~gone].tobytes())
    return sorted(((d, *told[d is None, d or 0, h, t]) for d, t, h in docs), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], "doc_id long, text string, th string, at int, spans string")
    got = suffixes.dedup(df, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])) for r in got), key=repr)


def hashed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r["doc_id"], r["text"], r["h"]) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()]


def mixed(seed):
    """Texts that share passages of all lengths, with copies, edits, periodic and odd ones."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 7)))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = [say(int(n)) for n in (3, 5, 8, 12, 30, 60)]
    rows = []
    for i in range(60):
        parts = [say(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 4))):
            p = shared[int(rng.integers(0, 6))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            parts += [p[a:b] if rng.random() < 0.5 else p, say(int(rng.integers(0, 9)))]
        rows.append((i * 3 % 61, " ".join(parts)))
    rows += [(200 + i, rows[4][1]) for i in range(8)] + [(300, "a" * 400), (301, "b" + "a" * 300), (302, "ab" * 200), (303, None), (304, ""), (305, "x"), (None, rows[5][1]), (None, None), (7, rows[3][1]), (7, rows[3][1]), (7, say(50)), (306, "\U0001f642" * 60), (307, "z\U0001f642" * 60)]
    return rows


@pytest.mark.parametrize("options", [{"length": 20, "seed": 6}, {"length": 20, "seed": 6, "most": 3}, {"length": 33, "seed": 11, "most": 1, "few_spans": 0}, {}])
def test_repeats_equal_brute_force(spark, options):
    rows = mixed(len(options))
    assert found(spark, rows, **options) == plain(hashed(spark, rows), options.get("length", 100))


def test_one_line_in_many_texts_is_split_and_found(spark):
    """A line just under the length that many texts share is no repeat; with a little more around it, it is."""
    rng = np.random.default_rng(9)
    say = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line = say(95)
    rows = [(i, say(60) + line + say(60)) for i in range(60)] + [(100 + i, say(40) + rows_tail) for i, rows_tail in enumerate([line + "QQQQQ", line + "QQQQR", "PPP" + line + "QQ", "PPP" + line + "QQ"])]
    assert found(spark, rows, most=4) == plain(hashed(spark, rows), 100)


def test_a_range_within_a_shared_passage_is_split_once(spark, monkeypatch):
    """The texts share a passage, and a seed at its edge has a context of its own in each: the windows
    within the passage are one row after the first split and not a row for each text and window."""
    rng = np.random.default_rng(12)
    say = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, made, stored = say(170), [], suffixes.stored
    rows = [(i, say(60) + passage + say(60)) for i in range(80)]

    def counted(df, name):
        table = stored(df, name)
        made.append(table.count() if name == "split" else 0)
        return table

    monkeypatch.setattr(suffixes, "stored", counted)
    assert found(spark, rows, most=4) == plain(hashed(spark, rows), 100)
    assert 0 < sum(made) <= 25 * len(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("slab", [64, 200, 1 << 20])
def test_every_window_is_in_one_context(monkeypatch, slab):
    monkeypatch.setattr(suffixes, "SLAB", slab)
    texts = [(t or "").encode() for _, t in mixed(3)]
    seen = {}
    batch = pa.record_batch({"doc": pa.array(range(len(texts) - 2), pa.int64()), "th": pa.array([0] * (len(texts) - 2), pa.int64()), "t": pa.array(texts, pa.binary()).slice(2)})
    monkeypatch.setattr(suffixes, "UNIT", 30)
    drops = set()
    for data, h, begin, end, seed, row, at, *later in suffixes.contexts(batch, 6, 20, lambda p: p % np.uint64(3) > 0):
        for b, e, r, x in zip(*later, strict=True):
            assert data[b:e].tobytes() == texts[r + 2][x : x + e - b]
            for i in range(e - b - 19):
                seen["at", r, x + i] = seen.get(("at", r, x + i), 0) + 1
                drops.add((r, x + i))
        for x in zip(h, begin, end, seed, row, at, strict=True):
            assert data[x[1] : x[2]].tobytes() == texts[x[4] + 2][x[5] : x[5] + x[2] - x[1]]
            for i in range(x[2] - x[1] - 19):
                window = texts[x[4] + 2][x[5] + i : x[5] + i + 20]
                assert seen.setdefault(window, (x[0], x[3] - x[1] - i)) == (x[0], x[3] - x[1] - i)  # equal windows name equal seeds
                seen.setdefault(("at", x[4], x[5] + i), 0)
                seen["at", x[4], x[5] + i] += 1
    assert drops
    assert {k: v for k, v in seen.items() if k[0] == "at"} == {("at", r, i): 1 for r, t in enumerate(texts[2:]) for i in range(len(t) - 19)}


def test_marks_hold_what_they_were_given():
    h = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    c = h >> np.uint64(64 - suffixes.Marks.MOST_BITS)
    cells = np.unique(c >> np.uint64(6))
    words = np.array([np.bitwise_or.reduce(np.uint64(1) << (c[c >> np.uint64(6) == x] & np.uint64(63))) for x in cells])
    marks = suffixes.Marks(cells, words)
    assert marks.has(h).all() and 15 <= marks.bits <= 17 and marks.has(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.2
    assert int(h[0]) in marks and not suffixes.Marks(cells[:0], words[:0]).has(h).any()


def suffix_case(seed=1):
    rng = np.random.default_rng(seed)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 900)
    at = rng.integers(0, 880, 120)
    return data, at, np.minimum(rng.integers(0, 40, 120), 900 - at), np.sort(rng.integers(0, 9, 120))


def check_sorted(data, at, size, group):
    order, common = suffixes.sorted_suffixes(data, at, size, group)
    whole = [data[a : a + s].tobytes() for a, s in zip(at, size, strict=True)]
    assert [(group[i], whole[i]) for i in order] == sorted((g, w) for g, w in zip(group, whole, strict=True))
    for t in range(1, len(order)):
        a, b = whole[order[t - 1]], whole[order[t]]
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[t] == (want if group[order[t - 1]] == group[order[t]] else 0)


def test_merge_sort_by_hashes():
    check_sorted(*suffix_case())


def test_colliding_hashes_fall_back_to_bytes(monkeypatch):
    """With one hash for all bytes every extension is wrong; the verification sees it."""
    monkeypatch.setattr(suffixes, "_BYTE", np.ones(256, np.uint64))
    check_sorted(*suffix_case(2))


def test_gram_hashes_depend_on_their_bytes_alone():
    data = np.random.default_rng(0).integers(97, 99, 500).astype(np.uint8)
    for k in (1, 2, 5, 31, 32):
        h = suffixes.gram_hashes(data, k)
        assert len(h) == 501 - k and len(set(zip(h.tolist(), (data[i : i + k].tobytes() for i in range(501 - k)), strict=True))) == len(set(h.tolist()))
        assert k > 1 or (h == mix(suffixes._BYTE[data])).all()
