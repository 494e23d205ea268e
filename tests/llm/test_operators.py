"""The dealt operators against brute force, exact round trips and held-out accuracy, with the edge cases."""

import hashlib
import html as html_lib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import chat, components, decontam, html, jaccard, licenses, packing, quality, queries, substrings, text, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d", "tie tie tie tie tie tie", "x" * 3000, "Straße ÉTÉ K \U0001f642 \x00 </s> <|end|>"]


def docs(spark, texts, first=0):
    """A table with extra columns whose names clash with those of results, each text with its own id."""
    return spark.createDataFrame([(first + i, t, "en", "s", None, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def babble(rng, n):
    return [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))) for _ in range(n)]


def test_words_and_shingles(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(text, "SLAB", 16)
    texts = ["".join(rng.choice("abC é\n\t.") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    h, at = text.batch_words(texts)
    seen = {}
    for i, t in enumerate(texts):
        words = WORD.findall(lower(t))
        assert at[i + 1] - at[i] == len(words)
        for w, x in zip(words, h[at[i] : at[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_quality_counts_and_verdict(spark):
    rng = random.Random(2)
    good = [" ".join(babble(rng, 40)) for _ in range(700)]
    bad = [" ".join(w + "###" for w in babble(rng, 40)) for _ in range(60)]
    repeated = "la la " + " ".join(["p q r s t u v w"] * 4) + "\nline\nline\n \nline"
    table = docs(spark, [*good, *bad, repeated, *ODD])
    labels = spark.createDataFrame([(i, 1) for i in range(650)] + [(i, 0) for i in range(700, 750)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.apply_rules(table, labels).collect()}
    for i, t in enumerate([*good, *bad, repeated, *ODD]):
        w = WORD.findall(t or "")
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert all(found[i]["kept"] for i in range(700)) and not any(found[i]["kept"] for i in range(700, 760))
    assert quality.apply_rules(table.limit(0), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.apply_rules(table, labels.limit(0)).collect())


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for k, n, p in itertools.product((0, 1, 4, 9), (50, 700, 3000), (0.01, 0.05))]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("t")).first()["t"]
        want = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(got - want) < 1e-9 * max(1, want) + 1e-12


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|", "end|>", "\\", "</s>", "[INST]", "|", "<", "a", "\n", "é", "[/INST]", "<<SYS>>", "|>"]
    for _ in range(500):
        some = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        turns = [{"role": some() or "user", "parts": [{"type": "text", "text": some(), "ref": None, "units": None}]} for _ in range(rng.randint(1, 4))]
        assert chat.read_back(chat.render(turns)[0]) == [(t["role"], t["parts"][0]["text"]) for t in turns]
        assert not any(c in chat.escape(t["parts"][0]["text"]) for t in turns for c in chat.CONTROLS)
    rows = spark.createDataFrame([(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (2, None, None, "</s>", "x")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(rows.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nuser\nhi\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\n</s>\n").hexdigest()
    assert chat.format_conversations(rows.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts_become_placeholders():
    part = lambda kind, t=None, ref=None, units=None: {"type": kind, "text": t, "ref": ref, "units": units}
    out, spans, v = chat.render([{"role": "user", "parts": [part("text", "see "), part("image", ref="a.png", units=2), part("image", ref="b.png"), part("audio", ref="c.wav", units=3)]}, {"role": "assistant", "parts": [part("text", "ok")]}])
    assert "see <|image:1|><|image:2|><|audio:1|>" in out
    assert [(a["ref"], a["tokens"]) for a in v.attachments] == [("a.png", 512), ("b.png", 256), ("c.wav", 75)] and v.tokens == 843
    assert out[spans[0]["begin"] : spans[0]["stop"]] == "ok"


def test_fill_window_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        cap, counts = rng.randint(5, 60), None
        counts = np.zeros(cap, int)
        for _ in range(rng.randint(1, 6)):
            counts[rng.randint(1, cap - 1)] += rng.randint(1, 3)
        taken = packing.fill_window(counts, cap)
        sums = {0}
        for n in range(1, cap):
            for _ in range(counts[n]):
                sums |= {s + n for s in sums if s + n <= cap}
        assert all(counts[n] >= k for n, k in taken.items()) and sum(n * k for n, k in taken.items()) == max(sums)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    path = queries.tokenizer_path()
    tool = Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|> special", "it's Ñ İΣ ½²", *[" ".join(babble(rng, rng.choice([3, 50, 4000]))) for _ in range(30)], *["same words here " * 400] * 12]
    want = [np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    got, sequences = {}, {}
    for r in packing.pack(docs(spark, texts).repartition(3), path).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in enumerate(want):
        at = 0
        for s, n in sorted(got[i]):
            assert s == at
            at += n
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(docs(spark, texts).limit(0), path).count() == 0


def test_license_places_and_labels(spark):
    texts = [*ODD, "Licensed under CC BY-NC 4.0.", "cc by cc by\nAll rights reserved", "Released under the MIT License. " * 3, "This work is licensed under the GNU General Public License, version 3.", "all Rights. reserved-all rights reserved", "general public", "license version 2"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for label, p in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(ODD)
    assert [got[n + k]["labels"] for k in range(4)] == ["cc-by,cc-by-nc-4.0", "cc-by,reserved", "mit", "gpl,gpl-3.0"]
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    return sets, comp


@pytest.mark.parametrize("block", [3, 2048])
def test_jaccard_components(spark, block):
    rng = random.Random(6)
    texts = [*ODD, "one", "a b c d", "a b c d e"]
    shared = babble(rng, 60)
    for _ in range(8):
        base = babble(rng, rng.choice([12, 60, 200]))
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
            texts.append(" ".join(w).upper())
    texts += [" ".join(shared + babble(rng, k)) for k in (2, 3, 4, 8, 10, 12, 14, 16, 18, 30)]
    sets, comp = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, texts).repartition(3), block=block).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}


def test_jaccard_repeated_and_null_ids(spark):
    rng = random.Random(21)
    big = 2**53 + 1
    a, b, c = (babble(rng, 60) for _ in range(3))
    near = [*a[:30], "changed", *a[31:]]
    rows = [(0, b), (1, a), (1, b), (5, near), (big, c), (None, c), (None, a), (7, c[:40]), (7, c[:40]), (9, ["x"] * 3), (9, [])]
    want = {0: 0, 1: 0, 5: 0, big: big, 7: 7, 9: 9, None: None}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = jaccard.join(table).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [56, 56]


def test_jaccard_large_buckets_of_every_size(spark):
    rng = random.Random(22)
    shared = babble(rng, 80)
    texts = [" ".join(shared + babble(rng, k)) for k in range(2, 200) if k % 3]
    _, comp = brute_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts), block=4).collect()} == dict(enumerate(comp))


def test_jaccard_empty(spark):
    assert jaccard.join(docs(spark, []).limit(0)).count() == 0
    assert [r["component_id"] for r in jaccard.join(docs(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in rng.integers(20, 40, 60)]
    sets += [np.unique(np.r_[s[: len(s) - 2], rng.integers(0, 2**63, 2, np.uint64)]) for s in sets]
    import pandas as pd

    block = pd.DataFrame({"node": range(len(sets)), "comp": range(len(sets)), "n": [len(s) for s in sets], "minhash": [int(s[0] >> np.uint64(1)) for s in sets], "bits": [jaccard.bitmap(s).tobytes() for s in sets]})
    found = {(a, b) for pairs in jaccard.tree_pairs(block, None) for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)}
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if jaccard.linked(sets[a], sets[b])}
    assert linked and linked <= found and len(found) < 300


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(1, 2), (2, 1), (5, 5), (900, 3)]
    got = {r["node"]: r["comp"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 201), 100), 1: 1, 2: 1, 900: 3, 3: 3}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rude = ["grumblefex", "snarlwort", "blight", "oaf"]
    rows = []
    for i in range(900):
        w, bad = babble(rng, 60), i % 4 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(rude)
        rows.append((i, " ".join(w), int(bad)))
    table = docs(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.sample(table, labels))
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    scored = [r["score"] for r in toxicity.score(docs(spark, [t for t, _ in held] + ODD), model).orderBy("doc_id").collect()]
    right = sum((s >= 0.5) == (y == 1) for s, (_, y) in zip(scored, held, strict=False))
    assert toxicity.windows("A b, c", 2) == ["a", "b", "c", "a b", "b c"] and toxicity.windows(None, 2) == []
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s in scored) and len(scored) == len(held) + len(ODD)
    assert all(s < 0.5 for s in scored[len(held) :])
    assert toxicity.train(toxicity.sample(table, labels.filter("toxic = 0"))) is None
    assert [r["score"] for r in toxicity.score(docs(spark, ["x"]), None).collect()] == [0.0]


def test_warc_derivatives(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title></head><body><p>One&nbsp;two</p><script>no()</script><a href='/x?a=1&amp;b'>go</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (1, "http://a/", page)], "page_id long, url string, html string")
    rows = warc.derive(warc.as_responses(pages), "page_id").collect()
    assert len(rows) == 8
    meta, conv = sorted((r for r in rows if r["key"] == 1), key=lambda r: r["record_type"], reverse=True)[:1], [r for r in rows if r["key"] == 1 and r["record_type"] == "conversion"]
    assert bytes(conv[0]["content"]).decode().split() == ["One", "two", "go"] and conv[0]["record_id"] == conv[1]["record_id"]
    assert meta[0]["concurrent_to"] == conv[0]["record_id"] and meta[0]["refers_to"] == conv[0]["refers_to"]
    assert b'"title": "A & B"' in bytes(meta[0]["content"]) and b"/x?a=1&b" in bytes(meta[0]["content"])
    assert conv[0]["payload_digest"] == warc.digest(page.encode()) and conv[0]["block_digest"] == warc.digest(bytes(conv[0]["content"]))
    back = list(warc.records_of(b"".join(r["member"] for r in warc.members(warc.derive(warc.as_responses(pages), "page_id")).collect())))
    assert len(back) == 8 and all(warc.digest(block) == f["WARC-Block-Digest"] for f, block in back)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:KEEP\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    got = warc.derive(warc.read_warc(spark, str(tmp_path / "a.warc"))).collect()
    assert {r["refers_to"] for r in got} == {"<urn:x>"} and {r["payload_digest"] for r in got} == {"sha1:KEEP"} and b"hello" in [bytes(r["content"]) for r in got]
    assert warc.derive(warc.as_responses(pages.limit(0)), "page_id").count() == 0


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [" ".join(babble(rng, rng.choice([6, 15, 40]))) for _ in range(12)] + ["few words", None, ""]
    texts, planted = list(ODD), []
    for k in range(150):
        which = k % 12
        w = items[which].split()
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["zz"], [w[p], "zz"]])
        texts.append(" ".join(babble(rng, 30) + (w if k % 3 else [x.upper() + "," for x in w]) + babble(rng, 30)))
        planted.append((len(texts) - 1, which))
    texts += [" ".join(babble(rng, 300)) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.contaminated(docs(spark, texts), bench, block=7).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
    assert set(found) <= set(planted) and len(found) >= 0.97 * len(planted)
    for r in rows:
        w = decontam.plain(texts[r["doc_id"]]).split()[r["start"] :]
        assert r["edits"] == word_distance(items[r["item_id"]].split(), w[: r["words"]])
    assert decontam.contaminated(docs(spark, texts).limit(0), bench).count() == 0 and decontam.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_recall_at_the_full_distance(spark):
    rng = random.Random(31)
    for n in (5, 20, 80, 400):
        items = [babble(rng, n) for _ in range(12)]
        texts, planted = [], set()
        for k in range(48):
            w = list(items[k % 12])
            for _ in range(int(0.2 * n)):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[], ["zz" + str(rng.randrange(10**9))], [w[p], "zz" + str(rng.randrange(10**9))]])
            texts.append(" ".join(babble(rng, 20) + w + babble(rng, 20)))
            planted.add((k, k % 12))
        index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)], decontam.RATE, 5, decontam.Walks())
        found = {(k, item) for k, item, *_ in index.search(*text.batch_words([decontam.plain(t) for t in texts]))}
        assert len(planted & found) >= 0.97 * len(planted), n


def test_large_ids_stay_exact_beside_nulls(spark):
    big = 2**53 + 1
    words = "one two three four five six seven eight nine ten " * 3
    rows = [(big, None, words, 0, "user", big), (None, "u", words, 1, "assistant", None)]
    table = spark.createDataFrame(rows, "doc_id long, url string, text string, turn long, role string, n_chars long").coalesce(1)
    ids = lambda df, c: {r[c] for r in df.collect()}
    both = {big, None}
    assert ids(packing.pack(table, queries.tokenizer_path()), "doc_id") == both
    assert ids(html.extract(table, id_col="doc_id", html_col="text"), "page_id") == both
    assert ids(warc.derive(warc.as_responses(table, html_col="text"), "doc_id"), "key") == both
    formatted = chat.format_conversations(table.withColumn("parts", chat.text_parts(F.col("text"))), "doc_id")
    assert ids(formatted, "conv_id") == both and ids(chat.digests(formatted), "conv_id") == both
    bench = spark.createDataFrame([(big, words), (None, words)], "item_id long, text string").coalesce(1)
    found = decontam.contaminated(table, bench)
    assert ids(found, "doc_id") == both and ids(found, "item_id") == both
    model = toxicity.train([(1, "bad " + words), (0, words)] * 8)
    scored = toxicity.score(table, model)
    assert ids(scored, "doc_id") == both and ids(scored, "n_chars") == both
    assert ids(jaccard.join(table), "doc_id") == both


def test_warc_pages_with_clashing_columns(spark):
    names = ["block", "record_id", "target_uri", "warc_date", "Warc_Headers", "key"]
    pages = spark.createDataFrame([("u", "<p>x", *["clash"] * 6)], ["url", "html", *names])
    assert [bytes(r["content"]) for r in warc.derive(warc.as_responses(pages)).filter("record_type = 'conversion'").collect()] == [b"x"]


def test_html_nesting_and_cells():
    story = "This is a story, told in a sentence of some length, so that nobody takes it for a menu; it goes on and on."
    assert html.main_text("<article>" + "<div>" * 3000 + f"<p>{story}<p>{story}") == f"{story}\n{story}"
    table = f"<article><p>{story}<table><tr><td>{story}<td>{story}<tr><td><ul><li>{story}<li>{story}</ul></table>"
    assert html.main_text(table) == "\n".join([story] * 5)


def test_min_cut_is_minimal():
    rng = random.Random(10)
    for _ in range(300):
        n = rng.randint(1, 6)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda side: sum(t[v] if side[v] else s[v] for v in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost(html.min_cut(s, t, edges)) == min(cost([m >> v & 1 for v in range(n)]) for m in range(1 << n))


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for p in pages:
        body = p["html"][p["html"].index("<article>") + 9 : p["html"].index("</article>")]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
        assert html.main_text(p["html"]) == "\n".join(x for x in parts if x)
    other = '<body><nav><a href=x>Home</a></nav><div class="content"><h2>Title here</h2>First part of the text, with words. <ul><li>one<li>two, three</ul> tail text of the story, rather long.</div><form>Name <button>Go</button></form><div id="comments"><p>Nice post, I liked it very much!</p></div></body>'
    assert html.main_text(other) == "Title here\nFirst part of the text, with words.\none\ntwo, three\ntail text of the story, rather long."
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p", "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html.extract(rows).collect()] == ["", "", ""] and html.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before, after",
    [
        ("<html><head><title>Name</title><meta charset=utf-8><body>", ""),
        ("<head><style>p {}</style>", ""),
        ("<head><title>Name</title></head><select><option>A<option>B</select>", ""),
        ("<select><optgroup label=x><option>A<option>B<optgroup label=y><option>C</select>", ""),
        ("<div><button>Go</div>", ""),
        ("<div><button><div>Go</div> on</button></div>", ""),
        ("<div><svg><g><path></div>", ""),
        ("<object data=x>", ""),
        ("<noscript>", ""),
        ("<svg><path>", "<div><button>Go</button></div>"),
        ("<head></head><datalist><option>A<option>B</datalist>", "<select><option>C<option>D</select>"),
    ],
)
def test_html_with_omitted_end_tags(before, after):
    story = "This is a story, told in a sentence of some length, so that nobody takes it for a menu; it goes on and on."
    assert html.main_text(f"{before}<article><p>{story}</p><p>{story}</p></article>{after}") == f"{story}\n{story}"


def test_substring_passages(spark):
    rng = random.Random(11)
    passage = babble(rng, 70)
    fuzzy = [*passage[:30], "changed", *passage[31:50], *passage[51:]]
    texts = [*ODD, *[" ".join(babble(rng, 40) + p + babble(rng, 40)) for p in (passage, passage, fuzzy)], *[" ".join(babble(rng, 200)) for _ in range(5)], " ".join(babble(rng, 5) + babble(rng, 30) * 1 + passage[:20]), " ".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 12)]
    n = len(ODD)
    table = docs(spark, texts).repartition(3)
    found = substrings.passages(table)
    spans = {(r["doc_id"]): (r["start"], r["stop"]) for r in substrings.spans(found).collect()}
    assert set(spans) == {n + 1, n + 2, len(texts) - 1}
    assert spans[n + 1] == (40, 110) and spans[n + 2] == (40, 40 + len(fuzzy)) and spans[len(texts) - 1] == (10, 120)
    left = {r["doc_id"]: r["text"] for r in substrings.cut(table, found).collect()}
    assert len(left) == len(texts) and left[n] == texts[n] and left[n + 1].split() == texts[n + 1].split()[:40] + texts[n + 1].split()[110:]
    assert all(left[i] == texts[i] for i in range(n))
    assert substrings.passages(table.limit(0)).count() == 0


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_substring_passages_over_edit_rates(spark):
    rng = random.Random(12)
    pairs = [(n, rate) for rate in (0, 5, 10, 15, 20) for n in (60, 75, 100) for _ in range(12)]
    texts, close = [], []
    for n, rate in pairs:
        passage = [w + str(rng.randrange(50)) for w in babble(rng, n)]
        other = [w for x in passage for w in ([x] if rng.random() >= rate / 100 else rng.choice([["new" + x], [], [x, "more" + x]]))]
        texts += [" ".join(babble(rng, 60) + x + babble(rng, 60)) for x in (passage, other)]
        close.append(len(other) >= 50 and edits_between(other, passage) <= 0.2 * len(other))
    found = {(r["doc_id"], r["first_doc"]): r for r in substrings.passages(docs(spark, texts)).collect()}
    assert all(d == f + 1 and f % 2 == 0 for d, f in found)
    for rate, share in ((0, 1), (5, 1), (10, 0.97), (15, 0.9), (20, 0.75)):
        asked = [2 * i + 1 for i, (_, r) in enumerate(pairs) if r == rate and close[i]]
        assert sum((d, d - 1) in found for d in asked) >= share * len(asked) > 0, rate
    for r in found.values():
        a, b = (texts[r[x]].split()[r[s] : r[e]] for x, s, e in (("doc_id", "start", "stop"), ("first_doc", "first_start", "first_stop")))
        assert len(a) >= 50 and len(a) - edits_between(a, b) >= r["matched"] >= 0.8 * len(a)


def test_substring_passages_whose_parts_stand_first_elsewhere(spark):
    rng = random.Random(13)
    x, y = babble(rng, 45), babble(rng, 45)
    short, long = babble(rng, 40), babble(rng, 12)
    parts = [x, y, x + y, x + y, short, short + long, short + long, babble(rng, 51) * 2]
    texts = [" ".join(babble(rng, 30) + p + babble(rng, 30)) for p in parts]
    words = [t.split() for t in texts]
    first, asked = {}, set()
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), (i, j)) != (i, j):
                asked |= {(i, k) for k in range(j, j + 50)}
    found = {(r["doc_id"], k) for r in substrings.passages(docs(spark, texts)).collect() for k in range(r["start"], r["stop"])}
    assert {i for i, _ in asked} == {3, 6, 7} and asked <= found and {i for i, _ in found} == {3, 6, 7}


def test_substring_passages_of_periodic_texts(spark):
    """Words and pairs said over and over, whose runs may hold no seed: a few links, and no word of an exact repeat is lost."""
    rng = random.Random(15)
    said = [(w, n) for w in ("uno", "due", "tre", "quattro", "cinque sei", "sette otto", "nove dieci", "uno due tre") for n in (70, 170, 400)]
    texts = [" ".join([*babble(rng, 20), *[w] * n, *babble(rng, 20)]) for w, n in said] + [" ".join(babble(rng, 10) + ["cinque sei"] * 90 + ["uno"] * 90 + babble(rng, 10))]
    first, asked = {}, set()
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), (i, j)) != (i, j):
                asked |= {(i, k) for k in range(j, j + 50)}
    rows = substrings.passages(docs(spark, texts)).collect()
    found = {(r["doc_id"], k) for r in rows for k in range(r["start"], r["stop"])}
    assert asked <= found and len(found - asked) <= len(texts) * 10
    p = np.array([3, 4, 5, 6, 9, 10, 12])
    own = np.array([-1, 3, 4, 5, 8, 8, -1])
    assert substrings.stretch_ends(p, own).tolist() == [False, True, False, True, True, True, False]
    assert substrings.stretch_ends(p[:0], own[:0]).tolist() == []


def test_substring_passages_of_long_texts_and_repeated_ids(spark):
    rng = random.Random(14)
    long = babble(rng, 900)
    a, b = babble(rng, 70), babble(rng, 30)
    rows = [(0, long), (1, babble(rng, 20) + long + babble(rng, 20)), (2, a), (3, babble(rng, 5) + a), (3, a + a + b), (3, None), (None, a), (4, [*long[:450], "odd", *long[450:]])]
    table = spark.createDataFrame([(i, " ".join(w) if w else None, 2**53 + 1 if n else None) for n, (i, w) in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    found = substrings.passages(table)
    spans = {r["doc_id"]: (r["start"], r["stop"]) for r in substrings.spans(found).collect()}
    assert spans == {1: (20, 920), 3: (0, 140), 4: (0, 901)}
    left = sorted((str(r["doc_id"]), r["text"] or "", r["n_chars"] or 0) for r in substrings.cut(table, found).collect())
    assert [x[0] for x in left] == ["0", "1", "2", "3", "3", "3", "None"] and sorted(x[1].split() for x in left if x[0] == "3") == sorted([[], rows[3][1], b])
    assert {x[2] for x in left} == {0, 2**53 + 1}


def test_chains_are_collinear_and_cost_gaps():
    pos, first = np.array([0, 10, 20, 21, 30]), np.array([100, 110, 500, 121, 130])
    best = substrings.chains(pos, first)[0]
    assert pos[best].tolist() == [0, 10, 21, 30]


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in table.collect()}
        out = stage(spark, table, SF)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == corpus_pipeline.COLUMNS and set(after) <= set(before) and len(after) > 0.6 * len(before)
        if stage is corpus_pipeline.drop_near_copies:
            ids = sorted(before)
            _, comp = brute_components([before[i] for i in ids])
            assert set(after) == {ids[c] for c in set(comp)}
        table = spark.createDataFrame(out.collect(), table.schema)
    assert corpus_pipeline.run(spark, SF).count() >= 1
    odd = docs(spark, ODD).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).count() == len(ODD)
