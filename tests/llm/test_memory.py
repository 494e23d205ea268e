"""What Python workers hold: nothing of an earlier operator, and texts by bytes, not by rows."""

import weakref

import pyarrow as pa

from gridlens import session
from gridlens.llm import packing, queries, text


def test_a_task_frees_what_another_operator_kept(spark):
    path = queries.tokenizer_path()
    kept = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is kept()  # the same operator's later tasks find it
    over = text.in_slices(lambda frames: (f.assign(n=f["text"].str.len())[["n"]] for f in frames), "n long")
    assert [b.to_pydict() for b in over(iter([pa.record_batch({"text": ["ab", "c"]})]))] == [{"n": [2, 1]}]
    assert kept() is None


def test_stored_texts_reach_python_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([batch.nbytes], pa.int64())})

    texts = spark.range(0, 48, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 1000000) AS text")
    before = spark.conf.get(session.BATCH_KEY)
    rows = session.stored(texts.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in rows) == 48 and max(r["bytes"] for r in rows) <= session.BATCH + 2_000_000
    assert spark.conf.get(session.BATCH_KEY) == before
