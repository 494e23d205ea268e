"""Queries with SQL are held against DuckDB, on the smallest tables and on odd rows."""

import duckdb
import pytest

from gridlens.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "conversations"]
WHERE = [(n, w) for n in sorted(queries.oracle_sql()) for w in (["sf"] if n.startswith(("op12", "op13")) else ["sf", "odd"])]  # odd vectors: test_vectors.py
ODD = [None, "", " \n\t", "one", "a b c d", "tie tie tie tie tie tie", "x" * 3000, "Straße ÉTÉ K \U0001f642 </s> <|end|> \\ \\<s>", "Licensed under CC BY 4.0, CC-BY", "All rights reserved. " * 40]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Nulls in every column, repeated ids and rows, texts of no word, and two that nearly agree."""
    at = tmp_path_factory.mktemp("odd")
    near = [f"w{i}" for i in range(200)]
    texts = [*ODD, " ".join(near), " ".join([*near[:198], "y", "z"]), " ".join(near[:60])]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, NULL, NULL)", [(i, t, None if i % 3 else "en") for i, t in enumerate(texts)] + [(None, "a b c d", "en"), (4, "tie tie tie tie tie tie", "en"), (4, "a b c d", None), (10, " ".join(near), "en")])
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", [(None, 1, 0), (10, 1, 0), (10, 0, 0), (11, None, 1), (12, 1, 0), (12, 1, 0)])
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [(i // 3, i % 2, ["user", "assistant", None][i % 3], t) for i, t in enumerate(ODD)] + [(None, 0, "assistant", "lost"), (None, None, "to<ol|", "[INST"), (5, None, None, None)])
    for t in TABLES:
        c.execute(f"COPY {t} TO '{at}/{t}.parquet'")
    return str(at)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name, where", WHERE)
def test_query_equals_sql(spark, odd, name, where):
    sf = SF if where == "sf" else odd
    c = duckdb.connect()
    for t in [*TABLES, *(["embeddings"] if where == "sf" else [])]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)
