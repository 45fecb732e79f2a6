"""Queries of the operators against their SQL."""

import random

import duckdb
import pytest

from filigree.llm import chat, queries


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


def same_rows(spark, folder, name, tables):
    sql = duckdb.connect()
    for t in tables:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if tables[t] else ''}')")
    want = sql.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, str(folder)).select(*columns).collect()
    key = repr
    assert sorted((tuple(plain(x) for x in r) for r in got), key=key) == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=key)
    return got


@pytest.mark.parametrize(("name", "table"), [("op2_url_filters", "pages"), ("op3_ngram_jaccard", "documents"), ("op9_chat_windows", "conversations")])
def test_query_equals_sql(spark, small, name, table):
    assert same_rows(spark, small, name, {table: False})


def test_windows_equal_sql_on_long_conversations(spark, tmp_path):
    """Several windows, null ids and texts, ties, turns longer than a window, odd characters."""
    rng = random.Random(5)
    words = ["a", "Ünder", "x_y", "42", "</turn>\n", '<turn role="', "\\h", "日本語", "…!", " ", "é", "\t"]
    rows = []
    for conv in [None, *range(12)]:
        roles = (["system"] if rng.random() < 0.5 else []) + [rng.choice(["user", "assistant", "system", None]) for _ in range(rng.randrange(1, 40))]
        for n, role in enumerate(roles):
            turn = None if rng.random() < 0.03 else n - rng.randrange(2)
            size = rng.choice([0, 1, 20, 60, 150, 700])
            rows.append((conv, turn, role, None if rng.random() < 0.05 else " ".join(rng.choices(words, k=size))))
    rows += rows[:5] + [(50, 0, "system", "only"), (51, 0, "system", "s " * 600), (51, 1, "user", "u")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    same_rows(spark, tmp_path, "op9_chat_windows", {"conversations": True})
    assert not chat.format_conversations(frame).where("window >= 3").isEmpty()
