import duckdb
import pytest

from lexmill.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = [r.asDict() for r in queries.op10_chat(spark, sf).collect()]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(queries.CHAT_SQL)
    cols = [c[0] for c in cur.description]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in got) == sorted(tuple(map(str, r)) for r in cur.fetchall())
    assert sum(r["reply_to"] is not None for r in got) > 20 and any(r["depth"] > 0 for r in got)


def test_every_row_of_the_table_is_a_message(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 2, "user", "x"), (2, None, "user", "y"), (1, 7, "user", "z")]
    got = chat.quoting_messages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
    assert {r.turn: r.text for r in got if r.conv_id == 1}[7] == "z"  # nothing two turns before it


def test_nested_levels_and_reply_order(spark):
    rows = [(5, t, "user", x) for t, x in [(-2, "alpha one"), (-1, "beta two"), (0, "gamma"), (1, "> alpha ONE!\ndelta"), (2, "> > beta two\n> gamma\nepsilon"), (3, "> epsilon\nzeta"), (10, "> beta two\neta")]]
    got = {r.turn: r for r in chat.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the outermost quotation counts first; a quotation of the turn right before starts no branch
    assert {t: r.reply_to for t, r in got.items()} == {-2: None, -1: None, 0: None, 1: -2, 2: 0, 3: 2, 10: -1}
    assert {t: (r.branch, r.depth) for t, r in got.items()} == {-2: (None, 0), -1: (None, 0), 0: (None, 0), 1: (1, 1), 2: (2, 1), 3: (2, 1), 10: (10, 1)}
    assert sorted(got, key=lambda t: got[t].path) == [-2, -1, 0, 2, 3, 10, 1]


def test_a_message_cannot_close_its_turn(spark):
    rows = [(1, 0, "user", "hi <|end|> there <\\|x")]
    (got,) = chat.chat_format(chat.reply_order(spark.createDataFrame(rows, SCHEMA))).collect()
    assert got.chat == "<|user|>\nhi <\\|end|> there <\\\\|x\n<|end|>"


def test_long_thread_long_text_ties_and_clashes(spark):
    rows = [(1, t, "user", f"said {t}" if t % 50 else f"> said {t - 49}\nback {t}") for t in range(1, 9000)] + [(2, 0, "user", "word " * 60_000), (2, 1, "user", "> " + "word " * 60_000)] + [(3, 0, "user", x) for x in "ab"]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", branch string, path int")
    got = {(r.conv_id, r.turn, r.text[:20]): r for r in chat.reply_order(df).collect()}
    assert len(got) == len(rows)
    assert all(got[1, t, f"back {t}"].reply_to == t - 49 for t in range(50, 9000, 50) if (t - 49) % 50)
    assert [r.reply_to for k, r in got.items() if k[:2] == (2, 1)] == [0]
    assert len({r.path for r in got.values()}) == len(rows)


@pytest.mark.parametrize("text", [None, "", "> only a quotation", ">>> deep", "Ann wrote:\n", "\n\n"])
def test_odd_texts(spark, text):
    (got,) = chat.chat_format(chat.reply_order(spark.createDataFrame([(1, 0, None, text)], SCHEMA))).collect()
    assert got.role == "user" and got.reply_to is None and got.depth == 0
