from pyspark.sql import functions as F

from lexmill.streaming import feeds

CHANGES = "id long, version long, event_type string, value double"


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder))


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_latest_per_key_over_three_runs(spark, tmp_path):
    sent, state = tmp_path / "sent", str(tmp_path / "state")
    put(spark, sent, [(1, 1, "a", 1.0), (2, 1, "b", 1.0)], CHANGES)

    def run():
        return {r.id: (r.version, r.event_type) for r in feeds.latest_per_key(source(spark, sent, CHANGES), "id", "version", state).collect()}

    assert run() == {1: (1, "a"), 2: (1, "b")}
    assert run() == {1: (1, "a"), 2: (1, "b")}  # nothing new
    put(spark, sent, [(1, 3, "c", 1.0), (2, 0, "late", 1.0), (3, 1, "d", None)], CHANGES)
    assert run() == {1: (3, "c"), 2: (1, "b"), 3: (1, "d")}
    assert run() == {1: (3, "c"), 2: (1, "b"), 3: (1, "d")}


def test_latest_per_key_of_nothing(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    assert feeds.latest_per_key(source(spark, tmp_path / "sent", CHANGES), "id", "version", str(tmp_path / "state")).count() == 0


def test_tumbling_counts_drop_what_is_too_late(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    sent, state = tmp_path / "sent", str(tmp_path / "state")

    def at(hour, minute):
        import datetime

        return datetime.datetime(2024, 1, 1, hour, minute)

    def run():
        got = feeds.tumbling_counts(source(spark, sent, schema), state)
        return {(r.h, r.event_type): r.n for r in got.select(F.hour("start").alias("h"), "event_type", "n").collect()}

    put(spark, sent, [(at(1, 5), "a", 1.0), (at(1, 50), "a", 1.0), (at(2, 5), "a", 1.0)], schema)
    assert run() == {(1, "a"): 2, (2, "a"): 1}
    assert run() == {(1, "a"): 2, (2, "a"): 1}
    put(spark, sent, [(at(2, 30), "a", 1.0), (at(5, 0), "b", 1.0)], schema)
    assert run() == {(1, "a"): 2, (2, "a"): 2, (5, "b"): 1}
    put(spark, sent, [(at(1, 6), "a", 1.0), (at(5, 1), "b", 1.0)], schema)  # the window at one is long gone
    assert run() == {(1, "a"): 2, (2, "a"): 2, (5, "b"): 2}


def test_late_attachments_wait_for_their_paper(spark, tmp_path):
    schema = "paper_key string, key string, filename string, content_type string"
    sent, state = tmp_path / "sent", str(tmp_path / "state")
    put(spark, sent, [("P1", "a", "a.pdf", ""), ("P2", "b", "b.pdf", ""), ("P2", "b", "b.pdf", "")], schema)

    def run(*papers):
        done, waiting = feeds.late_attachments(source(spark, sent, schema), spark.createDataFrame([(p,) for p in papers], "key string"), state)
        return sorted(r.key for r in done.collect()), sorted(r.key for r in waiting.collect())

    assert run("P1") == (["a"], ["b"])
    assert run("P1") == (["a"], ["b"])
    put(spark, sent, [("P3", "c", "c.pdf", "")], schema)
    assert run("P1", "P2") == (["a", "b"], ["c"])
    assert run("P1", "P2", "P3") == (["a", "b", "c"], [])


def test_queue_takes_each_key_once(spark, tmp_path):
    sent, state = tmp_path / "sent", str(tmp_path / "state")
    put(spark, sent, [(1, "x"), (1, "y"), (2, "z")], "id long, what string")

    def run():
        return sorted((r.id, r.what) for r in feeds.enqueued(source(spark, sent, "id long, what string"), "id", state).collect())

    assert run() == [(1, "x"), (2, "z")]
    put(spark, sent, [(1, "w"), (3, "v")], "id long, what string")
    assert run() == run() == [(1, "x"), (2, "z"), (3, "v")]


def test_poll_outcomes_and_admission(spark):
    polls = [(1, t, s) for t, s in enumerate(["processing", None, None, "processing", "done_with_errors", "failed"])] + [(2, t, None) for t in range(12)] + [(3, 0, "processing")] + [(4, 0, "failed")]
    got = {r.job_id: (r["at"], r.outcome) for r in feeds.poll_outcomes(spark.createDataFrame(polls, "job_id long, at long, status string")).collect()}
    assert got == {1: (4, "done"), 2: (9, "unreachable"), 4: (0, "failed")}
    jobs = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 5), (2, 9, 100)], "client_id long, job_id long, remaining long")
    assert sorted(r.job_id for r in feeds.admitted(jobs, 10).collect()) == [1, 2, 9]
