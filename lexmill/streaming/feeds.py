"""Change feeds as Structured Streaming over a folder of Parquet files.

Every stream runs to the end of what is there (``availableNow``) and keeps its progress in a checkpoint beside its state, so a
second run takes up new files only, and one without new files changes nothing. A batch's state is written under its number; the
number is then appended to a log, which names the state that counts. A batch that is run again after a crash so starts from
the same state and writes the same one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import items
from ..sources.corpus import sample_corpus


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints; a temporary one only where one machine does everything."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexmill-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def feed(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


class State:
    """A table that batches replace, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _last(self, below: int | None = None) -> int | None:
        try:
            log = self.spark.read.schema("n int").parquet(f"{self.folder}/log")
        except AnalysisException:  # nothing was ever written
            return None
        return (log if below is None else log.where(F.col("n") < below)).agg(F.max("n")).first()[0]

    def read(self, below: int | None = None) -> DataFrame:
        n = self._last(below)
        return self.spark.createDataFrame([], self.schema) if n is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/state-{n}")

    def write(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/state-{n}")
        self.spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")


def _drain(changes: DataFrame, take, folder: str, mode: str = "append") -> None:
    changes.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def latest_per_key(changes: DataFrame, key: str, version: str, folder: str) -> DataFrame:
    """The newest change of each key; a replayed or late batch changes nothing it shouldn't."""
    spark = changes.sparkSession
    rows = changes.select(key, version, "event_type", "value")
    state = State(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))

    def merge(batch: DataFrame, n: int) -> None:
        known = State(batch.sparkSession, folder, state.schema)
        both = known.read(below=n).unionByName(batch)
        known.write(both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*"), n)

    _drain(rows, merge, folder)
    return state.read()


def tumbling_counts(events: DataFrame, folder: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window of ``width``: ``start``, ``event_type``, ``n``, ``total``.

    The stream keeps a window's state until the watermark, the latest time seen less ``late``, has passed its end; events for
    windows before that are dropped. Every batch gives the windows that it changed, and the last word on each counts.
    """
    spark = events.sparkSession
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    schema = "start timestamp, event_type string, n long, total double"

    def save(batch: DataFrame, n: int) -> None:
        known = State(batch.sparkSession, folder, schema)
        before = known.read(below=n).join(batch.select("start", "event_type"), ["start", "event_type"], "left_anti")
        known.write(before.unionByName(batch.select("start", "event_type", "n", "total")), n)

    _drain(rows, save, folder, "update")
    return State(spark, folder, schema).read()


def late_attachments(sent: DataFrame, known: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files whose paper is there by now, and those that still wait for theirs (both ``paper_key``, ``key``, ``filename``, ``content_type``).

    ``sent``: a stream of files; ``known``: the papers' keys (``key``) as of each run. What waits is tried again in every run.
    """
    spark = sent.sparkSession
    schema = "paper_key string, key string, filename string, content_type string"
    done, waiting = State(spark, f"{folder}/done", schema), State(spark, f"{folder}/waiting", schema)

    def place(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        old, pending = State(session, done.folder, schema), State(session, waiting.folder, schema)
        rows = pending.read(below=n).unionByName(batch.select("paper_key", "key", "filename", "content_type")).dropDuplicates(["key", "paper_key"])
        papers = known.select(F.col("key").alias("paper_key")).distinct()
        old.write(old.read(below=n).unionByName(rows.join(papers, "paper_key", "left_semi")).dropDuplicates(["key", "paper_key"]), n)
        pending.write(rows.join(papers, "paper_key", "left_anti"), n)

    _drain(sent, place, folder)
    # Papers may have come although no file has: what waits is looked at once more.
    papers = known.select(F.col("key").alias("paper_key")).distinct()
    rest = waiting.read()
    return done.read().unionByName(rest.join(papers, "paper_key", "left_semi")).dropDuplicates(["key", "paper_key"]), rest.join(papers, "paper_key", "left_anti")


def enqueued(sent: DataFrame, key: str, folder: str) -> DataFrame:
    """A queue that takes each key once, however often and in whichever run it is sent; the first row stays."""
    spark = sent.sparkSession
    schema = sent.schema.simpleString()[7:-1].replace(":", " ")

    def add(batch: DataFrame, n: int) -> None:
        queue = State(batch.sparkSession, folder, schema)
        known = queue.read(below=n)
        first = batch.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("r")).select("r.*")
        queue.write(known.unionByName(first.join(known.select(key), key, "left_anti").select(*batch.columns)), n)

    _drain(sent, add, folder)
    return State(spark, folder, schema).read()


def admitted(jobs: DataFrame, depth: int) -> DataFrame:
    """Jobs (``client_id``, ``job_id``, ``remaining``) to have in flight: in order, while the pages before them are fewer than ``depth``."""
    before = F.sum("remaining").over(Window.partitionBy("client_id").orderBy("job_id").rowsBetween(Window.unboundedPreceding, -1))
    return jobs.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < depth).select("client_id", "job_id", "before")


def poll_outcomes(polls: DataFrame, most: int = 10) -> DataFrame:
    """``job_id``, ``at`` and ``outcome`` of jobs that have ended: by the first terminal status, or the ``most``-th error in a row.

    ``polls``: ``job_id``, ``at`` and ``status`` (null: the poll failed).
    """
    order = Window.partitionBy("job_id").orderBy("at")
    rows = polls.withColumn("answers", F.count("status").over(order))
    rows = rows.withColumn("errors", F.when(F.col("status").isNull(), F.row_number().over(Window.partitionBy("job_id", "answers", F.col("status").isNull()).orderBy("at"))))
    outcome = F.when(F.col("status").isin("done", "done_with_errors"), "done").when(F.col("status") == "failed", "failed").when(F.col("errors") >= most, "unreachable")
    return rows.withColumn("outcome", outcome).where("outcome is not null").groupBy("job_id").agg(F.min(F.struct("at", "outcome")).alias("e")).select("job_id", "e.at", "e.outcome")


def extract_queue(paperfile: DataFrame, paperbiblio: DataFrame) -> DataFrame:
    """Papers and hashes of PDFs that are processed and whose content has no record yet, each once."""
    done = paperfile.where("status = 'processed' and hash <> '' and not lower(path) like '%.json'").select("paper_id", "hash").distinct()
    return done.join(paperbiblio.select("paper_id", F.col("file_hash").alias("hash")), ["paper_id", "hash"], "left_anti")


def stream_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(feed(spark, sf_dir), "user_id", "event_id", _folder(spark))


def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    got = tumbling_counts(events, _folder(spark))
    return got.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_late_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's late files, streamed: which have found their paper."""
    folder = _folder(spark)
    corpus = sample_corpus(spark, sf_dir)
    items.late_attachments(items._raw(corpus)).write.parquet(f"{folder}/sent")
    sent = spark.readStream.schema(spark.read.parquet(f"{folder}/sent").schema).parquet(f"{folder}/sent")
    done, waiting = late_attachments(sent, corpus.paper.select(F.col("zotero_key").alias("key")), folder)
    return done.select("key", "paper_key", F.lit(True).alias("placed")).unionByName(waiting.select("key", "paper_key", F.lit(False).alias("placed")))


def stream_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enqueued(feed(spark, sf_dir).select("event_type", F.col("event_id").cast("long").alias("event_id")), "event_type", _folder(spark))


#: Polls of the sample's jobs, by arithmetic on the event's id; the same text for both engines.
POLLS = """select user_id as job_id, event_id as at, case when event_id % 13 = 0 then null when user_id % 5 = 1 and event_id % 2 = 0 then 'done' when user_id % 5 = 2 and event_id % 3 = 0 then 'failed' when user_id % 5 = 3 then null else 'processing' end as status from {events}"""

QUERIES = {
    "stream_latest_per_key": stream_latest_per_key,
    "stream_tumbling_counts": stream_tumbling_counts,
    "stream_late_attachments": stream_late_attachments,
    "stream_enqueued": stream_enqueued,
    "admitted_jobs": lambda spark, sf_dir: admitted(sample_corpus(spark, sf_dir).sql("select client_id, job_id, greatest(0, total_pages - done_pages) as remaining from {job} where status <> 'done'"), 40),
    "poll_outcomes": lambda spark, sf_dir: poll_outcomes(sample_corpus(spark, sf_dir).sql(POLLS), 3),
    "extract_queue": lambda spark, sf_dir: extract_queue(sample_corpus(spark, sf_dir).paperfile, sample_corpus(spark, sf_dir).paperbiblio),
}
ORACLES = {
    "stream_latest_per_key": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from {events}) x where rn = 1",
    "stream_tumbling_counts": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, event_type, count(*) as n, round(sum(value), 4) as total from {events} group by 1, 2",
    "stream_late_attachments": f"with {items._WITH} select distinct key, parent_item as paper_key, parent_item in (select zotero_key from {{paper}}) as placed from att where parent_item not in (select key from par)",
    "stream_enqueued": "select event_type, min(event_id) as event_id from {events} group by event_type",
    "admitted_jobs": "select client_id, job_id, before from (select client_id, job_id, coalesce(sum(r) over (partition by client_id order by job_id rows between unbounded preceding and 1 preceding), 0) as before from (select *, greatest(0, total_pages - done_pages) as r from {job} where status <> 'done') j) x where before < 40",
    "poll_outcomes": f"""with p as ({POLLS}), e as (select *, lag(status, 1, 'x') over (partition by job_id order by "at") as s1, lag(status, 2, 'x') over (partition by job_id order by "at") as s2 from p),
        o as (select job_id, "at", case status when 'done' then 'done' when 'failed' then 'failed' else case when status is null and s1 is null and s2 is null then 'unreachable' end end as outcome from e)
      select job_id, min("at") as "at", arg_min(outcome, "at") as outcome from o where outcome is not null group by job_id""",
    "extract_queue": "select distinct paper_id, hash from {paperfile} f where status = 'processed' and hash <> '' and not path ilike '%.json' and not exists (select 1 from {paperbiblio} b where b.paper_id = f.paper_id and b.file_hash = f.hash)",
}
