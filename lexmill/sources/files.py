"""Files: a folder's PDFs with their content hashes, and OCR results as pages.

Both are scans by Spark's own readers, so any store that Spark reaches will do, and both skip what those readers
skip: names that start with a dot or an underscore.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OCR = "pages array<struct<page:int,markdown:string,text:string>>"


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``folder``, ``name`` (without the ending), ``length`` and ``hash`` (SHA-256) of all PDFs below ``root``.

    The ending counts in any case. A folder without PDFs gives no rows. Copies each have a row; see :func:`first_of_each`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"),
        "length",
        F.sha2("content", 256).alias("hash"),
    )


def first_of_each(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One file of each content, the one with the smallest path, without contents whose ``hash`` is in ``known``."""
    first = files.groupBy("hash").agg(F.min_by(F.struct(*files.columns), "path").alias("f")).select("f.*")
    return first if known is None else first.join(known.select("hash"), "hash", "left_anti").select(*files.columns)


def folders_of(files: DataFrame, root: str) -> DataFrame:
    """``path``, ``name`` and ``parent_path`` (null: the root) of the folders that hold PDFs, and of all between them and ``root``."""
    base = root.rstrip("/")
    inner = F.split(F.substr("folder", F.lit(len(base) + 2)), "/")
    steps = F.filter(inner, lambda x: x != "")
    paths = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat_ws("/", F.lit(base), F.array_join(F.slice(steps, 1, n), "/")))
    rows = files.select(F.explode(F.transform(paths, lambda p: F.rtrim(p, F.lit("/")))).alias("path")).distinct()
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.when(F.col("path") != base, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("parent_path"))


def with_source(sources: DataFrame, root: str) -> DataFrame:
    """``sources`` with the directory ``root``, once however often it is imported; a new one has the next id."""
    base = root.rstrip("/")
    known = sources.where((F.col("source_type") == "directory") & (F.col("path") == base))
    new = sources.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(base.rsplit("/", 1)[-1]).alias("name"), F.lit("directory").alias("source_type"), F.lit(base).alias("path"))
    return sources.select("id", "name", "source_type", "path").unionByName(new.join(known.select("path"), "path", "left_anti").select("id", "name", "source_type", "path"))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Older rows with the columns that were added since, at their defaults; columns that are there keep their values, nulls too."""
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def bridge_of(paper: DataFrame) -> DataFrame:
    """The memberships that papers' own folders stand for, where there were none yet."""
    return paper.where("folder_id is not null").select(F.col("id").alias("paper_id"), "folder_id").distinct()


def write_documents(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines in a new version of ``folder``; readers see the old files or the new ones, never half of them.

    Spark commits a version as a whole; :func:`read_documents` takes the newest that was committed.
    """
    version = uuid.uuid4().hex
    rows.write.json(f"{folder}/versions/{version}")
    spark = rows.sparkSession
    spark.createDataFrame([(time.time_ns(), version)], "at long, version string").coalesce(1).write.mode("append").json(f"{folder}/log")


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    newest = spark.read.schema("at long, version string").json(f"{folder}/log").orderBy(F.desc("at")).first()
    return spark.read.schema(schema).json(f"{folder}/versions/{newest['version']}")


def eval_set(sample: DataFrame, seed: int, size: int) -> DataFrame:
    """One row: ``seed``, ``size``, ``strata`` (papers picked of each) and ``paper_ids`` (sorted; as many as ``size``)."""
    strata = sample.groupBy("stratum").agg(F.count("*").cast("int").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", "n")))).alias("strata"))
    ids = sample.agg(F.array_sort(F.collect_list("id")).alias("paper_ids"))
    return strata.crossJoin(ids).select(F.lit(seed).alias("seed"), F.lit(size).alias("size"), "strata", "paper_ids")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def read_ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``hash``, ``place`` (from 0) and ``text`` of the pages in ``folder``'s ``<hash>.json`` files.

    Pages come in the order of their ``page`` (0 if there is none), equal ones in the file's order. The text is the
    markdown, or else the plain text, or else empty, without space around it. Malformed files and files without pages
    give no rows.
    """
    read = spark.read.schema(_OCR).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    keyed = F.transform("pages", lambda p, i: F.struct(F.coalesce(p["page"], F.lit(0)).alias("page"), i.alias("i"), F.coalesce(F.nullif(p["markdown"], F.lit("")), p["text"], F.lit("")).alias("text")))
    pages = read.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("hash"), F.posexplode(F.array_sort(keyed)).alias("place", "p"))
    return pages.select("hash", "place", _stripped(F.col("p.text")).alias("text"))
