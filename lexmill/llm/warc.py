"""WARC records: reading, canonical URLs, and not-modified revisits resolved to the responses they stand for.

A revisit record of the server-not-modified kind (its profile says so, or it has status 304 and no other profile) says that
a server answered 304: it has no body, only headers. Revisits of other kinds, such as an identical digest, stand for a
response that was fetched in full; they are named and left as they are. A not-modified revisit is joined as of its time to the latest earlier full response (status 200) of the same canonical
URL, and takes that response's body if the validators allow it: an entity tag in the revisit must equal the
response's by weak comparison; without one, a Last-Modified must be the same; with neither, nothing can be
checked. The resolved headers are the response's, replaced by those a 304 may update (``PERMITTED``).

The join moves only ids, times and validators. Bodies are fetched for resolved revisits afterwards, by
record id, and only those that some revisit asks for are sorted and grouped. A URL's timeline is cut by time (:mod:`lexmill.llm.asof`), so a URL may hold any share of all rows.

Outcomes: ``resolved``; ``no_base`` (no earlier response; also null URL or time); ``mismatch`` (a validator
differs, or the response has none to compare with); ``unvalidated`` (the revisit has no validator); ``other_kind``. Only ``resolved`` rows get body and
merged headers. Records of a null id are ignored, of repeated ids one counts (the smallest as a struct).
Other types and statuses are no base. Empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .asof import latest_before
from .common import materialize

#: The headers that a 304 answer may carry for an update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a campaign or a referrer, not a resource.
TRACKING = r"^(utm_[a-z0-9_]*|ref|fbclid|gclid)(=|$)"
SCHEMA = "record_id string, type string, url string, time timestamp, status int, headers map<string,string>, body binary, profile string"
#: Records and bytes of one Arrow batch, about.
ROWS, BYTES = 200, 16 << 20
#: Seconds of a URL's timeline that one task sorts.
SPAN = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and tracking parameters, the rest sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def _tag(headers: str) -> Column:
    """The entity tag without its weakness mark."""
    return F.regexp_replace(F.col(headers)["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit of ``records`` (``SCHEMA``, the profile may be absent; header names in lower case).

    ``record_id``, ``url`` (canonical), ``time``, ``base_id``, ``outcome``, ``headers`` and ``body``.
    """
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    if "profile" not in records.columns:
        records = records.withColumn("profile", F.lit(None).cast("string"))
    rows = records.where(F.col("record_id").isNotNull()).select(*columns)
    light = rows.select(
        "record_id", F.col("type").alias("_type"), canonical_url(F.col("url")).alias("_url"), F.unix_micros("time").alias("_at"), F.col("status").alias("_status"),
        _tag("headers").alias("_tag"), F.col("headers")["last-modified"].alias("_modified"),
        F.coalesce(F.contains(F.lower("profile"), F.lit("server-not-modified")), F.col("status") == 304, F.lit(False)).alias("_unchanged"),
    )
    light = light.groupBy("record_id").agg(F.min(F.struct("_type", "_url", "_at", "_status", "_tag", "_modified", "_unchanged")).alias("r")).select("record_id", "r.*")
    light = light.where("_type in ('response', 'revisit')")
    full = F.coalesce((F.col("_type") == "response") & (F.col("_status") == 200), F.lit(False))
    base = F.struct(F.col("record_id").alias("id"), F.col("_tag").alias("tag"), F.col("_modified").alias("modified"))
    found = latest_before(light, ["_url"], "_at", full, base, span * 1_000_000).where("_type = 'revisit'")
    same = F.when(F.col("_tag").isNotNull(), F.col("_tag").eqNullSafe(F.col("latest.tag"))).otherwise(F.col("_modified").eqNullSafe(F.col("latest.modified")))
    outcome = (
        F.when(~F.col("_unchanged"), "other_kind")
        .when(F.col("latest").isNull(), "no_base")
        .when(F.col("_tag").isNull() & F.col("_modified").isNull(), "unvalidated")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    found = found.select("record_id", F.col("_url").alias("url"), F.col("_at"), F.col("latest.id").alias("base_id"), outcome.alias("outcome"))
    own = rows.where("type = 'revisit'").groupBy("record_id").agg(F.min(F.to_json("headers")).alias("_own"))
    found = found.join(own, "record_id").withColumn("_own", F.from_json("_own", "map<string,string>"))
    found = materialize(found)
    wanted = found.where("outcome = 'resolved'").select(F.col("base_id").alias("record_id")).distinct()
    full_rows = rows.where("type = 'response' and status = 200").select("record_id", "headers", "body").join(wanted, "record_id", "left_semi")
    bodies = full_rows.groupBy(F.col("record_id").alias("_base")).agg(F.min(F.struct(F.to_json("headers").alias("h"), F.col("body").alias("b"))).alias("_full"))
    out = found.join(bodies, (F.col("outcome") == "resolved") & (F.col("base_id") == F.col("_base")), "left")
    update = F.map_filter("_own", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.from_json("_full.h", "map<string,string>"), lambda k, v: ~F.map_contains_key(update, k))
    return out.select("record_id", "url", F.timestamp_micros("_at").alias("time"), "base_id", "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, update)).alias("headers"), F.col("_full.b").alias("body"))


def parse_warc(data: bytes):
    """The records of one WARC file, plain or gzipped, as dicts of ``SCHEMA``, member by member.

    A broken tail ends the file, with the records before it; a record whose length isn't a number is left out.
    """
    raw = io.BytesIO(data)
    stream = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = _headers(stream)
            length = head.get("content-length", "0")
            if not length.isdigit():
                continue
            block = stream.read(int(length))
            if len(block) < int(length):
                return
            status, headers, body = None, {}, block
            if head.get("content-type", "").startswith("application/http"):
                http = io.BytesIO(block)
                first = http.readline().split()
                status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
                headers = _headers(http)
                body = http.read()
            yield {
                "record_id": head.get("warc-record-id", "").strip("<>") or None, "type": head.get("warc-type"), "url": head.get("warc-target-uri", "").strip("<>") or None,
                "time": head.get("warc-date"), "status": status, "headers": list(headers.items()), "body": body, "profile": head.get("warc-profile"),
            }
    except (EOFError, OSError, zlib.error):
        return


def _headers(stream) -> dict[str, str]:
    """Names in lower case; the values of a repeated name joined by commas."""
    out: dict[str, str] = {}
    while (line := stream.readline().strip()) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (``SCHEMA``) of all WARC files under ``path``.

    A file is one task's, as gzip members can't be found from outside; it is held compressed, and unpacked a record at a
    time. Spark's reader takes files of less than 2 GB.
    """

    def parse(batches):
        kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("time", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("profile", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                held: list = []
                size = 0
                for r in parse_warc(data.as_py() or b""):
                    held.append(r)
                    size += len(r["body"])
                    if len(held) == ROWS or size >= BYTES:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    rows = files.mapInArrow(parse, SCHEMA.replace("time timestamp", "time string"))
    return rows.withColumn("time", F.try_to_timestamp("time"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages, by arithmetic on page_id: each page is fetched, and asked for again a day later.

    Response k is fetched at minute k; its revisit comes a day later with the page's entity tag (none if k % 7
    is 3; an outdated one if k % 5 is 4) and Last-Modified (none if k % 11 is 5), a new Cache-Control
    and a Content-Length, which a 304 may not change.
    """
    k = F.col("page_id")
    start = F.lit(1_704_067_200)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 12), F.lit('"'))
    when = F.concat(F.lit("day "), (k % 28).cast("string"))
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("etag"), tag, F.lit("last-modified"), when)
    again = F.create_map(
        F.lit("etag"), F.when(k % 7 == 3, None).when(k % 5 == 4, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)),
        F.lit("last-modified"), F.when(k % 11 != 5, when),
        F.lit("cache-control"), F.concat(F.lit("max-age="), (k % 600).cast("string")), F.lit("content-length"), F.lit("0"),
    )
    id_ = F.lpad(k.cast("string"), 19, "0")
    body = F.col("html").cast("binary")
    response = pages.select(F.concat(F.lit("p"), id_).alias("record_id"), F.lit("response").alias("type"), "url", F.timestamp_seconds(start + k * 60).alias("time"), F.lit(200).alias("status"), full.alias("headers"), body.alias("body"), F.lit(None).cast("string").alias("profile"))
    revisit = pages.select(F.concat(F.lit("r"), id_).alias("record_id"), F.lit("revisit").alias("type"), "url", F.timestamp_seconds(start + k * 60 + 86_400).alias("time"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("profile"))
    return response.unionByName(revisit)
