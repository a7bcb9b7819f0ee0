"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each opN_ query applies its operator to a whole table and derives the columns of its contract from the
operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, mixing, passages, quality_model, quality_rules, simhash, topk, toxicity, warc
from .common import crc_mod, table

#: Token weights of the mixing query.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or tokenizer_path()
    return bpe.digests(bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "end", F.col("source").alias("source_doc_id"), "source_start", "source_end", "matches")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    got = toxicity.score(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of domains: the documents that have labels, with their language."""
    known = labels.select(F.col("doc_id").alias("_l")).distinct()
    return docs.join(known, docs["doc_id"] == known["_l"], "left_semi").select("doc_id", "text", F.col("lang").alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit(labelled_domains(docs, table(spark, sf_dir, "labels")), domains=sorted(TARGETS))
    got, model = mixing.rates(docs, model, TARGETS)
    shares = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return got.select("doc_id", F.col("tokens").alias("n_tokens"), *shares, F.round("rate", 6).alias("rate"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    got = quality_model.score(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return got.select(
        F.substring("record_id", 2, 19).cast("long").alias("page_id"),
        "url",
        F.substring("base_id", 2, 19).cast("long").alias("base_page_id"),
        "outcome",
        merged.alias("headers"),
        F.md5("body").alias("body_md5"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.chat_format(chat.reply_order(chat.quoting_messages(table(spark, sf_dir, "conversations"))))
    return got.select("conv_id", "turn", "role", "text", "reply_to", "branch", "depth", "path", "chat")


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_topk": op2_topk,
        "op3_passages": op3_passages,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_mixing": op7_mixing,
        "op8_quality_model": op8_quality_model,
        "op9_warc": op9_warc,
        "op10_chat": op10_chat,
    }


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

WARC_SQL = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(trim(url, ' '), '#.*$', '') AS u,
         1704067200 + page_id * 60 AS sec, substr(md5(coalesce(html, '')), 1, 12) AS tag
  FROM pages WHERE page_id IS NOT NULL),
p AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host0,
         regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path0,
         list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z0-9_]*|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM u),
c AS (
  SELECT page_id, html, sec, tag,
         CASE WHEN scheme = '' THEN u ELSE scheme || '://' ||
           CASE WHEN scheme = 'http' THEN regexp_replace(host0, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host0, ':443$', '') ELSE host0 END
           || CASE WHEN path0 = '' THEN '/' ELSE path0 END
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url
  FROM p),
a AS (
  SELECT r.page_id, r.url, r.tag, max(struct_pack(sec := b.sec, page_id := b.page_id)) AS base
  FROM c r LEFT JOIN c b ON b.url = r.url AND b.sec < r.sec + 86400
  GROUP BY r.page_id, r.url, r.tag),
j AS (
  SELECT a.page_id, a.url, a.base.page_id AS base_id, b.html AS html, b.tag AS base_tag, length(b.html) AS n,
         CASE WHEN a.page_id % 7 = 3 THEN NULL WHEN a.page_id % 5 = 4 THEN '"old"' ELSE '"' || a.tag || '"' END AS tag,
         CASE WHEN a.page_id % 5 = 4 THEN '"old"' ELSE 'W/"' || a.tag || '"' END AS sent,
         CASE WHEN a.page_id % 11 <> 5 THEN 'day ' || (a.page_id % 28) END AS modified, 'day ' || (b.page_id % 28) AS base_modified
  FROM a LEFT JOIN c b ON b.page_id = a.base.page_id),
o AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no_base' WHEN tag IS NULL AND modified IS NULL THEN 'unvalidated'
    WHEN CASE WHEN tag IS NOT NULL THEN tag = '"' || base_tag || '"' ELSE modified = base_modified END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM j)
SELECT page_id, url, base_id AS base_page_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || (page_id % 600) || chr(10) || 'content-length: ' || n || chr(10)
         || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(CASE WHEN tag IS NOT NULL THEN sent END, '"' || base_tag || '"') || chr(10)
         || 'last-modified: ' || coalesce(modified, base_modified) END AS headers,
       CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM o
"""


CHAT_SQL = r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, min(text) AS t, min(split_part(text, chr(10), 1)) AS f FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
quoting AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
    CASE ((c.conv_id + c.turn) % 6 + 6) % 6
      WHEN 1 THEN '> ' || replace(a.t, chr(10), chr(10) || '> ') || chr(10)
      WHEN 2 THEN 'They wrote:' || chr(10) || '> ' || b.f || chr(10)
      WHEN 3 THEN '> > ' || d.f || chr(10) || '> ' || b.f || chr(10)
      WHEN 4 THEN '>' || replace(lower(b.f), ' ', '  ') || ' !!' || chr(10)
      WHEN 5 THEN '> nobody said this here' || chr(10) END AS quote
  FROM conversations c LEFT JOIN s a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
    LEFT JOIN s b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 LEFT JOIN s d ON d.conv_id = c.conv_id AND d.turn = c.turn - 3),
m AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, CASE WHEN text IS NULL THEN '' ELSE coalesce(quote, '') || text END AS raw FROM quoting),
k AS (SELECT row_number() OVER () AS id, *, substr(md5(role || chr(10) || raw), 1, 16) AS key FROM m),
lines AS (SELECT id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS place FROM k),
marked AS (
  SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, lead(mark) OVER (PARTITION BY id ORDER BY place) AS after
  FROM (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS mark FROM lines) x),
own AS (
  SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE level = 0
    AND NOT (coalesce(after, '') <> '' AND regexp_matches(line, '(?i)^[^>]*\b(wrote|schrieb|escribi\x{00f3}|a \x{00e9}crit)[ \t]*:[ \t]*$'))), ''), '^\s+|\s+$', '', 'g') AS text
  FROM marked GROUP BY id),
msg AS (SELECT k.id, conv_id, turn, role, key, own.text FROM k JOIN own USING (id)),
said AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS p
  FROM (SELECT conv_id, turn, unnest(list_concat([text], string_split(text, chr(10)))) AS p FROM msg) x),
runs AS (
  SELECT id, level, place, regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS line,
    place - row_number() OVER (PARTITION BY id, level ORDER BY place) AS run
  FROM marked WHERE level > 0),
quoted AS (SELECT id, level, run, min(place) AS place, string_agg(line, ' ' ORDER BY place) AS whole, list(line ORDER BY place) AS parts FROM runs GROUP BY id, level, run),
probe AS (
  SELECT id, level, place, part, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM (
    SELECT id, level, place, 0 AS part, whole AS p FROM quoted
    UNION ALL SELECT id, level, place, unnest(generate_series(1, len(parts))), unnest(parts) FROM quoted WHERE len(parts) > 1) x),
hit AS (
  SELECT probe.id, (part > 0) AS single, level, place, part, max(said.turn) AS turn
  FROM probe JOIN msg USING (id) JOIN said ON said.conv_id = msg.conv_id AND said.p = probe.p AND said.turn < msg.turn
  WHERE probe.p <> '' GROUP BY ALL),
link AS (SELECT id, turn AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY single, level, place, part) AS rn FROM hit) x WHERE rn = 1),
linked AS (SELECT msg.*, reply_to FROM msg LEFT JOIN link USING (id)),
head AS (
  SELECT conv_id, turn AS head, max(reply_to) AS start FROM linked l WHERE reply_to IS NOT NULL GROUP BY conv_id, turn
  HAVING max(reply_to) < (SELECT max(b.turn) FROM msg b WHERE b.conv_id = l.conv_id AND b.turn < l.turn)),
tree AS (SELECT h.conv_id, h.head, h.start, max(u.head) AS up FROM head h LEFT JOIN head u ON u.conv_id = h.conv_id AND u.head <= h.start GROUP BY ALL),
step AS (
  SELECT *, '~' || CASE WHEN (-1 - start) < 0 THEN chr(CAST(91 - length(to_hex(-1 - (-1 - start))) AS INTEGER)) || translate(upper(to_hex(-1 - (-1 - start))), '0123456789ABCDEF', 'FEDCBA9876543210') ELSE chr(CAST(96 + length(to_hex(-1 - start)) AS INTEGER)) || upper(to_hex((-1 - start))) END
    || CASE WHEN head < 0 THEN chr(CAST(91 - length(to_hex(-1 - head)) AS INTEGER)) || translate(upper(to_hex(-1 - head)), '0123456789ABCDEF', 'FEDCBA9876543210') ELSE chr(CAST(96 + length(to_hex(head)) AS INTEGER)) || upper(to_hex(head)) END AS mark
  FROM tree),
paths AS (
  SELECT conv_id, head, mark AS path, 1 AS depth FROM step WHERE up IS NULL
  UNION ALL SELECT t.conv_id, t.head, p.path || t.mark, p.depth + 1 FROM step t JOIN paths p ON p.conv_id = t.conv_id AND p.head = t.up),
placed AS (SELECT l.id, max(h.head) AS branch FROM linked l JOIN head h ON h.conv_id = l.conv_id AND h.head <= l.turn GROUP BY l.id)
SELECT l.conv_id, l.turn, l.role, l.text, l.reply_to, placed.branch, CAST(coalesce(paths.depth, 0) AS INTEGER) AS depth,
  coalesce(paths.path, '') || '-' || CASE WHEN l.turn IS NULL THEN 'z' ELSE CASE WHEN l.turn < 0 THEN chr(CAST(91 - length(to_hex(-1 - l.turn)) AS INTEGER)) || translate(upper(to_hex(-1 - l.turn)), '0123456789ABCDEF', 'FEDCBA9876543210') ELSE chr(CAST(96 + length(to_hex(l.turn)) AS INTEGER)) || upper(to_hex(l.turn)) END END || l.key AS path,
  '<|' || regexp_replace(l.role, '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) || regexp_replace(l.text, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || '<|end|>' AS chat
FROM linked l LEFT JOIN placed ON placed.id = l.id LEFT JOIN paths ON paths.conv_id = l.conv_id AND paths.head = placed.branch
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK_SQL, "op9_warc": WARC_SQL, "op10_chat": CHAT_SQL}
