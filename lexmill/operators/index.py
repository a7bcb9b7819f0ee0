"""The search index: posting lists by term, written once, read by term, replaced by paper.

An index is a folder with three tables. ``postings``: for each term and passage the positions (from 1) in every column, the
passage's paper, page and size in tokens; sorted by term over all files, so that a query reads the row groups of its own terms
only, a prefix those of its range. ``passages``: one row for each passage with its size. ``stats``: the number of passages and of
their tokens. Replacing papers writes a new folder: the other papers' rows as they are, and the new ones' postings.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..sources.corpus import Corpus, sample_corpus
from . import search as scan
from .query_language import COLUMNS, Near, Phrase, parse, scored
from .search import K1, LIMIT, PER_PAPER, B, tokens_of

#: Postings of one file, about.
FILE_ROWS = 4_000_000


class Index:
    """The tables of an index folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.postings, self.passages, self.stats = (spark.read.parquet(f"{folder}/{n}") for n in ("postings", "passages", "stats"))
        row = self.stats.first()
        self.n, self.tokens = int(row["n"]), int(row["tokens"])


def tokenised(corpus: Corpus, papers: DataFrame | None = None) -> DataFrame:
    """``id``, ``paper_id``, ``page``, ``size`` and the tokens of every column, a row for each passage (of ``papers``: their ids)."""
    passage = corpus.passage if papers is None else corpus.passage.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    names = corpus.author.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "name"))), lambda x: x["name"]), ", ").alias("names"))
    about = corpus.paper.select(F.col("id").alias("paper_id"), F.coalesce("title", F.lit("")).alias("t")).join(names, "paper_id", "left")
    about = about.select("paper_id", F.expr(tokens_of(SPARK, "t")).alias("title"), F.expr(tokens_of(SPARK, "coalesce(names, '')")).alias("authors"))
    rows = passage.select("id", "paper_id", "page", F.expr(tokens_of(SPARK, "text")).alias("text")).join(about, "paper_id")
    return rows.select("id", "paper_id", "page", sum((F.size(c) for c in COLUMNS), F.lit(0)).alias("size"), *COLUMNS)


def _postings(rows: DataFrame) -> DataFrame:
    """A row for each passage and term; made within the passage, without a shuffle."""
    def places(c: str, term: Column) -> Column:
        at = F.transform(c, lambda x, i: F.when(x == term, i + 1))
        return F.filter(at, lambda p: p.isNotNull()).alias(c)

    terms = F.array_distinct(F.concat(*COLUMNS))
    return rows.select("id", "paper_id", "page", "size", F.explode(F.transform(terms, lambda t: F.struct(t.alias("term"), *(places(c, t) for c in COLUMNS)))).alias("p")).select("p.term", "id", "paper_id", "page", "size", *(f"p.{c}" for c in COLUMNS))


def _write(spark: SparkSession, postings: DataFrame, passages: DataFrame, folder: str) -> Index:
    passages.write.parquet(f"{folder}/passages")
    passages = spark.read.parquet(f"{folder}/passages")
    passages.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("tokens")).write.parquet(f"{folder}/stats")
    # A passage has fewer terms than tokens. Ranges of (term, passage) divide a term that most passages have.
    tokens = spark.read.parquet(f"{folder}/stats").first()["tokens"]
    files = max(1, -(-tokens // FILE_ROWS))
    postings.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/postings")
    return Index(spark, folder)


def build_index(corpus: Corpus, folder: str) -> Index:
    rows = tokenised(corpus)
    return _write(corpus.spark, _postings(rows), rows.select("id", "paper_id", "page", "size"), folder)


def replace_papers(index: Index, corpus: Corpus, papers: DataFrame, folder: str) -> Index:
    """The index in a new folder with the passages of ``papers`` (``id``) as ``corpus`` has them now; gone papers vanish.

    Doing it twice changes nothing. After a merge, both papers' ids are given.
    """
    rows = tokenised(corpus, papers)
    gone = papers.select(F.col("id").alias("paper_id"))
    postings = index.postings.join(gone, "paper_id", "left_anti").unionByName(_postings(rows))
    passages = index.passages.join(gone, "paper_id", "left_anti").unionByName(rows.select("id", "paper_id", "page", "size"))
    return _write(index.spark, postings, passages, folder)


def _union(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


class _Plan:
    """A query's terms as columns of one row for each passage."""

    def __init__(self, node):
        self.terms: dict[tuple[str, bool], int] = {}
        self.everywhere = False
        self._walk(node)

    def _walk(self, node) -> None:
        if isinstance(node, Phrase):
            self.everywhere |= not node.terms
            for k, t in enumerate(node.terms):
                self.terms.setdefault((t, node.prefix and k == len(node.terms) - 1), len(self.terms))
        elif isinstance(node, Near):
            for p in node.phrases:
                self._walk(p)
        else:
            self._walk(node.left)
            self._walk(node.right)

    def wanted(self) -> Column:
        """Which postings the query reads."""
        out = F.lit(False)
        for (t, prefix), _ in self.terms.items():
            out = out | (((F.col("term") >= t) & (F.col("term") < t + "\U0010ffff")) if prefix else F.col("term") == t)
        return out

    def gathered(self, index: Index) -> DataFrame:
        """A row for each passage that has any of the terms (all, if some phrase is empty): size and positions."""
        aggs = []
        for (t, prefix), k in self.terms.items():
            is_it = F.col("term").startswith(t) if prefix else F.col("term") == t
            for c in COLUMNS:
                aggs.append(_union(F.collect_list(F.when(is_it, F.col(c)))).alias(f"p{k}_{c}"))
        facts = [F.first(c).alias(c) for c in ("paper_id", "page", "size")]
        if not self.everywhere:
            return index.postings.where(self.wanted()).groupBy("id").agg(*facts, *aggs)
        rows = index.passages.join(index.postings.where(self.wanted()).select("id", "term", *COLUMNS), "id", "left")
        return rows.groupBy("id").agg(*facts, *aggs)

    def places(self, t: str, prefix: bool, c: str) -> Column:
        return F.col(f"p{self.terms[t, prefix]}_{c}")

    def starts(self, p: Phrase, c: str) -> Column:
        """The positions at which a phrase starts in a column."""
        last = len(p.terms) - 1
        lists = [self.places(t, p.prefix and k == last, c) for k, t in enumerate(p.terms)]

        def fits(i: Column) -> Column:
            out = i == 1 if p.initial else F.lit(True)
            for k, at in enumerate(lists[1:], 1):
                out = out & F.array_contains(at, i + k)
            return out

        return F.filter(lists[0], fits) if len(lists) > 1 or p.initial else lists[0]

    def frequency(self, p: Phrase) -> Column:
        return sum((F.lit(COLUMNS[c]) * F.size(self.starts(p, c)) for c in p.columns), F.lit(0.0))

    def matches(self, node) -> Column:
        if isinstance(node, Phrase):
            if not node.terms:
                return F.lit(True)
            return functools.reduce(lambda a, b: a | b, (F.size(self.starts(node, c)) > 0 for c in node.columns), F.lit(False))
        if isinstance(node, Near):
            parts = [p for p in node.phrases if p.terms]
            if len(parts) < 2:
                return self.matches(parts[0]) if parts else F.lit(True)
            return functools.reduce(lambda a, b: a | b, (self._close(parts, node.distance, c) for c in parts[0].columns), F.lit(False))
        left, right = self.matches(node.left), self.matches(node.right)
        return left & ~right if node.op == "not" else left & right if node.op == "and" else left | right

    def _close(self, parts: list[Phrase], distance: int, c: str) -> Column:
        """Whether the first phrase starts somewhere that all others are within ``distance`` words of."""
        first, others = parts[0], parts[1:]

        def near(v: Column) -> Column:
            out = F.lit(True)
            for p in others:
                out = out & F.exists(self.starts(p, c), functools.partial(self._gap, v, len(first.terms), len(p.terms), distance))
            return out

        return F.exists(self.starts(first, c), near)

    @staticmethod
    def _gap(v: Column, n: int, m: int, distance: int, w: Column) -> Column:
        return F.greatest(w - v - n, v - w - m) <= distance


def ranked_passages(index: Index, query: str) -> DataFrame:
    """``id``, ``paper_id``, ``page`` and ``score`` (more negative is better) of all matching passages."""
    node = parse(query)
    if node is None:
        return index.passages.limit(0).select("id", "paper_id", "page", F.lit(0.0).alias("score"))
    plan, phrases = _Plan(node), scored(node)
    rows = plan.gathered(index).select("id", "paper_id", "page", F.col("size").cast("double").alias("size"), plan.matches(node).alias("hit"), *(plan.frequency(p).alias(f"f{k}") for k, p in enumerate(phrases)))
    if not phrases:
        return rows.where("hit").select("id", "paper_id", "page", F.lit(0.0).alias("score"))
    # One row of counts, however many passages there are.
    counts = rows.agg(*(F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(phrases))))
    n, mean = float(index.n), index.tokens / max(1, index.n)
    total = F.lit(0.0)
    for k in range(len(phrases)):
        idf = F.log((n - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = F.col(f"f{k}")
        total = total + F.when(idf <= 0, 0.000001).otherwise(idf) * f * (K1 + 1) / (f + K1 * ((1 - B) + B * F.col("size") / mean))
    return rows.where("hit").crossJoin(F.broadcast(counts)).select("id", "paper_id", "page", (-F.round(total, 9)).alias("score"))


def search(index: Index, query: str, limit: int = LIMIT, per_paper: int = PER_PAPER) -> DataFrame:
    """The best papers by their best passage, with up to ``per_paper`` passages each."""
    within = Window.partitionBy("paper_id").orderBy("score", "id")
    best = ranked_passages(index, query).withColumn("match_rank", F.row_number().over(within)).where(F.col("match_rank") <= per_paper)
    papers = best.groupBy("paper_id").agg(F.min(F.struct("score", "id")).alias("first")).orderBy("first").limit(limit)  # a top-k report
    papers = papers.withColumn("paper_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first"))).select(F.col("paper_id").alias("of"), "paper_rank")
    rows = best.join(F.broadcast(papers), F.col("paper_id") == F.col("of"))
    return rows.select(F.col("paper_rank").cast("long").alias("paper_rank"), "paper_id", F.col("match_rank").cast("long").alias("match_rank"), F.col("id").alias("passage_id"), "page", "score")


def search_rows(index: Index, corpus: Corpus, query: str) -> DataFrame:
    found = search(index, query).where("match_rank = 1").select("paper_rank", "paper_id", "score")
    about = corpus.paper.select(F.col("id").alias("paper_id"), F.when(F.col("title") == "", "(untitled)").otherwise(F.col("title")).alias("title"), "year", "journal")
    return found.join(about, "paper_id").select("paper_rank", "paper_id", "title", "year", "journal", "score")


_BUILT: dict[tuple[str, str], str] = {}


def sample_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the sample corpus, built once for a session; in the shared folder, or a temporary one on one machine."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lexmill-index-")
        folder = f"{base}/index-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        build_index(sample_corpus(spark, sf_dir), folder)
        _BUILT[key] = folder
    return Index(spark, _BUILT[key])


SEARCHES = {
    "search_bm25_and": "thing AND that", "search_common_term_clamp": "in the", "search_phrase": '"of the"', "search_plus_phrase": "of + the", "search_prefix": "ention*", "search_initial": "^the",
    "search_or_not": "(thing OR erst) NOT tion", "search_column_filter": "title:the", "search_column_list": "{title authors}: an", "search_near": "NEAR(of that, 3)", "search_fallback_phrase": "of-the", "search_blank": "  ",
}


def _searched(query: str):
    return lambda spark, sf_dir: search(sample_index(spark, sf_dir), query)


QUERIES = {n: _searched(q) for n, q in SEARCHES.items()} | {
    "search_rows": lambda spark, sf_dir: search_rows(sample_index(spark, sf_dir), sample_corpus(spark, sf_dir), "thing AND that"),
    "search_ranked_passages": lambda spark, sf_dir: ranked_passages(sample_index(spark, sf_dir), "erst OR thing"),
    "index_postings": lambda spark, sf_dir: sample_index(spark, sf_dir).postings.where(F.size("text") > 0).select("term", F.col("id").alias("passage_id"), F.size("text").cast("long").alias("tf"), F.array_join(F.transform("text", lambda x: x.cast("string")), ",").alias("positions")),
    "index_postings_stats": lambda spark, sf_dir: sample_index(spark, sf_dir).postings.where(F.size("text") > 0).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("text")).cast("long").alias("cf")),
}

#: The same searches by scanning, for DuckDB.
ORACLES = {n: scan.search(DUCK, q) for n, q in SEARCHES.items()} | {
    "search_rows": scan.search_rows(DUCK, "thing AND that"), "search_ranked_passages": scan.ranked_passages(DUCK, "erst OR thing"),
    "index_postings": scan.postings(DUCK), "index_postings_stats": f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from ({scan.postings(DUCK)}) p group by term",
}
