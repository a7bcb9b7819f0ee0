"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a whole text and votes 1 (good), -1 (bad) or 0 (abstains). Rules don't
filter by themselves: expectation-maximisation over the corpus estimates, without any labels, how often each
rule votes good, bad or not at all on good and on bad texts, and the share of both; a text is kept by its
posterior probability of being good.

Bad texts are of several kinds, and a rule that catches one kind has nothing to say on another: given only
that a text is bad, the votes aren't independent. So the bad class is a mixture of kinds of junk, at first
one for each rule; votes are taken as independent given the kind, and a text's posterior of being good is one
minus the sum of those of the kinds. Which votes go with which kind, and how common a kind is, comes from the data:
a kind that nothing supports ends with a share near zero, and its rule then decides nothing.

Texts with equal votes are equal to the model, so one aggregation makes a table of vote patterns with every text
counted in it, at most 3 ** rules rows whatever the corpus; the rounds are arithmetic on that table. They go on
until the log-posterior of the model (each vote counts once more than it was cast, so that no rate is zero)
gains less than ``TOLERANCE`` for each text; it never falls, and it is bounded.

Repeated three-word windows are found by sorting a text's window hashes (64 bits, within one text), so a
long text costs n log n and no group leaves its row.

Defined results: a null or empty text has no words and fails the base rules; rows with a null id are scored
like others; repeated rows stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word's last character that is neither a letter or digit nor one that prose ends words with.
ENDING = r"""[^\p{L}\p{N}\p{M} \t-\r.,;:!?'")\]}\u2019\u201d\u00bb\u2026-](?![^ \t-\r])"""
TOLERANCE = 1e-6
KEEP = 0.5


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of every row, and those that only the rules read."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    rows = rows.withColumn("lines", lines)
    # The window that starts at each word but the last two.
    window = F.transform(F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("windows", window)
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform(
        "sorted",
        lambda e, i: F.when(e["h"].eqNullSafe(F.get("sorted", i - 1)["h"]) | e["h"].eqNullSafe(F.get("sorted", i + 1)["h"]), F.sequence(e["i"], e["i"] + 2)).otherwise(F.array().cast("array<int>")),
    )
    n_repeat = F.when(F.col("sorted").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(twice))))
    return rows.select(
        "doc_id",
        "n_words",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(ENDING)).cast("long").alias("n_endings"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_stutters"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, over the columns of :func:`counts`. Shares are compared without division."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _vote(F.col("n_symbols") * 20 <= n, F.col("n_symbols") * 10 > n),
        "endings": _vote(F.col("n_endings") * 10 <= n, F.col("n_endings") * 10 > n * 3),
        "capitals": _vote(F.col("n_upper") * 5 <= chars, F.col("n_upper") * 2 > chars),
        "exclamations": _vote(F.col("n_exclamations") * 50 <= n, F.col("n_exclamations") * 10 > n),
        "stutter": _vote(F.col("n_stutters") * 20 <= n, F.col("n_stutters") * 10 > n),
        "windows": _vote(F.col("n_repeat_words") * 5 <= n, F.col("n_repeat_words") * 5 > n * 2),
        "lines": _vote(F.col("n_dup_lines") * 3 <= F.col("n_lines"), F.col("n_dup_lines") * 2 > F.col("n_lines")),
        "word_length": _vote((chars >= n * 3) & (chars <= n * 10), (chars < n * 2) | (chars > n * 20)),
        "digits": _vote(F.col("n_digits") * 10 <= chars, F.col("n_digits") * 4 > chars),
    }


@dataclass
class VoteModel:
    """``share[k]`` of the texts are of kind k (0: good); ``rate[k][3 * r + v]`` of them get vote v of rule r.

    v is 0 for good, 1 for an abstention, 2 for bad.
    """

    names: list[str]
    share: list[float]
    rate: list[list[float]]

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """How often each rule votes good on good texts, and bad on bad ones (of all of them, abstentions included)."""
        bad = sum(self.share[1:])
        return {name: (self.rate[0][3 * r], sum(s * x[3 * r + 2] for s, x in zip(self.share[1:], self.rate[1:], strict=True)) / bad) for r, name in enumerate(self.names)}


def _cells(names: list[str]) -> Column:
    """A row's votes as numbers 3 * rule + vote."""
    return F.array(*(F.lit(3 * r + 1) - F.col(f"vote_{name}") for r, name in enumerate(names)))


def _joint(model: VoteModel) -> Column:
    """Log-probability of a row's ``cells`` together with each kind. The model is one constant array: the code stays the same."""
    width = 3 * len(model.names)
    flat = [math.log(x) for rate in model.rate for x in rate] + [math.log(s) for s in model.share]
    logs = F.array(*map(F.lit, flat))
    kinds = F.sequence(F.lit(0), F.lit(len(model.share) - 1))
    return F.transform(kinds, lambda k: F.aggregate("cells", F.get(logs, k + len(model.rate) * width), lambda s, c: s + F.get(logs, k * width + c)))


def _softmax(joint: str) -> Column:
    raised = F.transform(joint, lambda x: F.exp(x - F.array_max(joint)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def fit_patterns(names: list[str], patterns: list[tuple[list[int], int]], tolerance: float = TOLERANCE) -> VoteModel:
    """The model of vote patterns (a text's cells, number of texts), by expectation-maximisation until it has converged.

    At first texts without a vote for bad are good; others are of the kinds of the rules that vote so, in equal parts.
    """
    kinds, width = range(len(names) + 1), 3 * len(names)
    total = sum(n for _, n in patterns)
    if not total:
        return VoteModel(names, [1 / len(kinds)] * len(kinds), [[1 / 3] * width for _ in kinds])
    split = []
    for cells, _ in patterns:
        bad = [c // 3 + 1 for c in cells if c % 3 == 2]
        split.append([(k in bad) / len(bad) if bad else float(k == 0) for k in kinds])
    before = None
    while True:
        weight = [0.0] * len(kinds)
        rate = [[1.0] * width for _ in kinds]  # each vote counts once more than it was cast, so that no rate is 0
        for (cells, n), p in zip(patterns, split, strict=True):
            for k in kinds:
                weight[k] += n * p[k]
                for c in cells:
                    rate[k][c] += n * p[k]
        rate = [[x / (w + 3) for x in row] for row, w in zip(rate, weight, strict=True)]
        model = VoteModel(names, [(w + 1) / (total + len(kinds)) for w in weight], rate)
        log_rate, log_share = [[math.log(x) for x in row] for row in rate], [math.log(x) for x in model.share]
        fit, split = sum(log_share) + sum(map(sum, log_rate)), []
        for cells, n in patterns:
            joint = [log_share[k] + sum(log_rate[k][c] for c in cells) for k in kinds]
            top = max(joint)
            raised = [math.exp(x - top) for x in joint]
            split.append([x / sum(raised) for x in raised])
            fit += n * (top + math.log(sum(raised)))
        if before is not None and fit - before < tolerance * total:
            return model
        before = fit


def estimate(votes: DataFrame, tolerance: float = TOLERANCE) -> VoteModel:
    """The model of the votes in ``vote_*``."""
    names = [c[5:] for c in votes.columns if c.startswith("vote_")]
    patterns = votes.select(_cells(names).alias("cells")).groupBy("cells").agg(F.count("*").alias("n"))
    return fit_patterns(names, sorted((list(r["cells"]), r["n"]) for r in patterns.collect()), tolerance)  # at most 3 ** rules rows


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """Counts, votes, ``base_failed``, ``posterior`` (of being good) and ``kept`` of every row."""
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    votes = materialize(counts(df, id_col, text_col).select("*", *(c.alias(f"vote_{k}") for k, c in rules().items())))
    model = estimate(votes)
    joint = votes.withColumn("cells", _cells(model.names)).withColumn("joint", _joint(model))
    out = joint.withColumn("base_failed", base).withColumn("posterior", F.get(_softmax("joint"), F.lit(0))).drop("cells", "joint")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
