"""Quotation linking in conversations, in DataFrame functions only.

A line that starts with ``>`` marks is a quotation, its level the number of marks. Consecutive lines of one
level make a passage. Passages are normalised (lower case, runs of anything but letters and digits become
one space), hashed, and joined to the messages they come from: the latest earlier turn of the same
conversation whose own text, as a whole or one of its lines, has the same hash; the whole passage counts
before its single lines. A message's outermost passages are looked at first, then deeper ones. The link is
an as-of join over (conversation, hash), so neither a common line nor a long conversation makes pairs.

Messages are then put in reply order. A message with no link, or with one to the turn right before it, goes on
from there; one that quotes an older turn starts a branch at that turn. A branch is read to its end before those
that leave it, the last to leave first. ``path`` spells this out: sorting a conversation's rows by it gives reply
order. It grows with the nesting of branches only, by some ten characters for each level. No conversation is gathered; rows stay rows.

Defined results: a null text is an empty message, null role "user"; a message's own text is what is left
without quotations, attribution lines before them and blank lines around. Rows that repeat conversation,
turn, role and text count once; different texts of one turn are ordered by hash. Turns are any whole numbers, with
or without gaps, below zero too. A null conversation or turn links nothing and keeps its row, once for each
distinct text. Other columns are ignored; an empty table gives an empty table. In chat markup a ``<|`` of a message
is written ``<\\|`` (and ``<\\|`` as ``<\\\\|`` and so on), so a message can't close its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import latest_before
from .common import materialize

MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)(?m)^[^\n>]*\b(wrote|schrieb|escribi\x{00f3}|a \x{00e9}crit)[ \t]*:[ \t]*\n(?=[ \t]*>)"
#: Turns of a (conversation, hash) timeline that one task sorts.
SPAN = 4096
MAX_DEPTH_ROUNDS = 40


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """A message without its quotations."""
    t = F.regexp_replace(text, ATTRIBUTION, "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*>[^\n]*(\n|\z)", "")
    return F.regexp_replace(t, r"\A\s+|\s+\z", "")


def messages(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``raw``, ``key`` (of role and text) and ``quotes`` of each distinct message."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("raw"))
    key = F.substring(F.md5(F.concat("role", F.lit("\n"), "raw")), 1, 16)
    return rows.distinct().select("*", key.alias("key"), F.col("raw").rlike(r"(?m)^[ \t]*>").alias("quotes"))


def said_text() -> Column:
    """A message's own text, from ``raw`` and ``quotes``."""
    return F.when(F.col("quotes"), own_text(F.col("raw"))).otherwise(F.regexp_replace("raw", r"\A\s+|\s+\z", ""))


def passages(rows: DataFrame) -> DataFrame:
    """The quoted passages of :func:`messages`: ``conv_id``, ``turn``, ``key``, ``place``, ``level``, ``passage``, ``line_texts``."""
    lines = rows.where("quotes").select("conv_id", "turn", "key", F.posexplode(F.split("raw", "\n")).alias("place", "line"))
    mark = F.regexp_extract("line", MARKS, 1)
    lines = lines.select("conv_id", "turn", "key", "place", (F.length(mark) - F.length(F.translate(mark, ">", ""))).alias("level"), F.regexp_replace("line", MARKS + r"[ \t]?", "").alias("line"))
    message = Window.partitionBy("conv_id", "turn", "key").orderBy("place")
    change = F.coalesce((F.col("level") != F.lag("level").over(message)).cast("int"), F.lit(1))
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(message)).where("level > 0")
    made = runs.groupBy("conv_id", "turn", "key", "run", "level").agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    made = made.select("conv_id", "turn", "key", "place", "level", F.col("l.line").alias("line_texts"))
    return made.withColumn("passage", normalise(F.array_join("line_texts", " ")))


def links(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``key`` and ``reply_to`` (a turn) of the messages that quote an earlier one."""
    quoted = passages(rows)
    whole = quoted.select("conv_id", "turn", "key", "place", "level", F.lit(0).alias("part"), F.col("passage").alias("p"))
    single = quoted.where(F.size("line_texts") > 1).select("conv_id", "turn", "key", "place", "level", F.posexplode("line_texts").alias("part", "p"))
    probes = whole.unionByName(single.select("conv_id", "turn", "key", "place", "level", (F.col("part") + 1).alias("part"), normalise(F.col("p")).alias("p"))).where("p != ''")
    probes = probes.select("conv_id", "turn", "key", "place", "level", "part", F.xxhash64("p").alias("hash"))
    probes = materialize(probes)
    said = rows.select("conv_id", "turn", said_text().alias("text"))
    text = F.array_distinct(F.filter(F.concat(F.array(normalise(F.col("text"))), F.transform(F.split("text", "\n"), normalise)), lambda x: x != ""))
    said = said.select("conv_id", "turn", F.explode(F.transform(text, lambda p: F.xxhash64(p))).alias("hash"))
    # Only what some message of the conversation quotes takes part in the as-of join.
    said = said.join(probes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    both = probes.withColumn("said", F.lit(False)).unionByName(said.withColumn("said", F.lit(True)), allowMissingColumns=True)
    found = latest_before(both, ["conv_id", "hash"], "turn", F.col("said"), F.col("turn"), SPAN).where("not said and latest is not null")
    rank = F.struct((F.col("part") > 0).alias("single"), F.col("level"), F.col("place"), F.col("part"))
    return found.groupBy("conv_id", "turn", "key").agg(F.min_by("latest", rank).alias("reply_to"))


def _sortable(x: Column) -> Column:
    """A long as text that sorts like the number: a letter for the number of hex digits, and these; below zero both turned round."""
    up, down = F.hex(x), F.hex(-1 - x)
    below = F.concat(F.char(F.lit(91) - F.length(down)), F.translate(down, "0123456789ABCDEF", "FEDCBA9876543210"))
    return F.when(x < 0, below).otherwise(F.concat(F.char(F.lit(96) + F.length(up)), up))


def reply_order(df: DataFrame) -> DataFrame:
    """Every message once: ``conv_id``, ``turn``, ``role``, ``text``, ``reply_to``, ``branch``, ``depth`` and ``path``.

    ``branch`` is the turn that the message's branch starts with (null: the main line), ``depth`` the number of
    branches around it.
    """
    rows = materialize(messages(df))
    linked = materialize(links(rows))
    # A turn with several texts starts a branch if any of them does.
    heads = linked.where("conv_id is not null").groupBy("conv_id", F.col("turn").alias("head")).agg(F.max("reply_to").alias("from"))
    spoken = rows.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("head")).distinct()
    events = heads.withColumn("_is", F.lit(False)).unionByName(spoken.withColumn("_is", F.lit(True)), allowMissingColumns=True)
    events = latest_before(events, ["conv_id"], "head", F.col("_is"), F.col("head"), SPAN)
    heads = materialize(events.where("not _is and from < latest").select("conv_id", "head", "from"))
    turns = rows.select("conv_id", "turn", "key")

    def branch_of(points: DataFrame, at: str) -> DataFrame:
        """``points`` with the head of the branch that turn ``at`` is in: the last head at or before it, else null."""
        events = points.withColumn("_at", F.col(at) + 1).withColumn("_head", F.lit(False))
        starts = heads.select("conv_id", F.col("head").alias("_at"), F.lit(True).alias("_head"))
        got = latest_before(events.unionByName(starts, allowMissingColumns=True), ["conv_id"], "_at", F.col("_head"), F.col("_at"), SPAN)
        return got.where("not _head").select(*points.columns, F.col("latest").alias("branch"))

    # Each branch's parent branch, then paths by doubling: a round joins what is known so far.
    tree = branch_of(heads.select("conv_id", "head", "from"), "from")
    step = F.concat(F.lit("~"), _sortable(-1 - F.col("from")), _sortable(F.col("head")))
    paths = materialize(tree.select("conv_id", "head", F.col("branch").alias("up"), step.alias("path"), F.lit(1).alias("depth")))
    for _ in range(MAX_DEPTH_ROUNDS):
        if paths.where("up is not null").isEmpty():
            break
        upper = paths.select("conv_id", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("path").alias("p2"), F.col("depth").alias("d2"))
        paths = paths.join(upper, ["conv_id", "up"], "left")
        paths = materialize(paths.select("conv_id", "head", F.col("up2").alias("up"), F.concat(F.coalesce("p2", F.lit("")), "path").alias("path"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
    placed = branch_of(turns, "turn")
    # A conversation's main line, which may hold most of its messages, has no path to look up.
    inside = placed.where("branch is not null").join(paths.select("conv_id", F.col("head").alias("branch"), "path", "depth"), ["conv_id", "branch"])
    found = inside.join(linked, ["conv_id", "turn", "key"], "full").select("conv_id", "turn", "key", "reply_to", "branch", "path", "depth")
    named = found.select(*(F.col(c).alias(f"of_{c}") for c in found.columns))
    # Texts move once, at the end.
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & F.col("turn").eqNullSafe(F.col("of_turn")) & (F.col("key") == F.col("of_key"))
    place = F.concat(F.coalesce("of_path", F.lit("")), F.lit("-"), F.when(F.col("turn").isNull(), F.lit("z")).otherwise(_sortable(F.col("turn"))), "key")
    return rows.join(named, same, "left").select(
        "conv_id", "turn", "role", said_text().alias("text"), F.col("of_reply_to").alias("reply_to"), F.col("of_branch").alias("branch"),
        F.coalesce("of_depth", F.lit(0)).alias("depth"), place.alias("path"),
    )


def chat_format(ordered: DataFrame) -> DataFrame:
    """The rows of :func:`reply_order` with ``chat``, the message in chat markup."""
    def quoted(c: str) -> Column:
        return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")

    return ordered.withColumn("chat", F.concat(F.lit("<|"), quoted("role"), F.lit("|>\n"), quoted("text"), F.lit("\n<|end|>")))


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Every row of a table of conversations, with quotations made of earlier turns by arithmetic on conv_id and turn.

    By (conv_id + turn) mod 6 a text starts with: 0 nothing; 1 the whole text of the turn before; 2 an attribution
    and the first line of the turn two before; 3 the first line of the turn three before at level two, and that of the
    turn two before at level one; 4 the first line of the turn two before in lower case, with wider spaces and
    another mark at its end; 5 a line that nobody said. A turn that isn't there or has no text isn't quoted. Of several texts of
    one turn the smallest is quoted (of first lines, the smallest one).
    """
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))

    def kind(turn: Column) -> Column:
        return F.pmod(F.col("conv_id") + turn, F.lit(6))

    # What each text gives to later turns, if one of them asks for it.
    given = [(1, F.col("text"), [1]), (2, first, [2, 3, 4]), (3, first, [3])]
    parts = [F.when(kind(F.col("turn") + back).isin(kinds), F.struct((F.col("turn") + back).alias("turn"), F.lit(back).alias("back"), part.alias("part"))) for back, part, kinds in given]
    pieces = conversations.where("conv_id is not null and turn is not null and text is not null").select("conv_id", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    pieces = pieces.groupBy(F.col("conv_id").alias("of_conv"), F.col("p.turn").alias("of_turn")).agg(*(F.min(F.when(F.col("p.back") == back, F.col("p.part"))).alias(f"s{back}") for back, _, _ in given))
    out = conversations.select("conv_id", "turn", "role", "text").join(pieces, (F.col("conv_id") == F.col("of_conv")) & (F.col("turn") == F.col("of_turn")), "left")
    now = kind(F.col("turn"))
    quote = (
        F.when(now == 1, F.concat(F.lit("> "), F.replace(F.col("s1"), F.lit("\n"), F.lit("\n> ")), F.lit("\n")))
        .when(now == 2, F.concat(F.lit("They wrote:\n> "), F.col("s2"), F.lit("\n")))
        .when(now == 3, F.concat(F.lit("> > "), F.col("s3"), F.lit("\n> "), F.col("s2"), F.lit("\n")))
        .when(now == 4, F.concat(F.lit(">"), F.replace(F.lower("s2"), F.lit(" "), F.lit("  ")), F.lit(" !!\n")))
        .when(now == 5, F.lit("> nobody said this here\n"))
    )
    return out.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull(), F.concat(F.coalesce(quote, F.lit("")), "text")).alias("text"))
