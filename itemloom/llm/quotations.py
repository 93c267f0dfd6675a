"""Conversations without quotes: quoted lines are linked to the messages they come from.

DataFrame functions only; there is no Python code on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.writer import stage

#: Turns of a conversation that are searched in one piece; a longer conversation is many pieces.
TURNS = 1000

_MARKS = r"^(?:\s{0,3}>)+"


def _lines(text: str) -> Column:
    """array<struct<level, line>>: nested quote level of each line, and the line without its marks."""
    marks = lambda s: F.regexp_extract(s, _MARKS, 0)
    return F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda s: F.struct(
            (F.length(marks(s)) - F.length(F.replace(marks(s), F.lit(">")))).alias("level"), F.regexp_replace(s, _MARKS, "").alias("line")
        ),
    )


def _key(line: Column) -> Column:
    """Hash of a line in lower case with single blanks; NULL for an empty one."""
    plain = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))


def last_before(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, turn, last) of the rows with ``asks``: the largest ``value`` of an earlier turn.

    ``events`` has the keys, turn, asks, and the value (NULL: none). A window
    over a whole key would be one task for a very long conversation, so turns
    are taken in pieces: a window inside each piece, and one over one row per
    piece for what lies before it.
    """
    events = events.withColumn("piece", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy(*keys, "piece").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = events.groupBy(*keys, "piece").agg(F.max(value).alias("most")).select(*keys, "piece", F.max("most").over(earlier).alias("before"))
    near = events.withColumn("near", F.max(value).over(inside)).where("asks")
    found = near.join(pieces, [*keys, "piece"])
    return found.select(*keys, "turn", F.coalesce("near", "before").alias("last"))


def _plain(c: Column) -> Column:
    """Text in which nothing reads as markup: ``&`` and ``<|`` are written as entities."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Messages without quoted lines, linked to the message that they reply to.

    ``messages`` has conv_id, turn, role and text; other columns are ignored and
    rows without conv_id or turn are left out. A line that begins with ``>`` is
    quoted, at the level of its marks. A quoted line belongs to the latest
    earlier message of the conversation that has the same line unquoted, up to
    case and blanks. A message replies to the one that most of its quoted lines
    belong to (ties: the latest), or without any to the turn before it; the
    first replies to none. Rows that repeat a turn are told apart by nothing but
    their text: they share links.

    A message that quotes starts a branch, and others go on with the branch of
    the turn before. Returns conv_id, turn, role, text (unquoted lines), reply_to,
    branch (turn that began it), thread (first branch above it), depth (branches
    above it), n_quoted, n_linked and chat (the message in chat markup,
    ``&`` and ``<|`` of role and text escaped). Ordered
    by conv_id, thread, branch and turn the rows are the reply-ordered
    conversations; they are not put together here, as one may be of any length.
    """
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long"), "role", "text")
    quoting = rows.where(F.col("text").rlike(r"(?m)^\s{0,3}>"))
    quoted = quoting.select("conv_id", "turn", F.explode(_lines("text")).alias("l")).where("l.level > 0")
    asked = stage(quoted.select("conv_id", "turn", _key(F.col("l.line")).alias("key")).where("key is not null"), "quoted-lines")
    own = rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = own.select("conv_id", "turn", F.explode(_lines("text")).alias("l")).where("l.level = 0")
    lines = lines.select("conv_id", "turn", _key(F.col("l.line")).alias("key")).where("key is not null")
    events = lines.select("*", F.lit(False).alias("asks"), F.col("turn").alias("said")).unionByName(
        asked.select("*", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("said"))
    )
    origins = last_before(events, ["conv_id", "key"], "said").where("last is not null")
    votes = origins.groupBy("conv_id", "turn", "last").agg(F.count(F.lit(1)).alias("n"))
    links = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "last"))["last"].alias("quotes"), F.sum("n").alias("n_linked"))
    links = stage(links, "links")

    turns = rows.select("conv_id", "turn").distinct().join(links, ["conv_id", "turn"], "left")
    before = last_before(turns.select("conv_id", "turn", F.lit(True).alias("asks"), F.col("turn").alias("said")), ["conv_id"], "said")
    turns = stage(turns.join(before.withColumnRenamed("last", "previous"), ["conv_id", "turn"]), "turns")
    heads = turns.where("quotes is not null or previous is null")
    inherited = last_before(
        turns.select("conv_id", "turn", F.lit(True).alias("asks"), F.when(F.col("quotes").isNotNull() | F.col("previous").isNull(), F.col("turn")).alias("head")),
        ["conv_id"],
        "head",
    )
    branch = F.when(F.col("quotes").isNotNull() | F.col("previous").isNull(), F.col("turn")).otherwise(F.col("last"))
    placed = stage(turns.join(inherited, ["conv_id", "turn"]).withColumn("branch", branch).drop("last"), "branches")
    above = placed.select("conv_id", F.col("turn").alias("quotes"), F.col("branch").alias("up"))
    tree = stage(
        heads.select("conv_id", F.col("turn").alias("branch"), "quotes")
        .join(above, ["conv_id", "quotes"], "left")
        .select("conv_id", "branch", "up", F.coalesce("up", "branch").alias("thread"), F.col("up").isNotNull().cast("int").alias("depth")),
        "tree",
    )
    while not tree.where("up is not null").isEmpty():  # each turn doubles the branches looked up through
        parent = tree.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("up2"), F.col("thread").alias("thread2"), F.col("depth").alias("depth2"))
        tree = stage(
            tree.join(parent, ["conv_id", "up"], "left").select(
                "conv_id",
                "branch",
                F.col("up2").alias("up"),
                F.coalesce("thread2", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            ),
            "tree",
        )
    named = placed.join(tree.drop("up"), ["conv_id", "branch"])
    parts = _lines("text")
    unquoted = F.array_join(F.transform(F.filter(parts, lambda s: s["level"] == 0), lambda s: s["line"]), "\n")
    text = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.trim(F.regexp_replace(unquoted, r"\n{3,}", "\n\n")))
    formed = rows.select("conv_id", "turn", "role", text.alias("text"), F.size(F.filter(parts, lambda s: s["level"] > 0)).alias("n_quoted"))
    chat = F.concat(F.lit("<|"), _plain(F.coalesce("role", F.lit("user"))), F.lit("|>\n"), _plain(F.col("text")), F.lit("\n"))
    return formed.join(named, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", "text", F.coalesce("quotes", "previous").alias("reply_to"), "branch", "thread", "depth",
        "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), chat.alias("chat"),
    )
