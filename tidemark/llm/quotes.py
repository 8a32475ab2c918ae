"""Quotation linking in conversations (DataFrame functions only).

A line's quote level is the number of ``>`` that lead it. The lines of one level
that follow each other form passages, divided at blank lines. Passages and their
lines are normalised (case, white space) and hashed; the same is done for what
messages say themselves. A quoted hash belongs to the earliest message that says
it: earliest in the conversation if that is before the quoting message, else
earliest anywhere, for which it must have ``LEAST_CHARS`` characters. A message replies to the message from which most characters
of its outermost matched quotes come. Replies follow their parents, and quotes
and the lines that announce them are removed.

Hashes are aggregated to one original each before they are joined, so a line that
a third of all messages say costs one row.

Defined cases: a null text says and quotes nothing; a quote without an original is
removed and links nothing; a message is never its own parent, and parents are
strictly earlier by (conversation, turn, row), so there are no cycles; null
conversation ids form one conversation, null turns come first; of repeated rows each is a
message; an empty table gives an empty result; other columns stay untouched.
Rows are numbered once and stored with their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import dropped, numbered, row_of, saved

#: Leading quote marks: ">", "> >", ">>" and so on.
MARKS = r"^(?:[ \t]*>)+"
#: A line before a quote that names its author.
ANNOUNCES = r"(?i)(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
#: Shorter passages are linked in their own conversation only.
LEAST_CHARS = 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def body(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """The text without quoted lines and without the lines that announce them."""
    lines = _lines(text)

    def own(line: Column, i: Column) -> Column:
        following = F.coalesce(F.get(lines, i + 1), F.lit(""))
        announces = line.rlike(ANNOUNCES) & following.rlike(MARKS)
        return ~line.rlike(MARKS) & ~announces

    return F.regexp_replace(F.array_join(F.filter(lines, own), "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """``row, conv, turn, level, hash, chars``: normalised passages and lines, level 0 for own words."""
    lines = messages.select("row", "conv", "turn", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.select(
        "row", "conv", "turn", "at", level(F.col("line")).alias("level"), normalised(body(F.col("line"))).alias("said")
    )
    # One message per window: a message is one row of the input.
    per = Window.partitionBy("row").orderBy("at")
    before = F.lag(F.struct("level", (F.col("said") == "").alias("blank"))).over(per)
    begins = before.isNull() | (before["level"] != F.col("level")) | before["blank"]
    lines = lines.withColumn("new", begins.cast("int")).withColumn("passage", F.sum("new").over(per))
    lines = lines.where("said <> ''")
    whole = lines.groupBy("row", "conv", "turn", "level", "passage").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), " ").alias("said")
    )
    both = whole.select("row", "conv", "turn", "level", "said").unionByName(
        lines.select("row", "conv", "turn", "level", "said")
    )
    return (
        both.select("row", "conv", "turn", "level", F.md5("said").alias("hash"), F.length("said").alias("chars"))
        .distinct()
    )


def parents(messages: DataFrame) -> DataFrame:
    """``row, parent`` (a row), ``linked`` (quoted passages with an original) of quoting messages."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + MARKS))
    quoted = saved(passages(quoting).where("level > 0"), "quoted")
    own = passages(messages).where("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    own = saved(own, "own")
    place = F.struct("conv", "turn", "row")
    here = own.groupBy("conv", "hash").agg(F.min(place).alias("here"))
    anywhere = own.where(F.col("chars") >= LEAST_CHARS).groupBy("hash").agg(F.min(place).alias("anywhere"))
    found = (
        quoted.join(here, quoted["conv"].eqNullSafe(here["conv"]) & (quoted["hash"] == here["hash"]), "left")
        .select(quoted["*"], "here")
        .join(anywhere, "hash", "left")
        .withColumn("me", place)
        .withColumn("origin", F.when(F.col("here") < F.col("me"), F.col("here")).otherwise(F.col("anywhere")))
        .where(F.col("origin") < F.col("me"))
    )
    # The outermost level that has an original decides; then characters, then the later message.
    sums = found.groupBy("row", "level", "origin").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("row").agg(
        F.max(F.struct(-F.col("level"), "chars", "origin")).getField("origin").getField("row").alias("parent"),
        F.sum("n").alias("linked"),
    )


def reply_paths(messages: DataFrame, links: DataFrame) -> DataFrame:
    """``row, root, depth, path`` of every message that has a parent; ``path``: the
    (conversation, turn, row) of root, ..., message. Paths double in each round."""
    place = F.struct("conv", "turn", "row")
    spot = messages.select("row", place.alias("spot"))
    now = links.select("row", F.col("parent").alias("top"))
    now = saved(now.join(spot, "row").select("row", "top", F.array("spot").alias("path")), "paths")
    while True:
        up = now.select(F.col("row").alias("top"), F.col("top").alias("higher"), F.col("path").alias("above"))
        after = now.join(up, "top", "left").select(
            "row",
            F.coalesce("higher", "top").alias("top"),
            F.concat(F.coalesce("above", F.slice("path", 1, 0)), "path").alias("path"),
            F.col("higher").isNotNull().alias("grew"),
        )
        after = saved(after, "paths")
        dropped(now)
        now = after
        if after.where("grew").isEmpty():
            break
    tops = spot.select(F.col("row").alias("top"), F.col("spot").alias("first"))
    return now.join(tops, "top").select(
        "row",
        F.col("top").alias("root"),
        F.size("path").cast("long").alias("depth"),
        F.concat(F.array("first"), "path").alias("path"),
    )


def link_quotes(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``given`` (the columns of ``conversations``, as a struct), ``row`` (a number of its own), ``parent``,
    ``root``, ``depth``, ``path``, ``linked`` and ``clean`` (the text without quotes) of every message.

    Sorted by ``path`` the rows are reply-ordered conversations: a message comes after
    its parent and before its parent's later siblings.
    """
    stored = numbered(conversations)
    messages = stored.select(
        row_of(stored).alias("row"),
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.col(text_col).alias("text"),
    )
    links = saved(parents(messages), "reply-links")
    paths = reply_paths(messages.select("row", "conv", "turn"), links)
    told = links.join(paths, "row")
    given = stored.select(
        F.struct(*[F.col(c) for c in conversations.columns]).alias("given"), row_of(stored).alias("row")
    )
    mine = F.struct(
        F.col("given")[conv_col].alias("conv"), F.col("given")[turn_col].alias("turn"), F.col("row").alias("row")
    )
    return given.join(told, "row", "left").select(
        "given",
        "row",
        "parent",
        F.coalesce("root", "row").alias("root"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("path", F.array(mine)).alias("path"),
        F.coalesce("linked", F.lit(0).cast("long")).alias("linked"),
        without_quotes(F.col("given")[text_col]).alias("clean"),
    )
