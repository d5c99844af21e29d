"""Quotation linking: quote levels, passage hashes, links to the originals, and conversations in reply order.

DataFrame functions only. Nothing collects a conversation: a message is a row all the way, lines meet per message, and
what orders a conversation are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepared

#: Marks of a quoted line, one > a level, with blanks before each; and the line that introduces a quotation.
MARKS = r"^(?:[ \t]*>)+"
INTRODUCES = r"(?i)^[ \t]*(?:on|am|le|el)\b.*(?:wrote|schrieb|a écrit|escribió)[^:]{0,80}:[ \t]*$"
QUOTED = r"(?:^|\n)[ \t]*>"


def normalised(text: Column) -> Column:
    """Lower case, white space squeezed: what mail programs change about a quoted passage doesn't count."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """(mid, conv, turn, pos, level, body) of each line of the messages that quote; introducing lines are gone."""
    quoting = messages.where(F.col("text").rlike(QUOTED))
    lines = quoting.select("mid", "conv", "turn", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    lines = lines.select("mid", "conv", "turn", "pos", level.alias("level"), F.regexp_replace("line", MARKS + " ?", "").alias("body"))
    following = F.lead("level").over(Window.partitionBy("mid").orderBy("pos"))
    return lines.withColumn("next", following).where(~(F.col("body").rlike(INTRODUCES) & F.coalesce(F.col("next") > F.col("level"), F.lit(False)))).drop("next")


def passages(lines: DataFrame) -> DataFrame:
    """(mid, conv, turn, run, level, body) of each run of lines of one level."""
    by = Window.partitionBy("mid").orderBy("pos")
    starts = F.when(F.col("level") == F.lag("level").over(by), 0).otherwise(1)
    marked = lines.withColumn("start", starts).withColumn("run", F.sum("start").over(by))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return marked.groupBy("mid", "conv", "turn", "run", "level").agg(body.alias("body"))


def parts_of(text: Column) -> Column:
    """The normalised text, its paragraphs and its lines, none of them empty."""
    parts = F.transform(F.concat(F.array(text), paragraphs(text), F.split(text, "\r?\n")), normalised)
    return F.filter(parts, lambda x: F.length(x) > 0)


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\r?\n(?:[ \t]*\r?\n)+")


def said_lines(text: Column) -> Column:
    """The normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\r?\n"), normalised), lambda x: F.length(x) > 0)


def originals(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv, turn, h) of what a message says itself: its whole text, its runs between quotations, and the paragraphs and lines of both."""
    said = messages.where(F.col("clean").isNotNull()).select("conv", "turn", F.explode(parts_of(F.col("clean"))).alias("part"))
    said = said.unionByName(runs.where("level = 0").select("conv", "turn", F.explode(parts_of(F.col("body"))).alias("part")))
    return said.select("conv", "turn", F.md5("part").alias("h")).distinct()


def blocks(messages: DataFrame, lengths: list[int]) -> DataFrame:
    """(conv, turn, h) of every block of as many successive lines as one of lengths says; blank lines don't count."""
    lined = messages.where(F.col("clean").isNotNull()).select("conv", "turn", said_lines(F.col("clean")).alias("lines"))
    sized = lined.withColumn("n", F.explode(F.lit(lengths).cast("array<int>"))).where(F.col("n") <= F.size("lines"))
    at = sized.select("conv", "turn", "n", "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1)).alias("at"))
    return at.select("conv", "turn", F.md5(F.array_join(F.slice("lines", F.col("at"), F.col("n")), " ")).alias("h"))


def linked_by_parts(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """linked() for runs that no message says as a whole: by their paragraphs, and by the lines of paragraphs that
    aren't found either. Each has to be said somewhere, but for what has neither letter nor digit (marks of what was
    left out); the run is linked to the message that most of it, by length, is linked to, in its own conversation if
    any is, and to the later one of equals."""
    each = quotes.select("mid", "conv", "turn", "run", "level", F.posexplode(paragraphs(F.col("body"))).alias("par", "text"))
    lines = each.select("*", F.posexplode(said_lines(F.col("text"))).alias("line", "part")).drop("text")
    parts = each.select("mid", "conv", "turn", "run", "level", "par", F.lit(-1).alias("line"), normalised(F.col("text")).alias("part")).unionByName(lines)
    parts = cut(parts.where(F.col("part").rlike(r"[\p{L}\p{N}]")).withColumn("h", F.md5("part")))
    once = parts.select("mid", "conv", "turn", "run", "level", "h").distinct()
    found = parts.join(linked(once, said).select("mid", "run", "h", "to_conv", "to_turn", "inside"), ["mid", "run", "h"])
    by = Window.partitionBy("mid", "run", "par")
    found = found.where((F.col("line") >= 0) | F.col("to_turn").isNotNull())
    found = found.withColumn("whole", F.min("line").over(by) < 0).where(~F.col("whole") | (F.col("line") < 0))
    ok = found.groupBy("mid", "run").agg(F.min(F.col("to_turn").isNotNull()).alias("ok")).where("ok").drop("ok")
    votes = found.join(ok, ["mid", "run"], "left_semi").groupBy("mid", "conv", "turn", "run", "level", "to_conv", "to_turn", "inside").agg(F.sum(F.length("part")).alias("n"))
    best = F.max_by(F.struct("to_conv", "to_turn", "inside"), F.struct("inside", "n", "to_turn", -F.col("to_conv"))).alias("best")
    return votes.groupBy("mid", "conv", "turn", "run", "level").agg(best).select("mid", "conv", "turn", "run", "level", "best.*")


def linked(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """quotes with to_conv and to_turn: the last earlier message of the conversation that says the passage, or else the
    first message that does in any other conversation. The window sums up as it goes, so a passage that one
    conversation says and quotes any number of times costs its rows, not their pairs."""
    said = said.join(quotes.select("h").distinct(), "h", "left_semi").distinct()
    both = quotes.select("mid", "conv", "turn", "run", "level", "h", F.lit(None).cast("long").alias("said")).unionByName(said.select(F.lit(None).cast("long").alias("mid"), "conv", "turn", F.lit(None).cast("long").alias("run"), F.lit(None).cast("int").alias("level"), "h", F.col("turn").alias("said")))
    before = Window.partitionBy("conv", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("to_turn", F.max("said").over(before)).where("mid is not null").drop("said")
    first = said.groupBy("h").agg(F.min(F.struct("conv", "turn")).alias("first"))
    other = said.join(first, "h").where(~F.col("conv").eqNullSafe(F.col("first.conv"))).groupBy("h").agg(F.min(F.struct("conv", "turn")).alias("second"))
    far = near.join(first, "h", "left").join(other, "h", "left")
    elsewhere = F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first"))
    far = far.withColumn("far", elsewhere)
    return far.select("mid", "conv", "turn", "run", "level", "h", F.when(F.col("to_turn").isNotNull(), F.col("conv")).otherwise(F.col("far.conv")).alias("to_conv"), F.coalesce("to_turn", F.col("far.turn")).alias("to_turn"), F.col("to_turn").isNotNull().alias("inside"))


def rooted(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of each reply (conv, turn, up): where the chain of originals starts, by doubling.

    A round doubles the length of the known part of each chain, so rounds grow with the logarithm of the longest.
    """
    state = cut(replies.groupBy("conv", "turn").agg(F.max("up").alias("root")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        on = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = state.join(on, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        step = cut(step.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")))
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without quotations, in reply order: conv, turn, role, text, reply_to, thread_root, reply_depth, n_quotes
    and links (level, conv, turn of each quoted passage's original, nulls where there is none).

    A quoted passage is a run of lines of one level; it is linked by the hash of its normalised text, to a message, a
    run, a paragraph, a line or any block of successive lines, or else as linked_by_parts() says. A message replies
    to the original of its first passage of the least level that has one earlier in the conversation; reply_depth is
    the number of replies from thread_root, and (conv, thread_root, turn) is the order of the rows: an original comes
    before what replies to it, and threads don't mix. A message that quotes nothing is kept as it is, and roots a
    thread; of one that does, the own lines stay, trimmed. Null texts stay null; messages with a null conversation or
    turn are kept and link with nothing; repeated rows come back repeated; an empty table gives no rows; other columns
    are ignored.
    """
    prepared(messages.sparkSession)
    named = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = cut(named.withColumn("mid", F.monotonically_increasing_id()))
    runs = cut(passages(lines_of(rows)))
    own = runs.where("level = 0").groupBy("mid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "body"))), lambda x: x["body"]), "\n").alias("own"))
    clean = F.when(F.col("text").rlike(QUOTED), F.regexp_replace(F.coalesce("own", F.lit("")), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    rows = rows.join(own, "mid", "left").withColumn("clean", clean)
    quotes = runs.where("level > 0").withColumn("h", F.md5(normalised(F.col("body"))))
    known = quotes.where((F.length(F.trim("body")) > 0) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    rows, placed = cut(rows), "conv is not null and turn is not null"
    said = cut(originals(rows.where(placed), runs.where(placed)))
    links = cut(linked(known, said).drop("h"))
    # What is left are blocks of lines out of longer texts, or parts with something between them left out.
    left = cut(known.join(links.where("to_turn is not null"), ["mid", "run"], "left_anti"))
    texts = F.concat(F.array("body"), paragraphs(F.col("body")))
    lengths = [r["n"] for r in left.select(F.explode(F.transform(texts, lambda x: F.size(said_lines(x)))).alias("n")).where("n > 1").distinct().collect()]
    if not left.isEmpty():
        said = cut(said.unionByName(blocks(rows.where(placed), lengths)).distinct()) if lengths else said
        again = cut(linked(left, said).drop("h"))
        parted = cut(linked_by_parts(left.join(again.where("to_turn is not null"), ["mid", "run"], "left_anti"), said))
        found = again.where("to_turn is not null").unionByName(parted)
        links = cut(links.where("to_turn is not null").unionByName(found))
    up = links.where("inside").groupBy("mid", "conv", "turn").agg(F.min_by("to_turn", F.struct("level", "run")).alias("up"))
    roots = rooted(up.select("conv", "turn", "up"))
    each = quotes.join(links.select("mid", "run", "to_conv", "to_turn"), ["mid", "run"], "left").groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("run", "level", "to_conv", "to_turn"))).alias("found"))
    out = rows.join(up.select("mid", F.col("up").alias("reply_to")), "mid", "left").join(roots, ["conv", "turn"], "left").join(each, "mid", "left")
    found = F.coalesce(F.transform("found", lambda x: F.struct(x["level"].alias("level"), x["to_conv"].alias("conv"), x["to_turn"].alias("turn"))), F.array().cast("array<struct<level:int,conv:bigint,turn:bigint>>"))
    out = out.select("conv", "turn", "role", F.col("clean").alias("text"), "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"), F.size(found).cast("long").alias("n_quotes"), found.alias("links"))
    return out.orderBy("conv", "thread_root", "turn")
