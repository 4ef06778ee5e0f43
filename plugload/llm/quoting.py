"""Quotation linking: conversations in reply order, without quotes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plugload.operators.blocks import running
from plugload.session import materialized
from plugload.settings import Settings

#: Up to three blanks, then marks that may be followed by a blank each.
MARKS = r"^ {0,3}((?:> ?)+)"


def level(line: Column) -> Column:
    """How deeply a line is quoted; 0 for own words."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    """A line without its marks, in lower case, with single blanks."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def message_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage): every line that is not blank, by the MD5 of its normalised words."""
    lines = messages.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    parsed = lines.select("conv_id", "turn", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("words"))
    return parsed.where("words <> ''").select("conv_id", "turn", "level", F.md5(F.col("words").cast("binary")).alias("passage"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, from_conv, from_turn, lines): originals of the quoted lines of each message and level.

    The original of a line is the first message of the same conversation that says it in its own words, if it is
    earlier; else the first such message of another conversation. Own lines are reduced to one row per passage with
    partial aggregation before any join, so a very common line is one row on that side.
    """
    lines = message_lines(messages)
    quoted = lines.where("level > 0")
    own = lines.where("level = 0").join(quoted.select("passage").distinct(), "passage", "left_semi")
    here = own.groupBy(F.col("conv_id").alias("_conv"), F.col("passage").alias("_passage")).agg(F.min("turn").alias("_turn"))
    anywhere = here.groupBy("_passage").agg(
        F.min(F.struct("_conv", "_turn")).alias("_first"), F.max(F.struct("_conv", "_turn")).alias("_last")
    )
    near = quoted.join(
        here, (F.col("conv_id") == F.col("_conv")) & (F.col("passage") == F.col("_passage")) & (F.col("_turn") < F.col("turn")), "left"
    ).select("conv_id", "turn", "level", "passage", F.when(F.col("_turn").isNotNull(), F.struct("_conv", "_turn")).alias("near"))
    other = F.when(F.col("_first._conv") != F.col("conv_id"), F.col("_first")).when(F.col("_last._conv") != F.col("conv_id"), F.col("_last"))
    found = near.join(anywhere, F.col("passage") == F.col("_passage"), "left").withColumn("source", F.coalesce("near", other))
    return found.where("source is not null").groupBy(
        "conv_id", "turn", "level", F.col("source._conv").alias("from_conv"), F.col("source._turn").alias("from_turn")
    ).agg(F.count("*").alias("lines"))


def parents(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message of the same conversation that a message answers.

    That is the one with most lines among its quotes of the first level, the latest of those with equally many.
    """
    direct = links.where((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")))
    best = F.max(F.struct("lines", "from_turn")).getField("from_turn").alias("parent")
    return direct.groupBy("conv_id", "turn").agg(best)


def roots(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root): where the chain of answers ends, by doubling the steps each round."""
    now = materialized(answers.withColumn("root", F.col("parent")))
    while True:
        up = now.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root").alias("_root"))
        higher = now.join(up, (F.col("conv_id") == F.col("_conv")) & (F.col("root") == F.col("_turn")), "left")
        now = materialized(higher.select(*answers.columns, F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        moved = now.where("moved").isEmpty()
        now = now.drop("moved")
        if moved:
            return now


def without_quotes(conversations: DataFrame, s: Settings | None = None) -> DataFrame:
    """Every message once more: conv_id, turn, role, reply, n_quoted, n_linked, parent_turn, root_turn, position.

    reply is the text without quoted lines, n_quoted and n_linked count quoted lines and those with an original.
    Messages stand in reply order: by the root of their chain of answers, then by turn, so an answer follows what it
    answers; a message that quotes nothing is its own root. position numbers them from 1 within the conversation,
    in blocks where a conversation is too large for one task.

    Null texts have no lines and an empty reply. Rows without conv_id or turn have no links; rows without conv_id form
    one conversation, rows without turn stand first. Repeated rows are numbered one after the other and count their
    links together. An empty table stays empty. Columns beyond the four named are ignored.
    """
    s = s or Settings()
    messages = conversations.select("conv_id", "turn", "role", "text")
    links = materialized(quote_links(messages))
    linked = links.groupBy("conv_id", "turn").agg(F.sum("lines").alias("_linked"))
    known = linked.join(roots(parents(links)), ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    lines = F.split("text", "\n")
    plain = F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n")
    shown = messages.select(
        "conv_id", "turn", "role", F.coalesce(F.trim(plain), F.lit("")).alias("reply"),
        F.coalesce(F.size(F.filter(lines, lambda x: (level(x) > 0) & (normalised(x) != ""))).cast("bigint"), F.lit(0)).alias("n_quoted"),
    ).withColumn("n_quoted", F.greatest("n_quoted", F.lit(0)))
    joined = shown.join(known, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left").select(
        "conv_id", "turn", "role", "reply", "n_quoted", F.coalesce("_linked", F.lit(0)).alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
    )
    order = ["root_turn", "turn", "role", "reply"]
    return running(joined, ["conv_id"], order, s, sums={"position": F.lit(1).cast("bigint")})
