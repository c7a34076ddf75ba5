"""Conversations from reply trees, with DataFrame functions alone.

Root-to-leaf paths come from self-joins that double their reach each round. Branches are ranked by the sum of their
messages' scores, and each chosen path is formatted as one conversation: marked turns, control strings inside texts
escaped, and the assistant's texts under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.joins import join_dealt

NO_ID = -(1 << 63)
#: &, < and " cannot stand for themselves inside a text or role, so no text can hold a mark of the template.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))
TURN = r'<turn role="([^"<]*)">\n([^<]*)</turn>\n'


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def as_replies(turns: DataFrame) -> DataFrame:
    """Flat turns as a tree in which each message answers the one before; equal turns are ordered by role and text.

    All turns are ranked in one order that is shared out by ranges, so that a very long conversation is no single task's.
    Null turns come first, null roles and texts are empty, rows that repeat a turn are all messages, and rows without a
    conv_id are one conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = runtime.global_rank(rows, ["conv_id", "turn", "role", "text"], "place")
    firsts = runtime.staged(placed.groupBy("conv_id").agg(F.min("place").alias("first")).select(F.coalesce("conv_id", F.lit(NO_ID)).alias("_conv"), "first"), "first-turns")
    joined = join_dealt(placed.withColumn("_conv", F.coalesce("conv_id", F.lit(NO_ID))), firsts, "_conv", "place")
    rows = joined.withColumn("message", F.col("place") - F.col("first") + 1)
    return rows.select("conv_id", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def root_paths(messages: DataFrame) -> DataFrame:
    """Staged (conv, leaf, message, up): every message on the path of every leaf, ``up`` steps above it.

    Messages whose parents lead to no root (a missing parent, a ring) are on no path; a null parent is a root, null
    messages are on no path, and rows that repeat a message share its paths. An empty table has none.
    """
    links = runtime.staged(messages.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"), "message", "parent"), "replies")
    most = links.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parents = links.where("parent is not null").select("conv", F.col("parent").alias("message")).distinct()
    paths = links.join(parents, ["conv", "message"], "left_anti").select("conv", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up"))
    jump = links.where("parent is not null").select("conv", "message", F.col("parent").alias("above"))
    reach = 1
    while reach < most:
        paths = runtime.staged(paths.unionByName(paths.join(jump, ["conv", "message"]).select("conv", "leaf", F.col("above").alias("message"), (F.col("up") + reach).alias("up"))), "paths")
        reach *= 2
        if reach < most:
            jump = runtime.staged(jump.join(jump.select("conv", F.col("message").alias("above"), F.col("above").alias("_next")), ["conv", "above"]).select("conv", "message", F.col("_next").alias("above")), "jumps")
            if not jump.limit(1).count():
                break
    roots = links.where("parent is null").select("conv", "message")
    whole = paths.join(roots, ["conv", "message"], "left_semi").select("conv", "leaf", F.col("up").alias("top"))
    whole = whole.groupBy("conv", "leaf").agg(F.min("top").alias("top"))
    return paths.join(whole, ["conv", "leaf"]).where("up <= top").drop("top")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` paths of each conversation with the highest scores; ties go to the smaller leaf."""
    scores = messages.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"), "message", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = root_paths(messages).join(scores, ["conv", "message"])
    ranked = rows.groupBy("conv", "leaf").agg(F.sum("score").alias("s")).withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("s"), "leaf"))).where(F.col("branch") <= branches).drop("s")
    return rows.join(ranked, ["conv", "leaf"]).select("conv", "branch", "up", "role", "text")


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Staged (conv_id, branch, segments): formatted text in order, each segment under the loss mask or not.

    ``messages``: conv_id, message, parent (null at a root), role, text, score. Null role and text are empty, a null
    score counts nothing, messages without a conv_id are one conversation. Ties between branches go to the smaller
    leaf. The formatted conversation is its segments end to end; the masked ones are exactly the assistant's texts. A
    conversation is one row of the result, however long it or its texts are. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    turn = best_paths(messages, branches)
    pieces = F.array(
        F.struct(F.concat(F.lit('<turn role="'), escape(F.coalesce("role", F.lit(""))), F.lit('">\n')).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss")),
        F.struct(F.lit("</turn>\n").alias("text"), F.lit(False).alias("loss")),
    )
    turns = turn.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), pieces.alias("pieces")))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: x["pieces"]))
    return runtime.staged(turns.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "branch", segments.alias("segments")), "chats")


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns and their digest, and the text under the loss mask."""
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    masked = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    read = chats.select("conv_id", whole.alias("whole"), masked.alias("masked"))
    roles, texts = F.regexp_extract_all("whole", F.lit(TURN), F.lit(1)), F.regexp_extract_all("whole", F.lit(TURN), F.lit(2))
    read = read.select("conv_id", "whole", "masked", roles.alias("roles"), texts.alias("texts"))
    said = unescape(F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), ""))
    return read.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("whole").cast("long").alias("formatted_chars"))
