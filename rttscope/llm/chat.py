"""Chat formatting from reply trees.

Messages form trees by ``parent``.  Iterative self-joins with doubling steps give every message its
depth and the summed score of its path from the root; leaves are ranked per conversation by mean
path score, and the messages above each chosen leaf are marked by walking the same doubling tables
back down.  Each chosen path becomes one string:

    <|turn|>ROLE\\nTEXT<|end|><|turn|>ROLE\\nTEXT<|end|>...

Inside roles and texts, ``\\`` becomes ``\\e``, ``<`` becomes ``\\l``, ``[`` becomes ``\\b``, and in roles a
line break becomes ``\\n``, so no control string (``<|end|>``, ``</s>``, ``[INST]``) can occur there and
every text can be read back.  The loss mask covers the texts of ``assistant`` turns.

Defined results: a null text or role counts as empty; messages of equal turn are ordered by
role, then text, then repeated; a parent that does not exist makes its message a root; messages
on a parent cycle belong to no path; of equally ranked leaves the smaller id goes first; rows with a
null conversation form one conversation; rows that repeat a message id count as one, the smallest; an empty table gives an empty result.  Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rttscope.session import materialise

TURN, END = "<|turn|>", "<|end|>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, code in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), *([("\n", "\\n")] if role else [])):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark, code in (("\n", "\\n"), ("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def reply_chain(rows: DataFrame) -> DataFrame:
    """A linear conversation as a tree: each row replies to the one before it by (turn, role, text).

    The order is found on slim rows; texts of one conversation meet only when it is formatted.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, depth, msg_id) of the ``branches`` best root-to-leaf paths per conversation."""
    slim = messages.select("conv_id", "msg_id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = slim.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p")).distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    tree = slim.join(there, same("conv_id", "c") & (F.col("parent") == F.col("p")), "left").select("conv_id", "msg_id", F.col("p").alias("up"), F.lit(1).alias("steps"), "score")
    # in round k ``up`` is the ancestor 2^k steps above, ``score`` the sum over the steps below it; rows that
    # have reached their root wait, so a round joins only what is longer
    state, rounds, most = materialise(tree, "reply-up"), [], 2 * slim.count()
    parents = state.where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("m")).distinct()
    # a chain has no more messages than the table; a longer one is a cycle
    while 2 ** len(rounds) <= most and not state.where("up is not null").isEmpty():
        rounds.append(state)
        above = state.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        nxt = state.where("up is not null").join(above, same("conv_id", "c") & (F.col("up") == F.col("m"))).select(
            "conv_id", "msg_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score"))
        state = materialise(nxt.unionByName(state.where("up is null")), "reply-up")
    done = state.where("up is null").select("conv_id", "msg_id", F.col("steps").alias("depth"), F.col("score").alias("total"))
    leaves = done.join(parents, same("conv_id", "c") & (F.col("msg_id") == F.col("m")), "left_anti")
    order = W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), "msg_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    marked = materialise(chosen.select("conv_id", F.col("msg_id").alias("leaf"), "rank", "msg_id"), "reply-paths")
    for table in reversed(rounds):
        step = table.where("up is not null").select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "up")
        higher = marked.join(step, same("conv_id", "c") & (F.col("msg_id") == F.col("m"))).select("conv_id", "leaf", "rank", F.col("up").alias("msg_id"))
        marked = materialise(marked.union(higher), "reply-paths")
    depth = done.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "depth")
    return marked.join(depth, same("conv_id", "c") & (F.col("msg_id") == F.col("m"))).select("conv_id", "leaf", "rank", "depth", "msg_id")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, formatted): one string per chosen path."""
    once = messages.groupBy("conv_id", "msg_id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x"))
    messages = materialise(once.select("conv_id", "msg_id", "x.*"), "chat-messages")
    body = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"),
                           F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n"), escape(F.col("text")), F.lit(END)).alias("piece"))
    rows = paths(messages, branches).join(body, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("m")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("depth", "piece"))), lambda x: x["piece"])
    return rows.groupBy("conv_id", "leaf", "rank").agg(F.array_join(pieces, "").alias("formatted"))


def read_back(table: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``turns``, the array of (role, text, loss) that the string holds."""
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(len(TURN) + 1), F.length(x))
    cut = F.transform(parts, lambda x: F.struct(F.substring_index(body(x), "\n", 1).alias("head"), body(x).alias("whole")))
    turns = F.transform(cut, lambda x: F.struct(
        unescape(x["head"]).alias("role"), unescape(F.substring(x["whole"], F.length(x["head"]) + 2, F.length(x["whole"]))).alias("text"), (x["head"] == loss_role).alias("loss")))
    return table.withColumn("turns", turns)
