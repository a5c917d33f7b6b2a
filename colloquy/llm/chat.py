"""Chat formatting of reply trees.

Iterative self-joins with doubling jumps find each node's distance to its root and the score on its way, then list the
nodes on the chosen root-to-leaf paths; each path becomes one conversation in a template that marks turns and escapes
control strings reversibly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import write_table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Puts a backslash between ``<`` and ``|`` (after those that stand there), so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    """Reads doubled backslashes before newline marks by way of a character that roles cannot hold after escaping."""
    halves = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def branch_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Rows (tree_id, leaf_id, rank, depth, node_id) of each tree's ``top`` branches by score (None: all).

    ``nodes`` has tree_id, node_id (unique in its tree), parent_id and score. A branch scores the sum over its nodes
    (null: 0); ties go to the smaller leaf_id. A node whose parent is null or missing is a root. Nodes on or below a
    cycle are on no root-to-leaf path and give no rows. With jumps that double, a chain of n turns takes log2 n joins.
    """
    spine = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = spine.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("known"))
    step = write_table(
        spine.join(known, ["tree_id", "parent_id"], "left")
        .select("tree_id", "node_id", F.when(F.col("known") == 1, F.col("parent_id")).alias("jump"), "score", F.lit(0).cast("long").alias("depth")),
        "chat-jumps",
    )
    # only nodes whose root is not found yet are joined again, with all nodes
    found, open_nodes, jumps, left = step.where("jump is null"), step.where("jump is not null"), [], None
    while (open_now := open_nodes.count()) and open_now != left:
        left = open_now
        jumps.append(open_nodes.select("tree_id", "node_id", "jump"))
        far = found.union(open_nodes).select("tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("far"), F.col("score").alias("more"), F.col("depth").alias("down"))
        hop = F.lit(1 << (len(jumps) - 1)).cast("long")
        step = write_table(
            open_nodes.join(far, ["tree_id", "jump"]).select(
                "tree_id", "node_id", F.col("far").alias("jump"), (F.col("score") + F.col("more")).alias("score"), F.when(F.col("far").isNull(), F.col("down") + hop).otherwise(F.lit(0)).cast("long").alias("depth")
            ),
            "chat-jumps",
        )
        found, open_nodes = found.union(step.where("jump is null")), step.where("jump is not null")
    inner = spine.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = found.join(inner, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), "score", "depth")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
    paths = (ranked if top is None else ranked.where(F.col("rank") <= top)).select("tree_id", "leaf_id", "rank", "depth", F.col("leaf_id").alias("node_id"))
    for k in reversed(range(len(jumps))):
        up = paths.join(jumps[k], ["tree_id", "node_id"]).select("tree_id", "leaf_id", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("jump").alias("node_id"))
        paths = write_table(paths.union(up), "chat-paths")
    return paths


def format_branches(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """One row a chosen branch: tree_id, leaf_id, rank, formatted, loss_spans.

    ``nodes`` also has role and text (null: empty). loss_spans are the code point ranges (start, end exclusive) of the
    assistant texts in ``formatted``.
    """
    said = nodes.select("tree_id", "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = branch_paths(nodes, top).join(said, ["tree_id", "node_id"]).select(
        "tree_id", "leaf_id", "rank", "depth",
        F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"),
    )
    rows = turns.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda s, t: F.struct(
            (s.at + F.length(t.head) + F.length(t.body) + len(END)).cast("long").alias("at"),
            F.when(
                t.learn, F.concat(s.spans, F.array(F.struct((s.at + F.length(t.head)).cast("long").alias("start"), (s.at + F.length(t.head) + F.length(t.body)).cast("long").alias("end"))))
            ).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    return rows.select("tree_id", "leaf_id", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_branches(formatted: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss_spans`` back: adds turns (role, text) and loss_text, both unescaped."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    parsed = F.transform(blocks, lambda x: F.struct(
        _role_in(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)).alias("text"),
    ))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    return formatted.withColumn("turns", parsed).withColumn("loss_text", loss)


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Chains as reply trees: each row answers the one before it in its conversation, by turn (ties: role, text).

    tree_id is conv_id as text, so that rows with a null conv_id form a conversation too (an empty text).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text",
    )
