"""Chat formatting of reply trees.

Nodes name their parents. Iterative self-joins with doubling steps (1, 2, 4, ... links) enumerate
all root-to-leaf paths in about log2(depth) rounds; branches can be ranked by score; each chosen
path becomes one conversation in a template whose control strings are escaped inside texts, with
the spans of the assistant's texts as loss mask. All of it is built-in functions.

Template of one turn: "### role: text </turn>" and a line feed. Inside roles and texts a backslash
stands before each backslash, before a second "#" in a row, before the "/" of "</", and in roles
before ":". So neither "###" nor "</turn>" stands inside them, and taking one backslash away from
before each following character restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# The template.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column, *, role: bool = False) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, "(?<=#)#", r"\\#")
    out = F.regexp_replace(out, "</", r"<\\/")
    return F.regexp_replace(out, ":", r"\\:") if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of nodes (tree, node, parent): a row (tree, leaf, node, up) for each node
    of each path, up being the links from the leaf.

    A parent that is null or not in the tree makes a root. Branches that hang on a cycle have no
    root and are left out. Node ids must be unique in their tree; a null node has no replies.
    """
    keys = nodes.select("tree", "node", "parent")
    ids = keys.select(F.col("tree").alias("t"), F.col("node").alias("n")).where("n IS NOT NULL").distinct()
    linked = keys.join(ids, same("tree", "t") & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up"))
    linked = cut(linked)
    parents = linked.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    found = linked.join(parents, same("tree", "t") & (F.col("node") == F.col("n")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    largest = linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump = linked.where("up IS NOT NULL")
    step = 1
    while step < largest and jump.limit(1).count():
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to"))
        further = found.join(j, same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        found = cut(found.unionAll(further))
        to = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to"))
        jump = cut(jump.join(to, same("tree", "t") & (F.col("up") == F.col("n"))).select("tree", "node", F.col("to").alias("up")))
        step *= 2
    # After as many links as the largest tree has nodes, only cycles go on.
    endless = jump.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    return found.join(endless, same("tree", "t") & (F.col("leaf") == F.col("n")), "left_anti") if step >= largest else found


def format_trees(nodes: DataFrame, *, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, top: int | None = None, assistant: str = "assistant") -> DataFrame:
    """Formats the chosen root-to-leaf paths of reply trees.

    Returns for each path: tree, leaf, n_turns long, score double (sum over the path, null scores
    count 0), formatted string, loss_spans array<struct<start:int,length:int>> in code points of
    `formatted`. With `top`, the branches of each tree are ranked by score (ties: smaller leaf
    first) and `top` of them chosen; else all are. Null texts and roles are empty; a null tree is a
    tree of its own; of rows with one (tree, node) that with the smallest (parent, role, text) counts.
    Extra columns, whatever their names, are not read. An empty table gives an empty table.

    A tree's paths are spread over tasks by leaf; only one path must fit one row.
    """
    picked = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    one = picked.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("tree", "node", "x.*")
    found = paths(one)
    with_text = found.join(one.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score"), same("tree", "t") & same("node", "n")).select("tree", "leaf", "up", "role", "text", "score")
    if top is not None:
        totals = with_text.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        best = [F.col("score").desc(), F.col("leaf").asc()]
        # A large tree's leaves are ranked in parts first; each part keeps as many as all need.
        few = totals.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*best))).where(F.col("r") <= top)
        chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(*best))).where(F.col("r") <= top).select(F.col("tree").alias("t"), F.col("leaf").alias("n"))
        with_text = with_text.join(chosen, same("tree", "t") & same("leaf", "n"), "left_semi")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(BETWEEN))
    turn = with_text.select("tree", "leaf", "up", "score", (F.col("role") == assistant).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    path = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    turn = turn.withColumn("start", F.sum(F.length("piece").cast("long")).over(path.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + F.length("head"))
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))))
    pieces = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece")))
    grouped = turn.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("score").alias("score"), pieces.alias("pieces"), spans.alias("loss_spans"))
    return grouped.select("tree", "leaf", "n_turns", "score", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def turns_of(formatted: Column) -> Column:
    """array<struct<role,text>> that a formatted conversation holds."""
    pieces = F.split(formatted, " </turn>\n", -1)
    held = F.slice(pieces, 1, F.size(pieces) - 1)
    part = lambda p, k: unescape(F.regexp_extract(p, r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$", k))
    return F.transform(held, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def from_turns(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat conversations as reply trees of one branch: each row replies to the one before it, by
    turn, then role, then text; null turns come first."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    nth = F.row_number().over(order).cast("long")
    return rows.select(F.col(conversation).alias("tree_id"), nth.alias("node_id"), F.nullif(nth - 1, F.lit(0)).alias("parent_id"), F.col(role).alias("role"), F.col(text).alias("text"))
