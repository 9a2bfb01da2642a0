"""Chat formatting of reply trees, with DataFrame functions only.

A message has a conversation, an id, the id of the message it replies to, a role, a text and a score.
Self-joins double the length of the known way up each round, so a tree of depth d takes about log2(d)
rounds; they give each message its depth and the sum of scores on its way to the root. Leaves of a
conversation are ranked by that sum's mean, then depth, then id, and each chosen leaf marks its way up
by the same links. A path is formatted as one conversation, and the loss mask holds the places of the
assistant's texts in the result.

Template: ``<s>`` once, then per turn ``[INST]`` role ``[/INST]`` text ``</s>``. Inside roles and texts
a backslash is doubled and one is put into every control string, so unescaping restores any text.

Messages are joined on (conversation, id), which spreads a conversation of any size; only a formatted
path, which is one row by nature, is gathered.

Edge cases: a null role or text is empty; a message whose parent is missing is a root; repeated rows
are kept as turns of their own by `linear_trees`, and in trees the least row of an id counts; messages
that reply in a circle hang on no root and are left out; extra columns are ignored; an empty table
gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.llm.scratch import Scratch

START, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
#: The role whose texts the loss covers.
LEARNED = "assistant"
_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """A text in which no control string is left; `unescape` restores it."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_trees(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return numbered.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def rooted_paths(spark: SparkSession, messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """(conv_id, branch, depth, id): the messages of each conversation's `branches` best paths."""
    nodes = messages.groupBy("conv_id", "id").agg(F.min(F.struct("parent", "score")).alias("m")).select("conv_id", "id", F.col("m.parent").alias("parent"), F.coalesce("m.score", F.lit(0.0)).alias("score"))
    nodes = scratch.save(nodes, "nodes")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("p"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    linked = nodes.join(known, same & (F.col("parent") == F.col("p")), "left")
    # ways[k] has the messages of more than 2^k on their way: `up` is the one 2^k steps above, `sum` and
    # `steps` cover the steps before it; whoever reaches the root leaves for `ended`
    step = linked.select("conv_id", "id", F.col("p").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    step = scratch.save(step, "step-0")
    ways, ended = [step.where("up is not null")], [step.where("up is null")]
    limit = nodes.count()
    while ways[-1].limit(1).count() and (1 << len(ways)) <= 2 * max(1, limit):
        known = ways[-1]
        for e in ended:
            known = known.unionByName(e)
        above = known.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("up").alias("next"), F.col("sum").alias("more"), F.col("steps").alias("on"))
        doubled = ways[-1].join(above, same & (F.col("up") == F.col("i"))).select("conv_id", "id", F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("steps") + F.col("on")).alias("steps"))
        step = scratch.save(doubled, f"step-{len(ways)}")
        ways.append(step.where("up is not null"))
        ended.append(step.where("up is null"))
    rooted = ended[0]
    for e in ended[1:]:
        rooted = rooted.unionByName(e)
    rooted = rooted.select("conv_id", "id", "sum", F.col("steps").alias("depth"))
    replied = linked.where("p is not null").select(F.col("conv_id").alias("c"), "p").distinct()
    leaves = rooted.join(replied, same & (F.col("id") == F.col("p")), "left_anti")
    best = Window.partitionBy("conv_id").orderBy((F.col("sum") / F.col("depth")).desc(), F.col("depth").desc(), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    marked = chosen.select("conv_id", "branch", "id", "depth")
    for k in reversed(range(len(ways) - 1)):  # from a message on the path to the one 2^k above it
        jump = ways[k].select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "up")
        reached = marked.join(jump, same & (F.col("id") == F.col("i"))).select("conv_id", "branch", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        marked = scratch.save(marked.unionByName(reached), f"marked-{k}")
    return marked


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: conv_id, branch, formatted, and the loss mask as (start, length) pairs."""
    one = messages.groupBy(F.col("conv_id").alias("c"), F.col("id").alias("i")).agg(F.min(F.struct("role", "text")).alias("m"))
    turns = paths.join(one, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")))
    turns = turns.select("conv_id", "branch", "depth", F.coalesce("m.role", F.lit("")).alias("role"), escape(F.col("m.text")).alias("body"))
    turns = turns.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY)))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + len(START) + F.length("head"))
    gathered = turns.groupBy("conv_id", "branch").agg(
        F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body").alias("turn"), F.when(F.col("role") == LEARNED, F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length"))).alias("span")))).alias("t")
    )
    formatted = F.concat(F.lit(START), F.array_join(F.transform("t", lambda t: F.concat(t["turn"], F.lit(END))), ""))
    mask = F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", "branch", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as (role, text) pairs, read back from its text."""
    parts = F.split(F.substr(formatted, F.lit(len(START) + 1)), END, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    pair = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(HEAD) + 1)), r"\[/INST\]", 2))
    return F.transform(pair, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_trees(spark: SparkSession, messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the `branches` best paths of every conversation's reply tree.

    `messages` has conv_id, id, parent, role, text, score. Returns conv_id, branch, formatted, loss_mask.
    """
    scratch = Scratch(spark, "chat")
    rows = scratch.save(messages.select("conv_id", F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "role", "text", F.col("score").cast("double").alias("score")), "messages")
    return format_paths(rooted_paths(spark, rows, scratch, branches), rows)
