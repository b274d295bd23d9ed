"""Reply trees to chat transcripts, with DataFrame operations only.

Messages form trees by parent. Iterative self-joins (each doubles the reach) give every message its root, depth and the
sum of scores on its path; leaves are ranked by mean path score; the chosen leaves' paths are enumerated by the same
doubled links and each is formatted as one conversation. Finished rows leave the frontier, so the number of rounds is the
logarithm of the deepest tree and their cost follows the rows still climbing.

Template: <|im_start|>role\\ntext<|im_end|>\\n. Inside roles and texts \\ becomes \\\\ and <| becomes <\\|, which is reversible
and leaves no control string. Loss spans are code-point ranges of the formatted string that hold assistant texts.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own; turns that tie are
ordered by role and text; repeated turns are all kept; an empty table gives no rows; other columns are ignored, whatever their names;
texts may be long, but a conversation is one row of the result, so it has to fit in memory: nothing else is gathered per
conversation. The conversation id -2^63 stands for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a tree in which each turn answers the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w)
    return conversations.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links of 1, 2, 4 ... steps up, and for each node the length and score of its whole path.

    nodes: tree, node, parent, score. A reply to a message that does not exist is a root; members of a cycle have no path.
    """
    here = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    rows = nodes.join(here, ["tree", "parent"], "left").select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).alias("length"))
    rows = staged(rows, "chat-links")
    links, done, live = [], [rows.filter("up is null")], rows.filter("up is not null")
    bound = rows.count()
    while 2 ** len(links) <= 2 * bound and live.head(1):  # only cycles climb farther than there are nodes
        links.append(live.select("tree", "node", "up"))
        # What lies above is a finished path, or a link as long as this one.
        above = _union([*done, live]).select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("length").alias("steps"))
        step = live.join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("steps")).alias("length"))
        step = staged(step, "chat-links")
        done.append(step.filter("up is null"))
        live = step.filter("up is not null")
    return links, _union(done)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def chosen_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, rank, leaf, node, depth) of the messages on the best paths: highest mean score, then longest, then smallest leaf."""
    links, paths = climb(nodes)
    parents = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = paths.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_tree)
    marked = staged(ranked.select("tree", "rank", F.col("node").alias("leaf"), "node", F.col("length").alias("depth")), "chat-marked")
    for k in reversed(range(len(links))):
        step = links[k].select("tree", "node", "up")
        more = marked.join(step, ["tree", "node"]).select("tree", "rank", "leaf", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        marked = marked.unionByName(more)
        marked = staged(marked, "chat-marked") if k % 2 == 0 else marked
    return marked


def formatted(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, rank, formatted, loss_spans: array of (start, end) code points.

    messages: tree, node, parent, role, text, score.
    """
    chosen = chosen_paths(messages.select("tree", "node", "parent", "score"), per_tree)
    turns = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    rows = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "node", F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")).alias("role"), escaped(F.col("text")).alias("text")))).alias("turns"))
    piece = "concat('" + START + "', t.role, '\\n', t.text, '" + END + "\\n')"
    start = len(START) + 1
    head = f"char_length(t.role) + {start}"
    size = f"char_length(t.role) + char_length(t.text) + {len(START) + len(END) + 2}"
    spans = (
        "aggregate(turns, cast(struct(0 as at, array() as spans) as struct<at:int,spans:array<struct<start:int,end:int>>>), "
        f"(a, t) -> struct(a.at + {size} as at, if(t.role = 'assistant', concat(a.spans, array(struct(a.at + {head} as start, a.at + {head} + char_length(t.text) as end))), a.spans) as spans)).spans"
    )
    return rows.select("tree", "rank", F.expr(f"array_join(transform(turns, t -> {piece}), '')").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns: array of (role, text), and loss: the unescaped text under the loss mask, read from the formatted string."""
    parts = F.filter(F.split("formatted", START.replace("|", r"\|"), -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
        text = F.substring(x, F.char_length(role) + 2, F.char_length(x) - F.char_length(role) - len(END) - 2)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return chats.withColumn("turns", F.transform(parts, turn)).withColumn("loss", loss)


def conversations_as_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for a table of rows by turn."""
    none = F.lit(-(2**63))  # joins need a value for the null id
    messages = staged(linear_tree(conversations.withColumn("conv_id", F.coalesce("conv_id", none))).withColumnRenamed("conv_id", "tree"), "chat-messages")
    return formatted(messages).select(F.when(F.col("tree") != none, F.col("tree")).alias("conv_id"), "formatted", "loss_spans")
