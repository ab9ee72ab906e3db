"""Reply trees to training conversations.

Messages form trees by parent ids. Iterative self-joins walk from the roots to the leaves: each round
joins the frontier with the children of its last messages, doubling the reach of every message's
ancestor pointer, so a tree of depth d takes about log2(d) rounds. Leaves are ranked in their tree by
the mean score of their path (then by depth and id), and each chosen path becomes one conversation.

Template: <s>role[INST]text[/INST]</s> for every turn, one after another. The control strings all
hold "<" or "[", so a backslash goes before these and before backslashes in roles and texts: an
unescaped "<" or "[" in the output always is the template's. Reading back removes the backslashes.
The loss mask covers the escaped texts of the trained role, as [start, end) code point offsets.

Defined results: a null role or text is an empty one; a message whose parent is missing, null or
itself is a root; messages that repeat an id within a tree are joined as one, the one with the
smallest role, text; messages on a cycle have no root and are left out; a null tree id is a tree of
its own; a null score counts as zero; extra columns are ignored, whatever their names; an empty
table gives an empty result. No task holds more than a path's messages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talkweave.llm.common import durable

BOS, OPEN, CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\<")), F.lit("["), F.lit("\\["))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def linear_tree(rows: DataFrame, tree_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of conversations whose rows each answer the one before.

    Rows of equal turn are ordered by role and text."""
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    d = rows.select(F.col(tree_col).alias("tree"), F.col(order_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("id", F.row_number().over(w).cast("long"))
    return d.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth): the messages on the path from the root to each leaf, the root's depth being 1.

    First every message learns its depth by pointer doubling, in rounds that drop who has met the root; then each leaf's path is unrolled, one self-join
    for each bit of the depth: the rows at a multiple of 2**k steps above a leaf are joined with their ancestor
    2**(k-1) steps further up."""
    named = F.coalesce(F.col("tree").cast("string"), F.lit("\0null"))
    m = messages.select(named.alias("t"), F.col("id"), F.col("parent"))
    m = m.groupBy("t", "id").agg(F.min("parent").alias("parent"))
    there = m.select("t", F.col("id").alias("parent"), F.lit(True).alias("found"))
    m = m.withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
    up = m.join(there, ["t", "parent"], "left").select("t", "id", F.when(F.col("found"), F.col("parent")).alias("up"))
    # up: the ancestor 2**k steps above in round k; steps: how far that is, or the root.
    state = durable(up.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1)))
    largest = state.groupBy("t").agg(F.count("up").alias("under")).agg(F.max("under")).first()[0] or 0
    # Each round works on the messages that have not met their root alone. Whoever has not after as many steps
    # as its tree has messages goes in circles.
    rooted, rounds = state.filter("up is null"), [state.filter("up is not null")]
    while 2 ** (len(rounds) - 1) <= largest:
        known = rooted.unionByName(rounds[-1])
        far = known.select("t", F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        state = durable(rounds[-1].join(far, ["t", "up"], "left").select("t", "id", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        rooted = rooted.unionByName(state.filter("up is null"))
        rounds.append(state.filter("up is not null"))
    jumps = [r.select("t", "id", "up") for r in rounds]
    whole = rooted.select("t", "id", (F.col("steps") + 1).alias("depth"))
    leaves = whole.join(m.select("t", F.col("parent").alias("id")), ["t", "id"], "left_anti")
    rows = leaves.select("t", F.col("id").alias("leaf"), F.col("id").alias("node"), "depth")
    for step, jump in reversed([(2**k, j) for k, j in enumerate(jumps)]):
        above = jump.select("t", F.col("id").alias("node"), "up")
        here, further = F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - step).alias("depth"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, further))
        rows = rows.join(above, ["t", "node"], "left").select("t", "leaf", F.explode(both).alias("x")).select("t", "leaf", "x.node", "x.depth")
    return rows


def conversations(messages: DataFrame, per_tree: int = 1, trained_role: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, score, n_turns, formatted, loss (array of [start, end) offsets).

    messages: tree, id, parent, role, text, score. per_tree: how many paths of each tree are formatted."""
    kind = messages.schema["tree"].dataType
    messages = durable(messages.select("tree", "id", "parent", "role", "text", "score"))  # read by many joins
    held = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("\0null")).alias("t"), "tree", F.col("id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    held = held.groupBy("t", "node").agg(F.first("tree", True).alias("tree"), F.min(F.struct("role", "text", "score")).alias("m"))
    on = durable(paths(messages))
    scored = on.join(held.select("t", "node", F.col("m.score").alias("score")), ["t", "node"]).groupBy("t", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    best = Window.partitionBy("t").orderBy(F.col("score").desc(), F.col("n_turns").desc(), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_tree)
    turn = on.join(chosen, ["t", "leaf"]).join(held, ["t", "node"])
    head = F.concat(F.lit(BOS), escape(F.col("m.role")), F.lit(OPEN))
    body = escape(F.col("m.text"))
    close = CLOSE + EOS
    before = Window.partitionBy("t", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumns({"head": head, "body": body}).withColumn("size", F.length("head") + F.length("body") + len(close))
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    turn = turn.select("t", "leaf", "rank", chosen["score"], "n_turns", "tree", F.struct("depth", "head", "body", F.when(F.col("m.role") == trained_role, start).alias("loss")).alias("part"))
    out = turn.groupBy("t", "leaf").agg(F.first("tree", True).alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"), F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"))
    loss = F.transform(F.filter("parts", lambda p: p["loss"].isNotNull()), lambda p: F.array(p["loss"], p["loss"] + F.length(p["body"])))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(close))), "")
    return out.select(F.col("tree").cast(kind), "leaf", "rank", "score", F.col("n_turns").cast("long"), formatted.alias("formatted"), loss.alias("loss"))


TURN = re.compile(r"<s>((?:[^\\<\[]|\\.)*)\[INST\]((?:[^\\<\[]|\\.)*)\[/INST\]</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; an error if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame, key_col: str = "tree") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows with formatted and loss, read from these two alone."""
    from hashlib import sha256

    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema[key_col].dataType
    schema = T.StructType([T.StructField(key_col, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse(text)
                masked = "".join(unescape(text[s:e]) for s, e in spans)
                rows.append((key, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(masked), sha256(masked.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return formatted.select(key_col, "formatted", "loss").mapInArrow(run, schema)
