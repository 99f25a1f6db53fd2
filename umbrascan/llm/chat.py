"""Chat formatting of reply trees.

Messages form trees by parent. Pointer doubling (each round joins the table of jumps with itself) gives every message
its depth and the summed score of its path in log2(depth) rounds; the leaves of a tree are ranked by mean score, and
the chosen ones' root-to-leaf paths are enumerated by joining them with the same jump tables. Each path is one
conversation: every turn is `### role: text</turn>` and a line end, and a backslash stands before each backslash,
`<`, `#` and (in roles) `:` of the data, so control strings inside texts cannot be taken for turns and reading back
is exact. The loss mask is a list of character spans over the formatted text: the assistants' texts.

Cases: null roles and texts are empty; a message whose parent is null or absent is a root; a null tree is a tree of
its own; rows of a conversation are ordered by turn (nulls first), then role and text, repeated rows each stay; other
columns are ignored; an empty table gives an empty table; a cycle of parents raises an error. A conversation is one
output row, so its turns do meet in one task; nothing larger does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from . import common

MAX_ROUNDS = 40
TURN = re.compile(r"### ((?:[^\\:<#]|\\.)*): ((?:[^\\<#]|\\.)*)</turn>\n", re.S)
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: str, special: str = r"[\\<#]") -> str:
    return re.sub(f"({special})", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans under the loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {escape(role, r'[\\<#:]')}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees in which each turn answers the one before."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    own = rows.select("conv_id", tree.alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    own = own.withColumn("node", node.cast("long"))
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def jump_tables(messages: DataFrame) -> list[DataFrame]:
    """The k-th: (tree, node, up, gain): the ancestor 2**k steps up and the score of the nodes passed on the way."""
    nodes = messages.select("tree", F.col("node").alias("parent"))
    jumps = [common.settle(messages.join(nodes, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain")), "jumps")]
    while not jumps[-1].isEmpty():
        if len(jumps) > MAX_ROUNDS:
            raise ValueError("the parents form a cycle")
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        twice = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        jumps.append(common.settle(twice.select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.gain") + F.col("b.gain")).alias("gain")), "jumps"))
    return jumps[:-1]


def ranked_leaves(messages: DataFrame, jumps: list[DataFrame], top: int) -> DataFrame:
    """(tree, leaf, score): the `top` leaves of each tree with the best mean score of their path."""
    parents = messages.filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    walk = messages.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("node"), F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("length"))
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select("tree", "node", "up", "gain")
        walk = walk.join(step, ["tree", "node"], "left").select("tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("sum") + F.coalesce("gain", F.lit(0.0))).alias("sum"), (F.col("length") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("length"))
    last = walk.join(messages.select("tree", "node", "score"), ["tree", "node"])
    scored = last.select("tree", "leaf", ((F.col("sum") + F.col("score")) / F.col("length")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return common.settle(scored.withColumn("rank", rank).filter(F.col("rank") <= top), "leaves")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, score, rank, node, height): the nodes of the chosen root-to-leaf paths; height counts from the leaf."""
    jumps = jump_tables(messages)
    leaves = ranked_leaves(messages, jumps, top)
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for k, step in enumerate(jumps):
        further = paths.join(step.select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        paths = common.settle(paths.unionByName(further), "paths")
    return paths.join(leaves, ["tree", "leaf"])


FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


@pandas_udf(FORMATTED)
def render_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [render(list(zip(roles, texts, strict=True))) for roles, texts in zip(batch["roles"], batch["texts"], strict=True)]
        yield pd.DataFrame({"formatted": [x for x, _ in done], "loss_spans": [[list(s) for s in y] for _, y in done]})


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, score, formatted, loss_spans) of each tree's `top` paths. messages: tree, node, parent, role, text, score."""
    messages = common.settle(messages, "messages")
    turns = best_paths(messages, top).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    grouped = turns.groupBy("tree", "leaf").agg(F.max(F.col("rank")).alias("rank"), F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("at"), "role", "text"))).alias("turns"))
    both = F.struct(F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    return grouped.select("tree", "leaf", "rank", render_turns(both).alias("chat")).select("tree", "leaf", "rank", "chat.*")


DIGEST = T.StructType([T.StructField(c, T.LongType() if c in ("n_turns", "loss_chars", "formatted_chars") else T.StringType()) for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])


@pandas_udf(DIGEST)
def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for batch in batches:
        rows = []
        for text, spans in zip(batch["formatted"], batch["loss_spans"], strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[a:b]) for a, b in spans)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        yield pd.DataFrame(rows, columns=[f.name for f in DIGEST.fields])


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA, rows.schema))
    chats = format_trees(conversation_messages(rows))
    conv = F.when(F.col("tree") != "null", F.expr("substring(tree, 2)")).cast(rows.schema["conv_id"].dataType)
    return chats.select(conv.alias("conv_id"), digest(F.struct("formatted", "loss_spans")).alias("d")).select("conv_id", "d.*")


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || regexp_replace(role, '([\\<#:])', '\\\1', 'g') || ': ' || regexp_replace(text, '([\\<#])', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
