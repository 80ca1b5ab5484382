"""Chat conversations from reply trees.

Messages (node, parent, role, text, score) form trees. Jumps to the ancestor 1, 2, 4, ... messages above
are found by joining the jump table with itself, so a tree of depth d takes log2(d) joins. With them the
path of every leaf is scored, branches of a tree are ranked by their summed score, and the chosen paths
are spelled out, one row per message, and formatted as one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. In roles and texts a ``<|`` gets one more
backslash between its two characters (``<\\|`` becomes ``<\\\\|``), which unescaping takes away again;
in roles, backslashes are doubled and line feeds written ``\\n`` first. The loss mask is a list of spans
(start, end in characters of the formatted text) over the texts of the assistant.

Defined cases: NULL roles and texts are empty, NULL scores 0; of rows with the same node one is used; a
parent that isn't there makes its message a root; messages on a cycle belong to no conversation; ties in
score go to the smaller leaf; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.shared import plain, workspace

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


class Paths:
    """Jump tables of a forest (node, parent): ancestors at distance 1, 2, 4, ... with the scores passed."""

    def __init__(self, nodes: DataFrame, ws):
        self.ws = ws
        parents = nodes.select(F.col("node").alias("parent"))
        # the score of a jump is that of the messages it leaves, the start included
        first = nodes.where("parent is not null").join(parents, "parent", "left_semi").select("node", F.col("parent").alias("up"), "score")
        self.jumps: list[DataFrame] = []
        jump, most = ws.write(first, "jump0"), nodes.count()
        while len(self.jumps) < 62 and 1 << len(self.jumps) <= most and not jump.isEmpty():
            self.jumps.append(jump)
            then = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"))
            twice = jump.join(then, "up").select("node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"))
            jump = ws.write(twice, f"jump{len(self.jumps)}")

    def climb(self, rows: DataFrame) -> DataFrame:
        """rows (leaf, score): add the root, the messages on the way and the sum of their scores but the root's."""
        rows = rows.select("leaf", F.col("leaf").alias("at"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("total"))
        for k in reversed(range(len(self.jumps))):
            step = self.jumps[k].select(F.col("node").alias("at"), "up", F.col("score").alias("s"))
            rows = rows.join(step, "at", "left").select(
                "leaf", F.coalesce("up", "at").alias("at"),
                (F.col("n") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("n"),
                (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total"),
            )
        return rows.withColumnRenamed("at", "root")

    def spell(self, leaves: DataFrame) -> DataFrame:
        """(leaf, node, above): every message of each leaf's path, above counted from the leaf."""
        rows = self.ws.write(leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above")), "path")
        for k in reversed(range(len(self.jumps))):
            more = rows.join(self.jumps[k].select("node", "up"), "node").select("leaf", F.col("up").alias("node"), F.col("above") + F.lit(1 << k))
            rows = self.ws.write(rows.union(more), "path")
        return rows


def format_branches(
    messages: DataFrame, best: int | None = None, node: str = "node", parent: str = "parent", role: str = "role",
    text: str = "text", score: str | None = "score",
) -> DataFrame:
    """(leaf, root, branch, score, n_turns, formatted, spans): the ``best`` branches of each tree, all if None."""
    ws = workspace(messages.sparkSession, "replies")
    own = plain(messages, node=node, parent=parent, role=role, text=text, score=F.lit(0.0) if score is None else score)
    own = own.where("node is not null").dropDuplicates(["node"])
    own = ws.write(own.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0))), "messages")
    links = own.select("node", "parent", "score")
    paths = Paths(links, ws)
    leaves = links.join(links.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    ends = paths.climb(leaves.select(F.col("node").alias("leaf"), "score"))
    tops = links.join(paths.jumps[0].select("node"), "node", "left_anti") if paths.jumps else links
    ranked = ends.join(tops.select(F.col("node").alias("root"), F.col("score").alias("last")), "root").select(
        "leaf", "root", "n", (F.col("total") + F.col("last")).alias("score")
    )
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "leaf"))
    ranked = ranked.withColumn("branch", place)
    chosen = ws.write(ranked if best is None else ranked.where(F.col("branch") <= best), "chosen")
    rows = paths.spell(chosen).join(own.select("node", "role", "text"), "node")
    said, by = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape_role(by), F.lit("\n"))
    rows = rows.select("leaf", "above", (by == ASSISTANT).alias("learn"), head.alias("head"), escape(said).alias("body"))
    piece = F.concat("head", "body", F.lit(END + "\n"))
    before = Window.partitionBy("leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END) + 1).over(before), F.lit(0)) + F.length("head")
    rows = rows.select("leaf", (-F.col("above")).alias("place"), "learn", piece.alias("piece"), begin.alias("start"), (begin + F.length("body")).alias("end"))
    made = rows.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "learn", "start", "end"))).alias("m")).select(
        "leaf", F.array_join("m.piece", "").alias("formatted"),
        F.transform(F.filter("m", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["end"])).alias("spans"),
    )
    return made.join(chosen, "leaf").select("leaf", "root", "branch", "score", F.col("n").alias("n_turns"), "formatted", "spans")


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted conversation: an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(parts, "")
