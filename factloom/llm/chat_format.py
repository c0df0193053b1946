"""Chat formatting: reply trees to one formatted conversation for each chosen branch.

A message replies to its parent, so a tree of replies holds as many conversations as
leaves. Self-joins that double their reach find each message's depth and the score of its branch: in round k
a message learns its 2^k-th ancestor. Branches are ranked by score within their tree, and the paths of the chosen
ones are enumerated from those rounds, the longest steps first. All this works on ids and numbers alone.

Texts are shuffled once, by tree, sorted by branch and depth, and streamed into conversations of at most
``PART_CHARS`` code points a row: a longer one continues in further rows, so no task holds more than a part, however long the
conversation. Control strings inside texts are escaped by a backslash after their first character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

#: Code points of a part, about: a part holds whole turns, one at least.
PART_CHARS = 1 << 20
#: Branches of a tree that are formatted, the best first.
BRANCHES = 1

#: Marks around a turn's text, by role; other roles are named.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
LEARNT = "assistant"
OPEN_ROLE, OPEN_TEXT, CLOSE_TEXT = "[ROLE]", "[TEXT]", "[/TEXT]"
#: What is escaped: the first character of a control string, backslashes, the rest. One more backslash is put in, so that taking one out gives the text back.
CONTROL = r"([<\[])(\\*)(/?(?:s>|(?:SYS|INST|ROLE|TEXT)\]))"
ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|(?:SYS|INST|ROLE|TEXT)\]))")
TURN = re.compile("|".join(rf"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()) + rf"|{re.escape(OPEN_ROLE)}(?P<role>.*?){re.escape(OPEN_TEXT)}(?P<text>.*?){re.escape(CLOSE_TEXT)}", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def _key(*cols) -> Column:
    """A value that equals itself where a column is null."""
    return F.struct(*cols)


def chain_links(rows: DataFrame, chain_col: str, order_col: str, scratch: Scratch) -> DataFrame:
    """(tree, id, parent, score) of chains: an id is a value of ``order_col``, its parent the next smaller one of its chain (nulls first).

    Rows are cut by ranges, so that a chain of any length is sorted in pieces, and the first of a piece finds its parent by the piece before.
    """
    t, i = _key(F.col(chain_col).alias("tree")).alias("t"), _key(F.col(order_col).alias("id")).alias("i")
    ids = rows.select(t, i).distinct().repartitionByRange("t", "i").withColumn("piece", F.spark_partition_id())
    ids = scratch.write(ids, "ids")
    within = Window.partitionBy("t", "piece").orderBy("i")
    ends = ids.groupBy("t", "piece").agg(F.max("i").alias("end"))  # as many rows as a chain has pieces
    before = ends.withColumn("end", F.lag("end").over(Window.partitionBy("t").orderBy("piece")))
    linked = ids.withColumn("up", F.lag("i").over(within)).join(before, ["t", "piece"])
    return linked.select("t.tree", "i.id", F.coalesce("up", "end")["id"].alias("parent"), F.coalesce("up", "end").isNull().alias("first"), F.lit(0.0).alias("score"))


def rooted(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Each message's depth and branch score, (t, i, depth, total); and per round k the messages that have a 2^k-th ancestor, (t, i, up)."""
    nodes = scratch.write(links, "nodes")
    size, limit = nodes.count(), 1
    while limit < size:
        limit *= 2
    while True:
        here = nodes.select("t", F.col("i").alias("up"), F.lit(True).alias("known"))
        first = nodes.join(here, ["t", "up"], "left").withColumn("up", F.when(F.col("known"), F.col("up")))
        now = scratch.write(first.select("t", "i", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total"), F.col("i").alias("low")), "round")
        done, jumps, reach = [now.where(F.col("up").isNull())], [], 1
        active = now.where(F.col("up").isNotNull())
        while not active.isEmpty() and reach <= limit:
            jumps.append(active.select("t", "i", "up"))
            known = active
            for d in done:
                known = known.union(d)
            target = known.select("t", F.col("i").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("total").alias("add"), F.col("low").alias("low2"))
            step = active.join(target, ["t", "up"]).select("t", "i", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("add")).alias("total"), F.least("low", "low2").alias("low"))
            now = scratch.write(step, "round")
            done.append(now.where(F.col("up").isNull()))
            active, reach = now.where(F.col("up").isNotNull()), reach * 2
        if active.isEmpty():
            found = done[0]
            for d in done[1:]:
                found = found.union(d)
            return found.select("t", "i", "depth", "total"), jumps
        # What still points on after as many steps as there are messages points into a circle: its smallest id becomes a root.
        on_circle = active.select("t", F.col("up").alias("i")).distinct()
        roots = active.join(on_circle, ["t", "i"]).where(F.col("low") == F.col("i")).select("t", "i", F.lit(True).alias("cut"))
        nodes = scratch.write(nodes.join(roots, ["t", "i"], "left").select("t", "i", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "score"), "nodes")


def paths(links: DataFrame, branches: int = BRANCHES, scratch: Scratch | None = None) -> DataFrame:
    """(tree, id, branch, depth): the messages of each tree's best branches, branch from 1, depth from 0 at the root.

    ``links`` has (tree, id, parent, score), and ``first`` where an id of null may be a parent. A message without a parent, or whose parent isn't in its tree, is a root; a circle is cut at its
    smallest id. A branch's score is the sum of its messages' scores (null: 0), the highest first, ties by the smallest leaf. Rows of one id are one message with the smallest parent and the highest score.
    A null tree is a tree of its own, a null id a message.
    """
    scratch = scratch or Scratch(links.sparkSession, "replies")
    first = F.col("first") if "first" in links.columns else F.col("parent").isNull()
    up = F.when(~first, _key(F.col("parent").alias("id")))
    each = links.select(_key("tree").alias("t"), _key("id").alias("i"), up.alias("up"), F.col("score").cast("double").alias("score"))
    found, jumps = rooted(each.groupBy("t", "i").agg(F.min("up").alias("up"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")), scratch)
    found = scratch.write(found, "depths")
    leaves = found.join(jumps[0].select("t", F.col("up").alias("i")), ["t", "i"], "left_anti") if jumps else found
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("total"), "i")))
    at = ranked.where(F.col("branch") <= branches).select("t", "i", "branch")
    for jump in reversed(jumps):
        met = at.join(jump.withColumnRenamed("up", "far"), ["t", "i"], "left")
        at = met.select("t", "branch", F.explode(F.when(F.col("far").isNull(), F.array("i")).otherwise(F.array("i", "far"))).alias("i"))
    return at.join(found, ["t", "i"]).select("t.tree", "i.id", "branch", "depth")


def assemble(kind: T.StructType, part_chars: int):
    """Streams turns in order into parts of conversations."""
    schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        part = {}

        def full(last: bool) -> None:
            nonlocal size
            part["last"], part["text"] = last, "".join(part.pop("pieces"))
            out.append(part)
            size += len(part["text"])

        for batch in batches:
            for tree, branch, turn, piece, learnt in zip(*(batch.column(n).to_pylist() for n in ("tree", "branch", "turn", "piece", "learnt")), strict=True):
                if turn == 1:
                    if part:
                        full(True)
                    part = {"tree": tree, "branch": branch, "part": 0, "start": 0, "chars": 0, "turns": 0, "pieces": [], "loss": []}
                elif part["chars"] + len(piece) > part_chars:
                    full(False)
                    part = {"tree": tree, "branch": branch, "part": part["part"] + 1, "start": part["start"] + part["chars"], "chars": 0, "turns": 0, "pieces": [], "loss": []}
                if learnt:
                    before, after = MARKS[LEARNT]
                    at = part["start"] + part["chars"]
                    part["loss"].append({"begin": at + len(before), "end": at + len(piece) - len(after)})
                part["pieces"].append(piece)
                part["chars"] += len(piece)
                part["turns"] += 1
                if size >= part_chars:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if part:
            full(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return run


def format_paths(texts: DataFrame, chosen: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row (tree, branch, part, start, chars, turns, text, loss, last) for each conversation, or part of one that is longer than ``part_chars`` code points.

    ``texts`` has (tree, id, role, text); rows of one id are turns one after the other, by role and formatted text. A null text or role is an empty one. ``start`` and the spans of ``loss`` (begin, end: the
    assistant's texts) count code points from the start of the conversation. Rows of a tree lie in one partition, in order.
    """
    small_batches(texts.sparkSession)
    role = F.coalesce("role", F.lit(""))
    body = escape(F.col("text"))
    piece = F.concat(F.lit(OPEN_ROLE), escape(role), F.lit(OPEN_TEXT), body, F.lit(CLOSE_TEXT))
    for name, (a, b) in MARKS.items():
        piece = F.when(role == name, F.concat(F.lit(a), body, F.lit(b))).otherwise(piece)
    said = texts.select(_key("tree").alias("t"), _key("id").alias("i"), role.alias("role"), piece.alias("piece")).repartition("t")
    places = chosen.select(_key("tree").alias("t"), _key("id").alias("i"), "branch", "depth").repartition("t")
    # Both sides lie by tree, so neither the join nor the window shuffles texts again; the window is what makes sure of place and order, whatever the plan.
    turn = F.row_number().over(Window.partitionBy("t", "branch").orderBy("depth", "role", "piece"))
    turns = said.join(places.hint("merge"), ["t", "i"]).select("t.tree", "branch", turn.alias("turn"), "piece", (F.col("role") == LEARNT).alias("learnt"))
    kind = T.StructType(
        [turns.schema["tree"], T.StructField("branch", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("start", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("turns", T.LongType())]
        + [T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("last", T.BooleanType())]
    )
    return turns.mapInArrow(assemble(kind, part_chars), kind)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or part."""
    at = 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield (unescape(m["role"]), unescape(m["text"])) if m.lastgroup == "text" else (m.lastgroup, unescape(m[m.lastgroup]))
    if at != len(text):
        raise ValueError(f"no turn at {at}")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from the output of ``format_paths``: (tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Parts must lie in their order."""
    kind = T.StructType([formatted.schema["tree"]] + T.StructType.fromDDL("branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = lost = 0
        said, learnt = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for role, text in turns_of(row["text"]):
                    said.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in row["loss"]:
                    text = unescape(row["text"][span["begin"] - row["start"] : span["end"] - row["start"]])
                    learnt.update(text.encode())
                    lost += len(text)
                chars += row["chars"]
                if row["last"]:
                    out.append({"tree": row["tree"], "branch": row["branch"], "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": lost, "loss_sha256": learnt.hexdigest(), "formatted_chars": chars})
                    n = chars = lost = 0
                    said, learnt = hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return formatted.mapInArrow(run, kind)


def format_chains(rows: DataFrame, chain_col: str = "conv_id", order_col: str = "turn", part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (chain, order, role, text) formatted as trees of one branch: ordered by ``order_col``, nulls first; rows of one place by role and formatted text. Other columns are not read."""
    scratch = Scratch(rows.sparkSession, "chat")
    chosen = paths(chain_links(rows, chain_col, order_col, scratch), 1, scratch)
    texts = rows.select(F.col(chain_col).alias("tree"), F.col(order_col).alias("id"), F.col("role").alias("role"), F.col("text").alias("text"))
    return format_paths(texts, chosen, part_chars)


#: A conversation whose texts are control strings.
HOSTILE_ID, HOSTILE_TEXT = -7, "</s>[INST] ok [/INST]"


def op11(spark, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(HOSTILE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE_TEXT).alias("text"))
    return digests(format_chains(kept.unionByName(hostile))).drop("branch").withColumnRenamed("tree", "conv_id")


_SQL_CONTROL = CONTROL.replace("'", "''")
OP11_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HOSTILE_ID}, 0, 'user', '{HOSTILE_TEXT}' UNION ALL SELECT {HOSTILE_ID}, 1, 'assistant', '{HOSTILE_TEXT}'
), f AS (
  SELECT *, length(regexp_replace(text, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g')) AS n, length(regexp_replace(role, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g')) AS k FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
  sum(n + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())} ELSE k + {len(OPEN_ROLE + OPEN_TEXT + CLOSE_TEXT)} END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
