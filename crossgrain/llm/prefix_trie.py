"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn is known by a 95-bit hash of its role and text and by its text's bytes,
two numbers, so texts are never shuffled. A conversation is cut into blocks of
``width`` turns; a block is one row whose columns are its turns by position, and
whose key is the trie node that the earlier blocks lead to: the exclusive or of
128-bit hashes of all earlier (position, turn). One ``ROLLUP`` over the columns,
grouped by that key, aggregates all prefixes of all blocks together, however
long conversations are, and ``grouping_id`` tells their depths.

Nodes are named by their smallest member and depth. A conversation is the
smallest member of all nodes on its path from some depth on, so it owns one
stretch of nodes and hangs on another conversation's node above it. The first
rollup finds these stretches. What a conversation adds to the subtrees above its
stretch is then one number each (a leaf, the bytes shared), and a second rollup
sums these for every node.

No task holds a whole conversation: turns are numbered by a sort in ranges, and
running sums over blocks are made in two levels. Rows that meet at a common node
are dealt to many tasks. The members that end in a node are hashed in order:
tasks of a sorted range join them to pieces of text, and one task a node only
feeds the pieces to the hash.

Defined cases: null roles and texts are empty; a null turn comes first; turns of
one number, repeated rows too, are in order of their hashes; rows without a
conversation id belong to none and are left out; an empty table has no nodes,
not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import read_table, named, spread, spread_join, written

#: Low bits of a turn's second number: its text's bytes.
_BYTES = (1 << 31) - 1
#: Blocks to a chunk of the running sums.
_CHUNK = 1024


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, hi, lo): each conversation's turns, numbered from 0 without gaps."""
    said = [F.coalesce(named(c).cast("string"), F.lit("")) for c in (role, text)]
    low = F.shiftleft(F.xxhash64(F.lit(2), *said).bitwiseAND((1 << 32) - 1), 31).bitwiseOR(F.octet_length(said[1]).cast("long"))
    rows = conversations.where(named(conv).isNotNull()).select(named(conv).cast("long").alias("conv"), named(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("hi"), low.alias("lo"))
    order = ["conv", F.asc_nulls_first("turn"), "hi", "lo"]
    spark = conversations.sparkSession
    ranged = rows.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("conv", "hi", "lo", F.monotonically_increasing_id().alias("place")), "turns")
    # A conversation's rows in one task are a run; the runs before it say where it starts.
    run = F.shiftright("place", 33)
    runs = ranged.groupBy("conv", run.alias("run")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return written(ranged.withColumn("run", run).join(runs, ["conv", "run"]).select("conv", (F.col("place") + F.col("shift")).alias("pos"), "hi", "lo"), "numbered-turns")


def every_turn(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (conv, len), and their turns."""
    return turns.groupBy("conv").agg(F.count("*").alias("len")), turns


def grafted(turns: DataFrame, *, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, len), and (conv, pos, hi, lo).

    Conversation c begins with the first h turns of c - c % ``group`` (all of fewer, none if absent), h being crc32 of c's
    decimal text modulo ``most``; its own turns after its first h follow.
    """
    base = F.col("conv") - F.col("conv") % group
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "hi", "lo"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,hi:bigint,lo:bigint>>")), 1, F.col("h").cast("int")))
    convs = written(convs.select("conv", "h", (F.size("head") - F.col("h")).cast("long").alias("shift"), "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")), "rebuilt")
    own = spread_join(turns.where(F.col("pos") >= most - 1), convs.select("conv", "shift"), ["conv"]).select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "hi", "lo")
    near = turns.where(F.col("pos") < most - 1).join(convs.select("conv", "h", "shift"), "conv").where("pos >= h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "hi", "lo")
    return convs.select("conv", "len"), convs.select("conv", F.inline("head")).unionByName(own).unionByName(near)


def _hashes(pos: Column, hi: Column, lo: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), pos, hi, lo), F.xxhash64(F.lit(2), pos, hi, lo)


def _nodes(blocks: DataFrame, width: int, *sums: str) -> DataFrame:
    """The nodes: conv_id (the smallest member), depth, n_convs, ``before`` (bytes above the last turn), key and ``sums``.

    ``x1`` and ``x2``, the node's key, are those of its block and the hashes of its turns there.
    """
    columns = ", ".join(f"(hi{j}, lo{j})" for j in range(width))
    level = f"{width} - bit_count(grouping_id()) div 2"  # two bits a column that is rolled up
    extra = "".join(f", {s}" for s in sums)
    grouped = blocks.sparkSession.sql(
        f"SELECT block, x1, x2, {', '.join(f'hi{j}, lo{j}' for j in range(width))}, {level} AS level, count(*) AS n_convs, min(conv) AS conv_id, max(before) AS before{extra} "
        f"FROM {{blocks}} GROUP BY block, x1, x2, ROLLUP({columns})",
        blocks=blocks,
    )
    last = F.coalesce(*(F.when(F.col("level") == j + 1, F.col(f"hi{j}").isNotNull()) for j in range(width)), F.col("block") == 0)
    nodes = grouped.where(last)  # a shorter conversation has no turn there; level 0 is the block before's last node
    depth = F.col("block") * width + F.col("level")
    x1, x2, above = F.col("x1"), F.col("x2"), F.col("before")
    for j in range(width):
        a, b = _hashes(F.col("block") * width + j, F.col(f"hi{j}"), F.col(f"lo{j}"))
        x1, x2 = (F.when(F.col("level") > j, x.bitwiseXOR(h)).otherwise(x) for x, h in ((x1, a), (x2, b)))
        above = above + F.when(F.col("level") > j + 1, F.col(f"lo{j}").bitwiseAND(_BYTES)).otherwise(0)
    names = [s.split(" AS ")[1] for s in sums]
    return nodes.select("conv_id", depth.cast("long").alias("depth"), "n_convs", above.alias("before"), x1.alias("x1"), x2.alias("x2"), *names)


def _blocks(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(conv, block, x1, x2, before, hi0, lo0, ...): a row a block, and block 0 of conversations without turns."""
    pos = F.pmod("pos", F.lit(width))
    a, b = _hashes(F.col("pos"), F.col("hi"), F.col("lo"))
    cells = [F.max(F.when(pos == j, F.col(c))).alias(f"{c}{j}") for j in range(width) for c in ("hi", "lo")]
    rows = turns.groupBy("conv", F.floor(F.col("pos") / width).alias("block")).agg(F.bit_xor(a).alias("y1"), F.bit_xor(b).alias("y2"), F.sum(F.col("lo").bitwiseAND(_BYTES)).alias("bytes"), *cells)
    none = convs.where("len = 0").select("conv", F.lit(0).cast("long").alias("block"))
    rows = written(rows.unionByName(none, allowMissingColumns=True).withColumn("chunk", F.floor(F.col("block") / _CHUNK)), "blocks")
    # What comes before a block: the chunks before its own, and the blocks before it in its own.
    zero = F.lit(0).cast("long")
    within = Window.partitionBy("conv", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (("x1", F.bit_xor("y1")), ("x2", F.bit_xor("y2")), ("before", F.sum("bytes")))
    chunks = rows.groupBy("conv", "chunk").agg(*(f.alias(n) for n, f in zip(("y1", "y2", "bytes"), (F.bit_xor("y1"), F.bit_xor("y2"), F.sum("bytes")))))
    chunks = chunks.select("conv", "chunk", *(F.coalesce(f.over(across), zero).alias("c_" + n) for n, f in sums)).where("chunk > 0")
    rows = rows.select("*", *(F.coalesce(f.over(within), zero).alias(n) for n, f in sums)).join(chunks, ["conv", "chunk"], "left")
    join = [F.col("x1").bitwiseXOR(F.coalesce("c_x1", zero)).alias("x1"), F.col("x2").bitwiseXOR(F.coalesce("c_x2", zero)).alias("x2"), (F.col("before") + F.coalesce("c_before", zero)).alias("before")]
    return written(rows.select("conv", "block", *join, *(f"{c}{j}" for j in range(width) for c in ("hi", "lo"))), "keyed-blocks")


def _at(blocks: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """``convs`` with the key (x1, x2) of the node that ``a`` turns lead to, and ``shared``, the bytes up to there."""
    asked = convs.withColumn("block", F.floor(F.greatest(F.col("a") - 1, F.lit(0)) / width))
    found = asked.join(blocks, ["conv", "block"])
    x1, x2, shared = F.col("x1"), F.col("x2"), F.col("before")
    for j in range(width):
        here = F.col("block") * width + j < F.col("a")
        a, b = _hashes(F.col("block") * width + j, F.col(f"hi{j}"), F.col(f"lo{j}"))
        x1, x2 = (F.when(here, x.bitwiseXOR(h)).otherwise(x) for x, h in ((x1, a), (x2, b)))
        shared = shared + F.when(here, F.col(f"lo{j}").bitwiseAND(_BYTES)).otherwise(0)
    return found.select(*convs.columns, x1.alias("x1"), x2.alias("x2"), shared.alias("shared"))


def ends_digest(ends: DataFrame, *, piece: int = 1 << 16) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the conversations ``conv`` that end there, ascending and comma-joined."""
    spark = ends.sparkSession
    order = ["conv_id", "depth", "conv"]

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, list[str], int]] = []
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if not out or out[-1][:2] != (node, depth) or len(out[-1][3]) * 20 > piece:
                    out.append((node, depth, conv, [], 0))
                out[-1][3].append(str(conv))
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.record_batch([*cols, pa.array([",".join(r[3]) for r in out], pa.string())], names=["conv_id", "depth", "first", "ids"])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield out(done)
        if node:
            yield out([(*node, state.hexdigest())])

    def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

    pieces = ends.select(*order).repartitionByRange(spread(spark), *order).sortWithinPartitions(*order).mapInArrow(joined, "conv_id long, depth long, first long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digested, "conv_id long, depth long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, *, width: int = 8) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv, len) with their ``turns`` (conv, pos, hi, lo): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = written(convs, "conversations")
    blocks = _blocks(convs, turns, width)
    first = written(_nodes(blocks, width).select("conv_id", "depth", "x1", "x2"), "nodes")
    # A conversation owns its nodes from depth ``top`` on, and hangs on the node of ``a`` turns.
    owners = first.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("top"))
    convs = convs.join(owners, "conv", "left").withColumn("a", F.when(F.col("top").isNull(), F.col("len")).otherwise(F.col("top") - 1))
    placed = written(_at(blocks, convs, width), "places")
    named_nodes = first.select(F.col("conv_id").alias("up"), F.col("depth").alias("a"), "x1", "x2")
    hung = spread_join(placed.where("a >= 0"), named_nodes, ["a", "x1", "x2"]).select("conv", "len", "top", "a", "shared", "up")
    hung = hung.unionByName(placed.where("a < 0").select("conv", "len", "top", "a", F.lit(0).cast("long").alias("shared"), F.lit(None).cast("long").alias("up")))
    hung = written(hung, "hung")
    children = hung.where("top > 0").groupBy(F.col("up").alias("conv"), F.col("a").alias("at")).agg(F.count("*").alias("hanging"))
    ended = children.withColumnRenamed("at", "len").withColumn("parent", F.lit(True)).drop("hanging")
    hung = hung.join(ended, ["conv", "len"], "left")
    leaf = (F.col("top").isNotNull() & F.col("parent").isNull()).cast("long")
    own = hung.select("conv", "len", "top", "up", "shared", leaf.alias("leaf"))
    rows = spread_join(blocks, own, ["conv"])
    second = _nodes(rows, width, "sum(shared) AS shared", "sum(leaf) AS n_leaves", "min_by(shared, conv) AS own_shared", "min_by(up, conv) AS up", "min_by(top, conv) AS top", "min_by(len, conv) AS len")
    ends = hung.select(F.when(F.col("top").isNull(), F.col("up")).otherwise(F.col("conv")).alias("conv_id"), F.col("len").alias("depth"), "conv")
    second = second.join(children.select(F.col("conv").alias("conv_id"), F.col("at").alias("depth"), "hanging"), ["conv_id", "depth"], "left")
    second = second.join(ends_digest(ends), ["conv_id", "depth"], "left")
    return second.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs",
        ((F.col("depth") < F.col("len")).cast("long") + F.coalesce("hanging", F.lit(0))).alias("n_children"),
        "n_leaves",
        (F.col("shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(*grafted(turns_of(read_table(spark, sf_dir, "conversations"))))
