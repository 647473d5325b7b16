"""Near-duplicates by 64-bit SimHash and BK-trees.

``fingerprints`` gives every text its SimHash. ``components`` links fingerprints
that differ in at most ``radius`` bits, exactly, and names each connected group.

The search works on distinct fingerprints. ``radius + 1`` bands of bits cut them
into shards: two fingerprints within the radius agree on one whole band, so they
meet in one shard. Every shard is indexed by a BK-tree, whose children are keyed
by their Hamming distance to the parent, and a look-up follows only the edges
whose key lies within the radius of the query's distance. Trees of all documents
grow with the corpus, so a tree is not sent to every executor: the shard's tree
and its queries are dealt to the same task. When there are many fingerprints the
shards are cut again on the bits outside the band (``band_levels``), so that a
shard stays small. A shard returns a spanning forest, never its pairs.

Defined cases: a null, empty or white text has fingerprint zero and is linked
like any other; equal rows stay separate rows of one group; a null id is kept
and counts as the largest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, spread, written

#: Shards of more members than this are searched with vectors, smaller ones node by node.
VECTOR_FROM = 160


def simhash(data: bytes, width: int = 4, seed: int = 42) -> bytes:
    """The 8 big-endian bytes of one text's fingerprint over word shingles, repeats included."""
    words = data.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(width, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a : b - 1], seed) for a, b in zip(ends, ends[width:])])
    return majority(np.frombuffer(hashes, np.uint8))


def majority(hashes: np.ndarray, rows: int = 1 << 16) -> bytes:
    """The bits set in over half the 8-byte hashes, which are unpacked ``rows`` at a time."""
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, rows):
        ones += np.unpackbits(hashes[at * 8 : (at + rows) * 8]).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = b"".join(simhash(x, width, seed) for x in batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    kind = docs.select(id_col).schema[0].dataType
    return rows.mapInArrow(run, keyed("doc_id", kind, "fp long"))


class BKTree:
    """Integers under Hamming distance; children keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while (nxt := self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)) != new:
                at = nxt
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            stack += [child for key, child in self.children[at].items() if -radius <= key - distance <= radius]


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct unsigned ``values``, the place of its group's first member."""
    if len(values) > VECTOR_FROM:
        return _forest_by_vectors(values, radius)
    tree, parent = BKTree(), list(range(len(values)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, value in enumerate(values.tolist()):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return np.array([top(i) for i in range(len(values))])


def _forest_by_vectors(values: np.ndarray, radius: int) -> np.ndarray:
    """The same tree, built and searched level by level for all queries of a shard at once."""
    label = np.arange(len(values))
    stack = [(label.copy(), label.copy())]  # members of a subtree, the first its root; queries that reach it
    while stack:
        members, asked = stack.pop()
        root = values[members[0]]
        far = np.bitwise_count(values[asked] ^ root).astype(np.int16)
        met = np.append(label[asked[far <= radius]], label[members[0]])
        if (low := met.min()) != met.max():
            label[np.isin(label, met)] = low
        rest = members[1:]
        keys = np.bitwise_count(values[rest] ^ root).astype(np.int16)
        for key in np.unique(keys):
            if len(q := asked[np.abs(far - key) <= radius]):
                stack.append((rest[keys == key], q))
    return label


def _band_masks(parts: int, inside: int) -> list[int]:
    """``parts`` masks of neighbouring bits that together hold all bits of ``inside``."""
    bits = [b for b in range(64) if inside >> b & 1]
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _shard_masks(radius: int, levels: int) -> list[int]:
    masks = _band_masks(radius + 1, (1 << 64) - 1)
    for _ in range(levels - 1):
        masks = [m | x for m in masks for x in _band_masks(radius + 1, ((1 << 64) - 1) & ~m)]
    return masks


def local_links(fps: DataFrame, *, radius: int = 4, band_levels: int = 1, partitions: int | None = None) -> DataFrame:
    """(fp, root): for distinct ``fp``, links to the smallest place of its group in each shard; roots have no row."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _shard_masks(radius, band_levels)]
    shards = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(shards).alias("s")).select(F.xxhash64("s.band", "s.part").alias("shard"), "s.band", "s.part", "fp")
    dealt = dealt.repartition(partitions or spread(fps.sparkSession), "shard").sortWithinPartitions("band", "part", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fp: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            sizes = np.diff(starts)
            for at in np.nonzero(sizes > 1)[0]:
                own = fp[starts[at] : starts[at + 1]]
                root = forest(own.view(np.uint64), radius)
                if (moved := root != np.arange(len(own))).any():
                    yield own[moved], own[root[moved]]

        kept: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            band, part, fp = cols
            if not len(fp):
                continue
            edges = np.nonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1]))[0] + 1
            last = edges[-1] if len(edges) else 0  # the last shard may go on in the next batch
            kept = [x[last:] for x in cols]
            for a, b in links(fp, np.concatenate([[0], edges])):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["fp", "root"])
        if kept is not None:
            for a, b in links(kept[2], np.array([0, len(kept[2])])):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["fp", "root"])

    return dealt.mapInArrow(run, "fp long, root long").distinct()


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``links`` that is not itself the smallest of its component.

    Alternates large-star and small-star steps, each written to the shared
    folder, until every component is a star around its smallest node; every step
    is joins and sums.
    """
    a, b = F.col(left), F.col(right)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    one, none = F.lit(1), F.lit(0)
    # A star forest: no node has two smaller ones, and none that has one is another's.
    while not (
        edges.select(F.col("u").alias("node"), one.alias("smaller"), none.alias("larger"))
        .union(edges.select("v", none, one))
        .groupBy("node")
        .agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
        .where("smaller > 1 or (smaller = 1 and larger = 1)")
        .isEmpty()
    ):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large, "links")  # with repeats, which the next step's distinct() drops
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).where("u <> v").distinct()
        edges = written(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(prints: DataFrame, *, radius: int = 4, small_shard: int = 4_000) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest id reachable over links of ``radius`` bits."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    levels = 1 if classes.count() < small_shard << (64 // (radius + 1)) else 2
    links = local_links(classes.select("fp"), radius=radius, band_levels=levels)
    roots = connected(links, "fp", "root")
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: (doc_id, fp, component_id)."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed), "prints")
    return components(prints, radius=radius)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
