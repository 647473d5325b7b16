"""Near-duplicates by the Jaccard likeness of word-shingle sets, verified exactly.

Two texts are linked where their sets of ``width``-word shingles have a Jaccard
likeness of at least ``share``; a group is what links connect.

Equal sets are one class and collapse first. Candidates come from two searches.
SimHash fingerprints of the sets that differ in at most ``radius`` bits meet in the
BK-trees of ``simhash``; they find the closest copies. A pair at 0.8 differs in ten
bits of 64 on average, which no cut into few bands can find whole, so every class
also gets ``BANDS`` hashes, each of ``ROWS`` min-hashes, and classes that share one
are candidates too. A pair at a likeness of exactly 0.8 shares none with
probability 5e-6, one at 0.85 with 6e-9.

Candidates that hang together form a bundle, and only texts in bundles are
shuffled. In a small bundle a task counts the shingles that each pair has in
common. A bundle of many texts is not compared pair by pair: the ``LEADERS`` classes
with the most candidates are compared with all of it, in as many tasks as it has
blocks, and each text keeps a mask of those it is linked to. The leaders that hang
together by the masks of a bundle, of which there are a bounded number, show its
group: what is linked to one of them is settled, since one link is enough to belong
to it. A leader outside has all its links and need not be asked again. The rest look
for leaders among themselves as long as that settles half of them, and what is then
left, alone, is compared block by block with the whole bundle. So every link is exact, none is lost, and a hot group of
copies costs a few linear passes.

Defined cases: a null, empty or white text has the empty set, and these form one
group; a text of fewer than ``width`` words is one shingle; equal rows stay
separate rows of one group; a null id is kept and counts as the largest; rows may
share an id, extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crossgrain.llm.common import as_row, named, spread, unpacked, written
from crossgrain.llm.simhash import connected, local_links, majority

BANDS, ROWS = 40, 6
#: Classes that a large bundle is compared with in one pass.
LEADERS = 8
#: Texts and bytes of a block of a bundle.
BLOCK_TEXTS, BLOCK_BYTES = 2_000, 8 << 20
_FACTORS = np.random.default_rng(83).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of one text's word shingles."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a : b - 1], 42) for a, b in zip(ends, ends[min(width, len(words)) :])]), ">u8").astype(np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band; the band's number is hashed along."""
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 256):
        least = np.minimum(least, (own[at : at + 256, None] * _FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def prints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(row, doc_id, place, key, fp, bands): ``key`` names the set, ``place`` the row, whose columns are all in ``row``."""
    rows = docs.select(as_row(docs), named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, fps, found = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles((text or "").encode(), width)
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                fps.append(majority(own.astype(">u8").view(np.uint8)))
                found.append(bands(own))
            n = len(keys)
            lists = pa.ListArray.from_arrays(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32), np.concatenate([np.empty(0, np.int64), *found]))
            cols = [pa.array(np.arange(place, place + n)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64)), lists]
            yield pa.record_batch([*batch.columns[:2], *cols], names=["row", "doc_id", "place", "key", "fp", "bands"])
            place += n

    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL("place long, key long, fp long, bands array<long>").fields])
    return rows.mapInArrow(run, schema)


def bundles(classes: DataFrame, *, radius: int = 4) -> DataFrame:
    """(key, bundle) of the classes (key, fp, bands) that have a candidate."""
    dealt = classes.select("key", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = classes.groupBy("fp").agg(F.min("key").alias("low"))
    near = local_links(same.select("fp"), radius=radius).join(same, "fp").select("root", F.col("low").alias("key"))
    near = near.join(same.withColumnRenamed("fp", "root"), "root").select("key", "low")
    equal = classes.join(same, "fp").select("key", "low")
    roots = written(connected(dealt.join(shared, "band").select("key", "low").union(near).union(equal).where("key <> low").distinct(), "key", "low"), "bundles")
    return roots.select(F.col("node").alias("key"), F.col("root").alias("bundle")).union(roots.select("root", "root").distinct())


def likely(sets: list[np.ndarray], block: list[bool], apart: bool, share: float) -> Iterator[tuple[int, int]]:
    """Pairs of places whose Jaccard likeness is at least ``share``, enough of them to connect all that are linked.

    With ``apart`` only pairs of different ``block`` count.
    """
    exact = Fraction(str(share))
    over, under = exact.numerator, exact.denominator
    sizes = np.array([len(s) for s in sets])
    flags = np.array(block)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owners = owner[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))])
    ends = np.cumsum(sizes)
    group = np.arange(len(sets))
    for x in range(1, len(sets)):
        own = at[ends[x] - sizes[x] : ends[x]]
        common = np.zeros(x, np.int64)
        lengths = first[own + 1] - first[own]
        if not len(own):
            continue
        shift = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        common += np.bincount(owners[np.arange(len(shift)) + shift], minlength=len(sets))[:x]
        near = common * under >= over * (sizes[:x] + sizes[x] - common)
        if apart:
            near &= flags[:x] != flags[x]
        for y in np.nonzero(near)[0]:
            if group[x] != group[y]:
                yield x, int(y)
                group[group == group[x]] = group[y]


def _cells(rows: DataFrame, *, share: float, width: int) -> DataFrame:
    """(key, other) of the links in each cell of ``rows(bundle, low, high, asks, key, text)``; where a cell has rows that ask, those with the others, else all."""
    rows = rows.repartition(spread(rows.sparkSession), "bundle", "low", "high").sortWithinPartitions("bundle", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, cell in groupby(found, key=lambda r: r[:3]):
            keys, asks, sets = [], [], []
            for r in cell:
                asks.append(r[3])
                keys.append(r[4])
                sets.append(shingles((r[5] or "").encode(), width))
            if out := [(keys[x], keys[y]) for x, y in likely(sets, asks, any(asks), share)]:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "other"])

    return rows.select("bundle", "low", "high", "asks", "key", "text").mapInArrow(run, "key long, other long")


def _led(rows: DataFrame, *, share: float, width: int) -> DataFrame:
    """(bundle, key, mask, own, others) of ``rows(bundle, salt, lead, key, text)``: the leaders that a row without ``lead`` is linked to.

    ``mask`` has a bit for each of them, by the leader's number, and ``others`` their keys; a leader's own row is ``own`` and
    has its own bit. A salt's leaders come first; rows that no leader is like are left out.
    """
    exact = Fraction(str(share))
    over, under = exact.numerator, exact.denominator
    rows = rows.repartition(spread(rows.sparkSession), "bundle", "salt").sortWithinPartitions("bundle", "salt", F.col("lead").isNull())
    names = ["bundle", "key", "mask", "own", "others"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in batches:
            out = []
            for bundle, salt, lead, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (bundle, salt) != now:
                    now, leaders = (bundle, salt), []
                text_set = shingles((text or "").encode(), width)
                if lead is not None:
                    leaders.append((lead, key, text_set))
                    continue
                mask, own, others = 0, False, []
                for number, other, known in leaders:
                    if other == key:
                        mask, own = mask | 1 << number, True
                        continue
                    common = len(np.intersect1d(text_set, known, assume_unique=True))
                    if common * under >= over * (len(text_set) + len(known) - common):
                        mask |= 1 << number
                        others.append(other)
                if mask:
                    out.append((bundle, key, mask, own, others))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.select("bundle", "salt", "lead", "key", "text").mapInArrow(run, "bundle long, key long, mask long, own boolean, others array<long>")


def _reached(ways: Column, start: Column) -> Column:
    """All bits that hang together with ``start`` by the masks of ``ways``, an array of (n, mask) with at most one entry a mask."""
    once = lambda bits: F.aggregate(ways, bits, lambda a, w: F.when(w["mask"].bitwiseAND(a) != 0, a.bitwiseOR(w["mask"])).otherwise(a))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEADERS)), start, lambda a, _: once(a))


def degrees(members: DataFrame) -> DataFrame:
    """(key, degree) of ``members(bundle, key, bands)``: with how many of its bundle a class shares a band, counted for each band."""
    dealt = members.select("bundle", "key", F.explode("bands").alias("band"))
    sizes = dealt.groupBy("bundle", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = dealt.join(sizes, ["bundle", "band"]).groupBy("key").agg(F.sum("n").alias("degree"))
    return members.select("key").join(found, "key", "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))


def links(texts: DataFrame, members: DataFrame, *, share: float, width: int, block_texts: int) -> DataFrame:
    """(key, other) of verified links; ``members`` (key, place, bundle, bytes, bands) are the candidates among ``texts`` (place, text)."""
    sizes = members.groupBy("bundle").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_texts, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "bundle").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    nought = F.lit(0)
    small = placed.where("blocks = 1").select("bundle", "key", "place").join(texts, "place")
    all_links = [written(_cells(small.select("bundle", nought.alias("low"), nought.alias("high"), F.lit(False).alias("asks"), "key", "text"), share=share, width=width), "links")]
    large = placed.where("blocks > 1")
    left = written(large.join(degrees(large), "key").select("bundle", "key", "place", "degree", "bytes", "blocks", "block", F.lit(False).alias("led")), "large")
    waiting = left.count()
    if waiting:
        large = written(left.join(texts, "place"), "members")
    settled, first = F.lit(1 << LEADERS).cast("long"), True
    while waiting:
        turn = F.row_number().over(Window.partitionBy("bundle").orderBy(F.desc("degree"), "key"))
        chosen = left.where("not led").withColumn("_n", turn).where(F.col("_n") <= LEADERS).select("key", (F.col("_n") - 1).alias("lead"))
        leads = large.join(chosen, "key").select("bundle", F.explode(F.sequence(nought, F.col("blocks") - 1)).alias("salt"), "lead", "key", "text")
        rest = large.select("bundle", F.col("block").alias("salt"), F.lit(None).cast("int").alias("lead"), "key", "text")
        led = written(_led(leads.union(rest), share=share, width=width), "links")
        all_links.append(led.select("key", F.explode("others").alias("other")))
        # What was settled before has one more bit, so that leaders hang together by it too.
        known = led.join(left.select("key", F.lit(True).alias("waits")), "key", "left")
        known = known.withColumn("mask", F.when(F.col("waits"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(settled)))
        ways = known.groupBy("bundle", "mask").agg(F.count(F.lit(1)).alias("n")).groupBy("bundle").agg(F.collect_list(F.struct("n", "mask")).alias("ways"))
        main = ways.select("bundle", _reached(F.col("ways"), F.array_max("ways")["mask"] if first else settled).alias("main"))
        rooted = left.join(led.select("key", "mask", "own"), "key", "left").join(main, "bundle", "left")
        open_still = F.coalesce(F.col("mask").bitwiseAND(F.col("main")), F.lit(0)) == 0
        left = written(rooted.where(open_still).select("bundle", "key", "degree", "bytes", "blocks", (F.col("led") | F.coalesce("own", F.lit(False))).alias("led")), "left")
        before, waiting, first = waiting, left.where("not led").count(), False
        if 2 * waiting > before or waiting <= block_texts:
            break
    if waiting:
        left = left.where("not led")
        asking = left.groupBy("bundle").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_texts, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("askers"))
        ask = large.join(left.select("key"), "key", "left_semi").join(asking, "bundle")
        ask = ask.select("bundle", F.pmod(F.xxhash64("key", F.lit(1)), "askers").cast("int").alias("low"), F.explode(F.sequence(nought, F.col("blocks") - 1)).alias("high"), F.lit(True).alias("asks"), "key", "text")
        told = large.join(asking, "bundle").select("bundle", F.explode(F.sequence(nought, F.col("askers") - 1)).alias("low"), F.col("block").alias("high"), F.lit(False).alias("asks"), "key", "text")
        all_links.append(written(_cells(ask.union(told), share=share, width=width), "links"))
    return reduce(DataFrame.union, all_links)


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, width: int = 5, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """One row per document: (row, doc_id, key, component_id, first): ``first`` for one row of each group, that of the smallest id."""
    found = written(prints(docs, id_col=id_col, text_col=text_col, width=width), "prints")
    text = F.col("row").getField(text_col).cast("string")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    classes = written(found.groupBy("key", "fp", "bands").agg(least.alias("least"), F.min("place").alias("place"), F.min(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes")), "classes")
    members = classes.select("key", "place", "bytes", "bands").join(bundles(classes.select("key", "fp", "bands")), "key")
    roots = connected(links(found.select("place", text.alias("text")), members, share=share, width=width, block_texts=block_texts), "key", "other")
    rooted = classes.join(roots, classes.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    heads = written(rooted.join(heads, "root").select("key", "head"), "heads")
    same = F.col("place") == F.col("head.place")
    return found.select("row", "doc_id", "place", "key").join(heads, "key").select("row", "doc_id", "key", F.col("head.doc_id").alias("component_id"), same.alias("first"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, key, component_id), the smallest id reachable over links; ``options`` are those of ``grouped``."""
    return grouped(docs, **options).select("doc_id", "key", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One whole row of each group, with all columns of ``docs``; ``options`` are those of ``grouped``."""
    return unpacked(grouped(docs, **options).where("first"), docs)
