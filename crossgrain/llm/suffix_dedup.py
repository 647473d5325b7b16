"""Removes repeated passages by sorting suffixes, over a corpus of any size.

A byte is removed if a ``length``-byte string that covers it also starts earlier:
in a text of a smaller id, or earlier in the same text. All strings are judged on
the input.

1. Texts are cut into stretches (``stretches``): equal strings lie in stretches
   that share an anchor. Only fingerprints of stretches are dealt out, by anchor;
   a task first sets apart the stretches that repeat within its own rows.
2. Of stretches that are equal, all but the first are covered whole. Stretches
   that share an anchor with different ones go on, the others are done.
3. The bytes of those form shards of whole anchors, as large as ``shard`` allows,
   and every shard is sorted by external induced sorting (``induced``). Suffixes
   next to each other with ``length`` common bytes are one string; all places but
   its first are covered. A shard larger than ``shard``, of one very frequent
   anchor, is sorted with its queues on disk.
4. Covered ranges go back to their texts.

Defined cases: null is the empty text, which like any text of fewer bytes than
``length`` loses nothing. Ids may be of any kind that has an order. They are to be
distinct; where they are not, or are null, rows are ordered by id (null first) and
the SHA-256 of their texts, and equal rows are one document whose result each of
them gets. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from crossgrain.llm.common import keyed, named, read_table, spread, written
from crossgrain.llm.induced import common_prefix, suffix_array
from crossgrain.llm.stretches import stretches

SEED_LENGTH = 32
SHARD = 6 << 20
#: Stretches of a task's rows that are compared with each other before they are dealt out.
COMBINED = 400_000


def _fingerprints(docs: DataFrame, length: int) -> DataFrame:
    """(done, key, content, doc, start, n): stretches of ``docs(doc, data)``; ``done`` ones repeat an earlier one of the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def combined() -> pa.RecordBatch:
            key, content, doc, start, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((start, doc, content, key))
            key, content, doc, start, n = (x[order] for x in (key, content, doc, start, n))
            done = np.concatenate([[False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])])
            key = np.where(done, doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.view(np.uint64), key)  # these need no partner: deal them evenly
            return pa.record_batch([pa.array(done), *(pa.array(x.view(np.int64)) for x in (key, content, doc)), pa.array(start), pa.array(n.astype(np.int32))], names=["done", "key", "content", "doc", "start", "n"])

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not data or len(data) < length:
                    continue
                key, start, n = stretches(np.frombuffer(data, np.uint8), length, SEED_LENGTH)
                digest = xxhash.xxh3_64_digest
                content = np.frombuffer(b"".join([digest(data[a : a + m + length - 1]) for a, m in zip(start.tolist(), n.tolist())]), ">u8").astype(np.uint64)
                held.append((key, content, np.full(len(key), doc, np.int64), start, n))
                size += len(key)
                if size >= COMBINED:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    return docs.mapInArrow(run, "done boolean, key long, content long, doc long, start long, n int")


def _paired(prints: DataFrame) -> DataFrame:
    """(done, key, doc, start, n): repeated stretches (done), and first ones of keys with different contents."""
    dealt = prints.repartition(spread(prints.sparkSession), "key").sortWithinPartitions("done", "key", "content", "doc", "start")
    names = ["done", "key", "doc", "start", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the latest first stretch: (key, content, doc, start, n, already given)
        for batch in batches:
            done = batch.column(0).to_numpy(zero_copy_only=False)
            if done.any():
                rows = batch.filter(batch.column(0))
                yield rows.select(names)
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            key, content, doc, start, n = (c.to_numpy() for c in batch.columns[1:])
            before = np.concatenate([[not (last and last[0] == key[0] and last[1] == content[0])], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
            if not before.all():
                again = ~before
                yield pa.record_batch([pa.array(np.ones(again.sum(), bool)), *(pa.array(x[again]) for x in (key, doc, start, n))], names=names)
            if not before.any():
                continue
            firsts = [x[before] for x in (key, content, doc, start, n)]
            given = np.zeros(len(firsts[0]), bool)
            if last:
                firsts = [np.concatenate([[a], x]).astype(x.dtype) for a, x in zip(last, firsts)]
                given = np.concatenate([[last[5]], given])
            same = firsts[0][1:] == firsts[0][:-1]
            mixed = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            give = mixed & ~given
            if give.any():
                yield pa.record_batch([pa.array(np.zeros(give.sum(), bool)), *(pa.array(firsts[i][give]) for i in (0, 2, 3, 4))], names=names)
            last = (*(x[-1] for x in firsts), bool(mixed[-1] or given[-1]))

    return dealt.mapInArrow(run, "done boolean, key long, doc long, start long, n int")


def _bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, doc, start, data) of the stretches ``wanted(key, doc, start, n)``."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "n")).alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for doc, data, asked in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    rows += [(s["key"], doc, s["start"], data[s["start"] : s["start"] + s["n"] + length - 1]) for s in asked]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "doc", "start", "data"])

    return docs.join(asked, "doc").select("doc", "data", "asked").mapInArrow(run, "key long, doc long, start long, data binary")


def sorted_repeats(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(doc, start, end) of what is covered in one shard of (doc, start, bytes)."""
    sizes = np.array([len(d) for _, _, d in rows], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(b"\xff".join([d for _, _, d in rows]) + b"\xff", np.uint8).astype(np.uint16) + 2
    text[begins + sizes] = 1  # between stretches
    text = np.append(text, 0).astype(np.uint16)
    order, words = suffix_array(text, 258, length)
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    owner = np.append(owner, len(rows) - 1)
    whole = begins[owner] + sizes[owner] - np.arange(len(text)) >= length  # ``length`` bytes of the stretch are left
    order = order[whole[order]]
    if len(order) < 2:
        return []
    alike = common_prefix(words, order[:-1], order[1:], length) >= length
    string = np.concatenate([[0], np.cumsum(~alike)])
    docs, starts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    of = owner[order]
    doc, start = docs[of], starts[of] + order - begins[of]
    rank = np.lexsort((start, doc, string))
    first = np.concatenate([[True], string[rank][1:] != string[rank][:-1]])
    again = rank[~first]
    if not len(again):
        return []
    again = again[np.lexsort((start[again], doc[again]))]
    doc, start = doc[again], start[again]
    breaks = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)])
    ends = np.append(np.nonzero(breaks)[0][1:] - 1, len(doc) - 1)
    return list(zip(doc[breaks].tolist(), start[breaks].tolist(), (start[ends] + length).tolist()))


def _sorted(stretches_: DataFrame, length: int, shard: int) -> DataFrame:
    """(doc, start, end): what suffix sorting finds covered, shard by shard."""
    dealt = stretches_.repartition(spread(stretches_.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def covered(rows: list) -> pa.RecordBatch:
            found = sorted_repeats(rows, length)
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc", "start", "end"])

        rows, size, last = [], 0, None
        for batch in batches:
            for key, doc, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= shard:
                    yield covered(rows)
                    rows, size = [], 0
                last = key
                rows.append((doc, start, data))
                size += len(data) + 1
        if rows:
            yield covered(rows)

    return dealt.mapInArrow(run, "doc long, start long, end long")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """The small rows with a distinct long ``doc`` in their order: ranges are ordered each, and numbered on from the ranges before."""
    parts = rows.repartitionByRange(spread(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(parts.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id() % (1 << 33)}), "ordered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("doc", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs(doc_id, data)`` with a long ``doc`` in the order of ids, and what names a document: its id, or its id and its text's hash.

    Whole numbers that are distinct are taken as they are. Other distinct ids are numbered; where ids repeat or are null,
    ids with their texts' hashes are. Texts themselves are never ordered.
    """
    kind = docs.schema["doc_id"].dataType
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        if isinstance(kind, IntegralType):
            return docs.withColumn("doc", F.col("doc_id").cast("long")), ["doc_id"]
        names = _ranked(docs.select("doc_id"), [F.col("doc_id")])
        return docs.join(names, "doc_id"), ["doc_id"]
    hashed = docs.withColumn("h", F.sha2("data", 256))
    names = written(_ranked(hashed.select("doc_id", "h").distinct(), [F.col("doc_id").asc_nulls_first(), F.col("h")]), "named").withColumnRenamed("doc_id", "id").withColumnRenamed("h", "_h")
    return hashed.join(names, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("_h"))).select("doc_id", "data", "doc"), ["doc_id", "h"]


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard: int = SHARD) -> DataFrame:
    """(doc_id, data, spans): every row's bytes and its covered byte ranges, disjoint and in order."""
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("binary"), F.lit(b"")).alias("data"))
    numbered, keys = _numbered(rows)
    texts = numbered.select("doc", "data") if len(keys) == 1 else numbered.groupBy("doc").agg(F.first("data").alias("data"))
    paired = written(_paired(_fingerprints(texts, length)), "paired")
    compare = _bytes_of(texts, paired.where("not done").drop("done"), length)
    covered = paired.where("done").select("doc", "start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("end")).union(_sorted(compare, length, shard))
    covered = written(covered.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "covered")
    found = numbered.join(covered, "doc", "left").select("doc_id", "data", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in batch.column(2).to_pylist():
                out: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in row or ()):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(b, out[-1][1])
                    else:
                        out.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in out])
            yield pa.record_batch([*batch.columns[:2], pa.array(spans, kind)], names=["doc_id", "data", "spans"])

    return found.mapInArrow(run, keyed("doc_id", rows.schema["doc_id"].dataType, "data binary, spans array<struct<start:long,end:long>>"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_passages(read_table(spark, sf_dir, "documents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, at = hashlib.sha256(), 0
                for s in spans:
                    kept.update(data[at : s["start"]])
                    at = s["end"]
                kept.update(data[at:])
                rows.append((len(data), sum(s["end"] - s["start"] for s in spans), len(spans), kept.hexdigest()))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = found.schema["doc_id"].dataType
    return found.mapInArrow(run, keyed("doc_id", kind, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
