"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import crossgrain
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# Functions of this package travel to the executors with the task, so that they need no installed copy.
cloudpickle.register_pickle_by_value(crossgrain)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests) is given a temporary folder; a cluster has to name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder_is(doc_id: str | Column, modulus: int, value: int) -> Column:
    """True where crc32 of the id's text leaves ``value``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return (F.crc32(text) % modulus) == value


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions to deal keyed rows to: the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, which can be carried beside columns of any name."""
    return F.struct(*map(named, docs.columns)).alias("row")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` back from the struct ``row``, those in ``changed`` replaced."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def keyed(name: str, kind: DataType, rest: str) -> StructType:
    """The schema of a column of any kind, carried along, and those of ``rest``."""
    return StructType([StructField(name, kind), *StructType.fromDDL(rest).fields])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], *, most: int = 200_000) -> DataFrame:
    """``left`` with the one row of ``right`` for its keys, of which one may hold any share of ``left``.

    A key of more than ``most`` rows is dealt to as many tasks as its rows need, and its row of ``right`` to each of them.
    There is at most one such key for every ``most`` rows, and their list is all that is broadcast. ``left`` is to be read
    from files, so that a task that is run again numbers its rows alike.
    """
    heavy = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n")).where("_n > 1")
    dealt = left.join(F.broadcast(heavy), keys, "left").withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copied = right.join(F.broadcast(heavy), keys, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(copied, [*keys, "_s"]).drop("_s")
