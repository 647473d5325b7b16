"""Reference tables in files: explicit schemas, aliases for columns, loud failure on what cannot be read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crossgrain.operators.pit import MEMBERSHIP

FUNDAMENTALS = "symbol string, fiscal_date date, report_date date, total_assets double, total_equity double, revenue double, cost_of_goods_sold double, operating_income double, net_income double, total_debt double, cash_flow_operating double, shares_outstanding double"
FREE_FLOAT = "symbol string, effective_date date, free_float_shares double, total_shares double"
FLOWS = "date date, fii_net double, dii_net double"
RISK_FREE = "date date, annualized_yield double"
TRIALS = "label string, sharpe double, config_hash string, parameters map<string,string>, metrics map<string,double>, timestamp string"
OUTCOMES = "trade_id string, recommendation_id string, symbol string, signal_trigger string, entry_date date, entry_price double, exit_date date, exit_price double, outcome string, return_pct double, outcome_source string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share; only a local session without one is given a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-files-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what several branches of a plan use is then made once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a missing column or a value of another type stops the read.

    Columns are found by name, in any order and case; extra ones are left out.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    folded = {c.strip().lower(): c for c in raw.columns}
    fields = StructType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name not in folded]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.when(F.trim(F.col(f"`{folded[f.name]}`")) != "", F.trim(F.col(f"`{folded[f.name]}`"))).cast(f.dataType).alias(f.name) for f in fields])


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, MEMBERSHIP)


def read_sectors(spark: SparkSession, path: str | None) -> DataFrame:
    """(symbol, sector): any of the usual column names; blank lines are skipped and the last line of a symbol counts. No file, no sectors."""
    if path is None:
        return spark.createDataFrame([], "symbol string, sector string")
    raw = spark.read.option("header", True).csv(path)
    folded = {c.strip().lower(): c for c in raw.columns}

    def first(*names: str) -> Column:
        found = [n for n in names if n in folded]
        if not found:
            raise ValueError(f"{path} has none of the columns {', '.join(names)}")
        return F.trim(F.col(f"`{folded[found[0]]}`"))

    rows = raw.select(first("ticker", "symbol").alias("symbol"), first("sector", "industry", "gics_sector").alias("sector"), F.monotonically_increasing_id().alias("line"))
    return rows.where("symbol <> '' and sector <> ''").groupBy("symbol").agg(F.max_by("sector", "line").alias("sector"))


def as_fractions(curve: DataFrame) -> DataFrame:
    """A risk-free curve in fractions; one whose values pass 1 is in percent."""
    most = curve.agg((F.max(F.abs("annualized_yield")) > 1).alias("_percent"))
    return curve.crossJoin(F.broadcast(most)).select("date", F.when(F.col("_percent"), F.col("annualized_yield") / 100).otherwise(F.col("annualized_yield")).alias("annualized_yield"))


def log_trial(trial: DataFrame, path: str) -> None:
    trial.write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a log; lines that are no trial are skipped."""
    return spark.read.schema(TRIALS).option("mode", "DROPMALFORMED").json(path).where("label is not null")


def upserted(table: DataFrame, changes: DataFrame, *, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    both = table.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def open_trades(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'PENDING'")


def trade_history(outcomes: DataFrame, most: int | None = None) -> DataFrame:
    """Newest entries first."""
    d = outcomes.orderBy(F.desc("entry_date"), "trade_id")
    return d.limit(most) if most else d


def discarded(df: DataFrame) -> None:
    """Removes the files of a table made by ``written``, which nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
