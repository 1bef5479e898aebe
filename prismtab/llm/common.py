"""Word counts, tables kept in the shared folder, running totals, bit tables and components over whole tables."""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from prismtab.session import ensure_checkpoint_dir

#: Fixed values of the word rule: a word is a run of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
BATCH_BYTES = 8 << 20
BLOOM_BITS = 1 << 27
U = np.uint64
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as 0. One letter stands for each word, so that no array is built."""
    return F.coalesce(F.length(F.rtrim(F.regexp_replace(text, WORD, "x"), F.lit(SPACES))), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds by bytes, since a batch counted in rows may hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """A session setting that holds for what runs inside, and goes back to what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, or the test folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        ensure_checkpoint_dir(spark)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/prismtab-llm"


def stored(df: DataFrame) -> DataFrame:
    """Written once as Parquet in the shared folder and read back: the lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with setting(spark, CLEAN_SHUFFLES, True):  # shuffle files of this write go when it ends, not when the driver collects garbage
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by `stored`, once all that reads them has been written."""
    for df in tables:
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def running_totals(df: DataFrame, order: list[str], values: dict[str, Column | str]) -> DataFrame:
    """Adds one column for each entry of `values`: its total over all rows that come before in `order`.

    Rows are dealt into ranges of the whole order, so a hot key is cut into several ranges. Only one
    row for each range goes to the driver. Rows that are equal in `order` are told apart by an extra
    number, so they can be cut too.
    """
    keys = [*order, "_tie"]
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .withColumns({f"_v_{name}": value if isinstance(value, Column) else F.col(value) for name, value in values.items()})
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )
    kept = stored(ranged)
    sums = sorted(kept.groupBy("_range").agg(*(F.sum(f"_v_{name}").alias(name) for name in values)).collect())
    starts, so_far = [], dict.fromkeys(values, 0)
    for row in sums:
        starts.append((row["_range"], *(so_far[name] for name in values)))
        so_far = {name: so_far[name] + (row[name] or 0) for name in values}
    schema = "_range int, " + ", ".join(f"_s_{name} long" for name in values)
    before = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.join(df.sparkSession.createDataFrame(starts, schema), "_range")
        .withColumns({name: F.col(f"_s_{name}") + F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)) for name in values})
        .drop("_tie", "_range", "_place", *(f"_v_{name}" for name in values), *(f"_s_{name}" for name in values))
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node it can reach.

    Each round takes the smallest label around a node and then the label of that label, so the
    distance covered doubles. Aggregates combine before the shuffle; a hub costs one row per task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        around = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")))
        lower = (labels.join(around, labels.node == around.a, "left")
                 .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = (lower.join(up, lower.label == up._n, "left")
                  .select("node", "was", F.least("label", "_l").alias("label")))
        new = stored(jumped)
        changed = new.where("was <> label").limit(1).count()
        forget(labels)
        labels = new.select("node", "label")
        if not changed:
            forget(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def bloom(rows: DataFrame, column: str = "k1") -> np.ndarray:
    """A bit for each value of a column of hashes, in a table of fixed size; it saves work and decides nothing."""
    place = f"pmod({column}, {BLOOM_BITS}L)"
    words = (rows.selectExpr(f"{place} div 64 AS w", f"shiftleft(1L, cast({place} % 64 AS int)) AS b").groupBy("w")
             .agg(F.bit_or("b").alias("b")).toArrow())  # at most BLOOM_BITS / 64 rows; never as Python objects
    bits = np.zeros(BLOOM_BITS // 64, U)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(U)
    return bits


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values % BLOOM_BITS
    return (bits[place >> 6] >> (place & 63).astype(U) & U(1)).astype(bool)


def parted(rows: DataFrame, hashed: Column, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash may be in a column of `wanted`, and those whose hash is not, so that a join with few
    of the rows shuffles those alone and not every text. The former are stored, so that no task of a later step
    runs two Python workers at once."""
    held = rows.sparkSession.sparkContext.broadcast(bloom(wanted, column))

    @F.arrow_udf(BooleanType())
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(marked(held.value, hashes.to_numpy(zero_copy_only=False)))

    found = may(hashed)
    return stored(rows.where(found)), rows.where(~found)


def total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)
