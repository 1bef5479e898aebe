"""Running totals and ranks over a whole table, without one window that holds it.

Rows are dealt into ranges of the order, so a hot value is cut by the next order column; each range adds
up on its own, and one row for each range gives the total before it.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.operators.profile import local_frame
from prismtab.session import checkpointed


def totals_before(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """The rows with, for each entry of `totals`, its sum over all rows before them in `order` (0 for the
    first). Rows equal in `order` come in any order, so it should tell rows apart. The ranges are written once."""
    dealt = df.withColumns({f"_of_{name}": value for name, value in totals.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = checkpointed(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    sums = kept.groupBy("_range").agg(*(F.sum(f"_of_{name}").alias(name) for name in totals)).orderBy("_range").collect()  # one row per range
    kinds = {f.name: f.dataType.simpleString() for f in kept.groupBy().agg(*(F.sum(f"_of_{name}").alias(name) for name in totals)).schema.fields}
    nothing = {"double": 0.0, "bigint": 0}
    starts, so_far = [], {name: nothing.get(kind, Decimal(0)) for name, kind in kinds.items()}
    for row in sums:
        starts.append((row["_range"], *so_far.values()))
        so_far = {name: value if row[name] is None else value + row[name] for name, value in so_far.items()}
    offsets = local_frame(df.sparkSession, starts, ", ".join(["_at int", *(f"_before_{name} {kinds[name]}" for name in totals)]))
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return kept.join(offsets, F.col("_range") == F.col("_at")).select(
        *(F.col(f"`{c}`") for c in df.columns),
        *((F.col(f"_before_{name}") + F.coalesce(F.sum(f"_of_{name}").over(inside), F.lit(0))).alias(name) for name in totals))
