"""Records of delimited text whose quoted cells hold line breaks, read in parallel.

Whether a line starts a record depends on whether a quoted cell is open before it, and that on all
lines before it in its file. A quote opens a cell only where the cell starts (blanks aside), a doubled
quote inside is text, and what follows the closing quote is plain. So a line turns each of the two
states (no cell open, cell open) into one of the two. Every task follows the lines of its blocks of the
files from both states and notes for each line, for either state, where its record starts and whether
it ends there. One row for each block goes into running windows over the blocks of a file, which tell the true
state before each block and the record that reaches into it. Lines that are a whole record stay where
they are; only the lines of longer records are shuffled, by the start of their record.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtab.session import checkpointed

#: A record of more lines than this is taken for a quote that nobody closes, and raises.
MOST_LINES = 100_000
MARKS = "rec_a long, ends_a boolean, rec_b long, ends_b boolean"


def quote_rules(delimiter: str):
    """A function (line, open before) -> open behind, of bytes."""
    mark = re.escape(delimiter.encode())
    inner = rb'[^"]*+(?:""[^"]*+)*+'
    closed = re.compile(inner + rb'"[^' + mark + rb']*+')
    cell = rb'(?: *+"' + inner + rb'"[^' + mark + rb']*+|(?! *+")[^' + mark + rb']*+)'
    left_open = re.compile(rb"(?:" + cell + mark + rb')*+ *+"' + inner)

    def behind(line: bytes, is_open: bool) -> bool:
        if b'"' not in line:
            return is_open
        at = 0
        if is_open:
            found = closed.match(line)
            if found is None:
                return True
            at = found.end() + len(delimiter)
            if found.end() == len(line):
                return False
        return left_open.fullmatch(line, at) is not None

    return behind


def marked_lines(lines: DataFrame, delimiter: str) -> DataFrame:
    """The lines (source, line_no, value) with, for both states before their block: the place in the block at which
    their record starts (null: before the block), and whether the record ends with the line. Lines must come in the order of their place."""
    behind = quote_rules(delimiter)

    def batches(parts):
        block = None
        for part in parts:
            found = ([], [], [], [])
            for source, number, at, value in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (source, number) != block:
                    block, is_open, start = (source, number), [False, True], [None, None]
                after = [behind(value or b"", is_open[0])]
                after.append(after[0] if is_open[0] == is_open[1] else behind(value or b"", is_open[1]))
                for way in (0, 1):
                    if not is_open[way]:
                        start[way] = at
                    found[2 * way].append(start[way])
                    found[2 * way + 1].append(not after[way])
                is_open = after
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), part.column(4), *(pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.bool_()) * 2))],
                names=["source", "line_no", "value", "rec_a", "ends_a", "rec_b", "ends_b"])

    read = lines.select("source", F.col("line_no.block").alias("_block"), F.col("line_no.at").alias("_at"), "line_no",
                        F.col("value").cast("binary").alias("value"))
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    return read.mapInArrow(batches, f"source {kinds['source']}, line_no {kinds['line_no']}, value binary, {MARKS}")


def whole_records(lines: DataFrame, delimiter: str, in_order: bool = False, most_lines: int = MOST_LINES) -> DataFrame:
    """(source, line_no, value): one row for each record, with the place of its first line; its lines are joined
    by a line feed. `lines` has (source, line_no, value), with line_no a struct (block, at) and the values as bytes or text;
    `in_order` says that tasks meet the lines of a block together and in order, as a scan does. A cell that is
    open at the end of its source ends there."""
    if not in_order:
        lines = lines.repartition("source", "line_no.block").sortWithinPartitions("source", "line_no")
    return joined(checkpointed(marked_lines(lines, delimiter)), most_lines)


def block_starts(marked: DataFrame) -> DataFrame:
    """(source, block, open, carried): the state before each block, and the record that reaches into it.

    A block ends in one state whatever was before it, or it keeps or swaps the state; so the state before a block is
    that behind the last block of the first kind, swapped once for each swap since. Both come from running windows
    over one row per block, whose cost grows with the blocks of a file and not with their square."""
    place = marked.schema["line_no"].dataType.simpleString()
    last = F.max_by(F.struct("rec_a", "ends_a", "rec_b", "ends_b"), "line_no.at").alias("last")
    blocks = marked.groupBy("source", F.col("line_no.block").alias("block")).agg(last).select("source", "block", "last.*")
    ordered = Window.partitionBy("source").orderBy("block")
    through, before = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    settled = F.col("ends_a") == F.col("ends_b")
    swaps = blocks.withColumn("_swaps", F.sum(F.when(settled | F.col("ends_a"), 0).otherwise(1)).over(through))
    fixed = F.when(settled, F.col("_swaps") + F.when(F.col("ends_a"), 0).otherwise(1))
    swapped = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.last("_swaps").over(before), F.lit(0))
    states = swaps.withColumn("open", swapped % 2 == 1)
    rec = F.when(F.col("open"), F.col("rec_b")).otherwise(F.col("rec_a"))
    here = F.when(rec.isNotNull(), F.struct("block", rec.alias("at")).cast(place))
    return states.select("source", F.col("block").cast("bigint").alias("block"), "open", F.last(here, ignorenulls=True).over(before).alias("carried"))


def joined(marked: DataFrame, most_lines: int) -> DataFrame:
    starts = checkpointed(block_starts(marked)).withColumnsRenamed({"source": "_source", "block": "_block"}).hint("merge")
    placed = marked.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("line_no.block") == F.col("_block")))
    rec = F.when(F.col("open"), F.col("rec_b")).otherwise(F.col("rec_a"))
    own = F.struct(F.col("line_no.block").alias("block"), rec.alias("at")).cast(marked.schema["line_no"].dataType)
    placed = placed.select("source", "line_no", "value", F.when(rec.isNull(), F.col("carried")).otherwise(own).alias("record"),
                           F.when(F.col("open"), F.col("ends_b")).otherwise(F.col("ends_a")).alias("ends"))
    alone = (F.col("record") == F.col("line_no")) & F.col("ends")
    longer = placed.where(~alone)
    endless = longer.groupBy("source", "record").agg(F.count("*").alias("n")).where(F.col("n") > most_lines).first()
    if endless:
        raise ValueError(f"a quoted cell of {endless['source']} goes on for {endless['n']} lines, from {endless['record']}")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda p: p["value"])
    text = F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], lambda so_far, p: F.concat(so_far, F.lit(b"\n"), p))
    return placed.where(alone).select("source", "line_no", "value").unionByName(
        longer.groupBy("source", "record").agg(text.alias("value")).select("source", F.col("record").alias("line_no"), "value"))
