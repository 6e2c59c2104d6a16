"""Lines under the header before them, where no record separator can cut a file: a running group, scanned in two passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions.exprs import strip
from candrank.sources.shared import stored


_SPLIT = "file string, block bigint, n bigint, value string, is_header boolean, local bigint, header string, head bigint"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, value, is_header) to (..., local, header, head): headers so far in the split, the last of them and its n. Rows of a split come one after another.

    After each split a row without n, its summary: how many headers, the last one and its n.
    """
    names = [x.split()[0] for x in _SPLIT.split(", ")]
    at, headers, last, head = None, 0, None, None

    def summary() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*at, None, None, None, headers, last, head), types)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        codes = files.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]))
        is_header = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        local, whence = np.zeros(batch.num_rows, dtype=np.int64), np.full(batch.num_rows, -1, dtype=np.int64)
        carried, heads, over = [], [], []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = files.dictionary[codes[a]].as_py(), int(blocks[a])
            if key != at:
                if at is not None:
                    over.append(summary())
                at, headers, last, head = key, 0, None, None
            local[a:b] = headers + np.cumsum(is_header[a:b])
            seen = np.maximum.accumulate(np.where(is_header[a:b], np.arange(a, b), -1))
            whence[a:b] = np.where(seen >= 0, seen, -1 - len(carried))
            carried.append(last)
            heads.append(head)
            if seen[-1] >= 0:
                headers, last, head = int(local[b - 1]), batch.column(3)[int(seen[-1])].as_py(), batch.column(2)[int(seen[-1])].as_py()
        # A header of this batch, or the one that a stretch of the batch brought with it.
        index = pa.array(np.where(whence >= 0, whence, batch.num_rows - 1 - whence))
        made = [pa.concat_arrays([batch.column(i), pa.array(x, kind)]).take(index) for i, x, kind in ((3, carried, pa.string()), (2, heads, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), *made], names=names)
        yield from over
    if at is not None:
        yield summary()


def running_groups(lines: DataFrame, is_header: Column) -> DataFrame:
    """(ordinal, value, is_header, number, header, head) of lines (ordinal, value): the how-manieth header of its file a line stands under, that header and its ordinal.n; 0 and null before the first.

    Each split of a file is counted by itself, in order of scan. Its summary is one row, how many headers and the last one; the
    exclusive scan over the splits of a file gives what each begins with, which a second pass adds. No file is sorted or held in one task,
    and no split: lines under one header have one head, so they can be counted by numbers.
    """
    o = F.col("ordinal")
    parts = lines.select(o["file_path"].alias("file"), o["file_block_start"].alias("block"), o["n"].alias("n"), "value", F.coalesce(is_header, F.lit(False)).alias("is_header"))
    counted = stored(parts.mapInArrow(_local, _SPLIT), "split-lines")
    splits = counted.where("n IS NULL").select("file", "block", F.col("local").alias("headers"), F.when(F.col("local") > 0, F.struct("header", "head")).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = splits.select("file", "block", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("before"), F.last("last", True).over(before).alias("carried"))
    each = counted.where("n IS NOT NULL").join(stored(begin, "split-begins"), ["file", "block"])
    ordinal = F.struct(F.col("file").alias("file_path"), F.col("block").alias("file_block_start"), "n").alias("ordinal")
    of = lambda c: F.when(F.col("local") > 0, F.col(c)).otherwise(F.col(f"carried.{c}")).alias(c)
    return each.select(ordinal, "value", "is_header", (F.col("before") + F.col("local")).alias("number"), of("header"), of("head"))


def grouped_records(lines: DataFrame, mark: str = "^[ \t]*>") -> DataFrame:
    """(ordinal, id, header, seq) of records whose header lines match mark, as readers.fasta gives them; ordinal is file and number. One sequence is one value, as there."""
    grouped = running_groups(lines, F.col("value").rlike(mark)).where("number > 0")
    line = F.when(~F.col("is_header"), F.struct("ordinal", strip(F.col("value")).alias("line")))
    made = grouped.groupBy(F.struct(F.col("ordinal.file_path"), "number").alias("ordinal")).agg(F.first("header").alias("header"), F.collect_list(line).alias("lines"))
    header = strip(F.regexp_replace(F.regexp_replace("header", mark, ""), "\r", ""))
    seq = F.array_join(F.transform(F.array_sort("lines"), lambda x: F.regexp_replace(x["line"], "\r", "")), "")
    return made.select("ordinal", header.alias("header"), seq.alias("seq")).select("ordinal", F.split("header", r"\s+")[0].alias("id"), "header", "seq")
