"""Depth and breadth from histograms of depth: no dense array of positions is ever made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.functions.exprs import has_flags, lacks_flags

#: Fixed values of alignment flags.
PROPER, UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x2, 0x4, 0x100, 0x200, 0x400, 0x800
#: What counts of reads leave out, and what depth leaves out.
NOT_PRIMARY = UNMAPPED | SECONDARY | SUPPLEMENTARY
NOT_IN_DEPTH = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
#: Positions of a reference that one task sweeps.
RANGE = 1 << 20


@dataclass(frozen=True)
class SupportRule:
    breadth: float = 0.90
    mean_depth: float = 5.0
    mapped: int = 20
    runs: int = 2


def depth_summary(depth: DataFrame, references: DataFrame, steps: tuple[int, ...] = (1, 5, 10), order: tuple[str, ...] = ("depth",)) -> DataFrame:
    """depth (reference, pos, depth) over references (reference, length): breadths, mean, exact median, p10, p90, cv, zero bases.

    Positions of unknown references or out of range are ignored; positions not named have depth 0; of a position that is
    named again the last by order counts (by default the greatest depth); quantiles take the element at
    round-half-even((n - 1) * p) of the sorted depths.
    """
    last = depth.groupBy("reference", "pos").agg(F.max_by("depth", F.struct(*order)).alias("depth"))
    known = last.join(references, "reference").where((F.col("pos") >= 1) & (F.col("pos") <= F.col("length")))
    counted = known.groupBy("reference", "depth").agg(F.count("*").alias("n"))
    covered = counted.groupBy("reference").agg(F.sum("n").alias("covered"))
    zeros = references.join(covered, "reference", "left").select("reference", F.lit(0).cast("bigint").alias("depth"), (F.col("length") - F.coalesce("covered", F.lit(0))).alias("n"))
    histogram = counted.select("reference", F.col("depth").cast("bigint"), "n").unionByName(zeros).groupBy("reference", "depth").agg(F.sum("n").alias("n")).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("reference").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    h = histogram.join(references, "reference").withColumn("upto", upto)
    last = F.col("length") - 1
    element = lambda k: F.min(F.when(F.col("upto") > k, F.col("depth")))
    size = F.first("length")
    d, n = F.col("depth"), F.col("n")
    made = h.groupBy("reference").agg(
        *(F.coalesce(F.sum(F.when(d >= k, n)), F.lit(0)).alias(f"at_{k}") for k in steps),
        F.sum(d * n).alias("total"), F.sum(d * d * n).alias("squares"), F.sum(F.when(d == 0, n)).alias("zero"),
        element(F.floor(last / 2)).alias("m1"), element(F.ceil(last / 2)).alias("m2"),
        element(F.bround(last * 0.1, 0)).alias("p10"), element(F.bround(last * 0.9, 0)).alias("p90"), size.alias("size"),
    )
    out = references.join(made, "reference", "left")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("length")), F.lit(0.0)), 6)
    mean = F.col("total") / F.col("length")
    cv = F.when((F.col("total") > 0) & (F.col("length") > 1), F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("length") - mean * mean)) / mean).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(
        "reference", F.col("length").alias("reference_length"), *(share(f"at_{k}").alias(f"breadth_{k}x") for k in steps), share("total").alias("mean_depth"),
        ((zero("m1") + zero("m2")) / 2).alias("median_depth"), zero("p10").alias("depth_p10"), zero("p90").alias("depth_p90"),
        F.round(cv, 6).alias("depth_cv"), F.coalesce("zero", F.lit(0)).alias("zero_bases"),
    )


def depth_from_intervals(intervals: DataFrame, width: int = RANGE) -> DataFrame:
    """(reference, start, end, depth): maximal runs of equal depth from intervals [start, end), by a sweep over +1 and -1.

    References are swept in ranges of width positions; a range begins with the depth that those before it leave.
    """
    events = intervals.select("reference", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("reference", "e.pos").agg(F.sum("e.d").alias("d")).where("d <> 0").withColumn("range", F.floor(F.col("pos") / width))
    each = Window.partitionBy("reference").orderBy("range")
    ranges = steps.groupBy("reference", "range").agg(F.sum("d").alias("total"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("total").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("reference", "range", before.alias("before"), F.lead("first").over(each).alias("next"))
    w = Window.partitionBy("reference", "range").orderBy("pos")
    depth = F.col("before") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    swept = steps.join(ranges, ["reference", "range"]).select("reference", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), "next").alias("end"), depth.alias("depth"))
    return swept.where("`end` IS NOT NULL AND depth > 0")


def alignment_depth(alignments: DataFrame) -> DataFrame:
    """The same from alignments (reference, start, end, flag) that count for depth."""
    return depth_from_intervals(alignments.where(lacks_flags(F.col("flag"), NOT_IN_DEPTH)))


def reference_coverage(alignments: DataFrame, references: DataFrame, width: int = RANGE) -> DataFrame:
    """(reference, length, reads, covered_bases, coverage, mean_depth, mean_mapq) of every reference, from alignments (reference, start, end, flag, mapq).

    What depth leaves out is left out; intervals are cut to the reference, and those of unknown references ignored. coverage is
    a percentage; a reference without reads has zeros. Base qualities are no column of alignments, so their mean is not given.
    """
    known = alignments.where(lacks_flags(F.col("flag"), NOT_IN_DEPTH)).join(references.select("reference", "length"), "reference")
    reads = known.groupBy("reference").agg(F.count("*").alias("reads"), F.avg("mapq").alias("mapq"))
    inside = known.select("reference", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end")).where(F.col("start") < F.col("end"))
    size = F.col("end") - F.col("start")
    bases = depth_from_intervals(inside, width).groupBy("reference").agg(F.sum(size).alias("covered"), F.sum(size * F.col("depth")).alias("total"))
    out = references.join(reads, "reference", "left").join(bases, "reference", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c, by: F.round(F.coalesce(F.try_divide(F.col(c).cast("double") * by, F.col("length")), F.lit(0.0)), 6)
    return out.select("reference", "length", zero("reads").alias("reads"), zero("covered").alias("covered_bases"), share("covered", 100).alias("coverage"), share("total", 1).alias("mean_depth"), F.round(F.coalesce("mapq", F.lit(0.0)), 6).alias("mean_mapq"))


def reference_counts(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """(reference, length, mapped, unmapped): every reference, also without alignments (reference, flag)."""
    unmapped = has_flags(F.col("flag"), UNMAPPED)
    made = alignments.groupBy("reference").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return references.join(made, "reference", "left").select("reference", "length", zero("mapped"), zero("unmapped"))


def read_counts(flag: Column, mapq: Column, least: int = 20) -> list[Column]:
    """Aggregates of one pass: primary, well-mapped and properly paired primary alignments."""
    primary = lacks_flags(flag, NOT_PRIMARY)
    return [F.count_if(primary).alias("mapped_primary"), F.count_if(primary & (mapq >= least)).alias("mapped_mapq20"), F.count_if(primary & has_flags(flag, PROPER)).alias("proper_pair_primary")]


def supported(rule: SupportRule = SupportRule()) -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (zero("breadth_1x") >= rule.breadth) & (zero("mean_depth") >= rule.mean_depth) & (zero("mapped_mapq20") >= rule.mapped)


def supported_runs(support: DataFrame, rule: SupportRule = SupportRule()) -> DataFrame:
    """(reference, n, runs): distinct runs that support a reference."""
    return support.where(supported(rule)).groupBy("reference").agg(F.countDistinct("run").alias("supported_run_count"), F.array_join(F.array_sort(F.collect_set("run")), ";").alias("supported_runs"))
