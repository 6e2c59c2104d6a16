"""Pose contacts, pose reproducibility, summaries, verdict and publication tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.sources.shared import stored

POSE = ["ligand_std", "system", "grid_category", "run_mode", "seed"]
GROUP = POSE[:-1]


@dataclass(frozen=True)
class ContactRule:
    radius: float = 4.0
    residue: int = 50
    near: float = 8.0
    each_chain: int = 2
    in_total: int = 5
    low_rmsd: float = 2.0
    reproducible: float = 0.5
    gate: tuple[float, float] = (0.75, 0.75)


def _cells(radius: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / radius).alias(f"c{c}") for c in "xyz"]


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"))


#: A crowded cell is halved along each axis so many times at most.
HALVINGS = 4
_CELL, _LEAF, _FINE = ("cx", "cy", "cz"), ("lx", "ly", "lz"), ("fx", "fy", "fz")


def _around(points: DataFrame, key: list[str], radius: float) -> DataFrame:
    """(key, a, cell): each point once for each of the 27 cells around it."""
    around = F.array(*[F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip("xyz", (x, y, z)))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    a = points.select(*key, F.struct(*points.columns).alias("a"), *_cells(radius), F.explode(around).alias("d"))
    return a.select(*key, "a", *((F.col(f"c{c}") + F.col(f"d.d{c}")).alias(f"c{c}") for c in "xyz"))


def _reaches(radius: float, depth: Column, leaf: list[Column]) -> Column:
    """Whether a box (of a cell, at a depth) has a place within radius of a, with room for rounding."""
    side, off = F.lit(radius) / F.pow(F.lit(2.0), depth), []
    for c, i in zip("xyz", leaf):
        x, low = F.col(f"a.{c}"), F.col(f"c{c}") * F.lit(radius) + i * side
        off.append(F.greatest(low - x, x - low - side, F.lit(0.0)) - F.abs(x) * 1e-12)
    return sum(F.greatest(o, F.lit(0.0)) * F.greatest(o, F.lit(0.0)) for o in off) <= (radius * (1 + 1e-9)) ** 2


def dealt_cells(points: DataFrame, others: DataFrame, key: list[str], radius: float, crowded: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(points, others, keys of their join) where no key has many more than crowded rows of either side.

    Cells that hold more than crowded of others are halved along each axis, again and again, as far as their counts ask for it; a
    point near a border is copied to each part within the radius. Parts that are still crowded, since their rows lie in one spot or
    since points crowd there, are dealt in blocks: each block of points meets each block of others.
    """
    fine = [F.least(F.lit((1 << HALVINGS) - 1), F.greatest(F.lit(0), F.floor((F.col(c) / radius - F.floor(F.col(c) / radius)) * (1 << HALVINGS)).cast("int"))).alias(f"f{c}") for c in "xyz"]
    b = others.select(*key, F.struct(*others.columns).alias("b"), *_cells(radius), *fine)
    counts = b.groupBy(*key, *_CELL, *_FINE).agg(F.count("*").alias("n"))
    depth = F.lit(HALVINGS)
    for d in reversed(range(HALVINGS)):
        part = Window.partitionBy(*key, *_CELL, *(F.shiftright(c, HALVINGS - d) for c in _FINE))
        depth = F.when(F.sum("n").over(part) <= crowded, F.lit(d)).otherwise(depth)
    leaf = [F.expr(f"shiftright({f}, {HALVINGS} - depth)").alias(x) for f, x in zip(_FINE, _LEAF)]
    parts = stored(counts.withColumn("depth", depth).select(*key, *_CELL, *_FINE, "depth", *leaf, "n"), "cells")
    leaves = parts.groupBy(*key, *_CELL, "depth", *_LEAF).agg(F.sum("n").alias("n"))
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("depth", *_LEAF)]
    b = b.join(parts.where("depth > 0").drop("n"), [*key, *_CELL, *_FINE], "left").select(*key, "b", *_CELL, *whole)
    halved = leaves.where("depth > 0").groupBy(*key, *_CELL).agg(F.collect_list(F.struct("depth", *_LEAF)).alias("parts"))
    a = _around(points, key, radius).where(_reaches(radius, F.lit(0), [F.lit(0)] * 3)).join(halved, [*key, *_CELL], "left")
    a = a.select(*key, "a", *_CELL, F.explode_outer("parts").alias("part")).select(*key, "a", *_CELL, *(F.coalesce(f"part.{c}", F.lit(0)).alias(c) for c in ("depth", *_LEAF)))
    a = a.where(_reaches(radius, F.col("depth"), [F.col(c) for c in _LEAF]))
    at = [*key, *_CELL, "depth", *_LEAF]
    both = a.groupBy(*at).agg(F.count("*").alias("m")).join(leaves, at, "full")
    size = lambda c, name: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / crowded)).cast("int").alias(name)
    blocks = both.select(*at, size("m", "ps"), size("n", "os")).where("ps > 1 OR os > 1")
    blocks = stored(blocks, "blocks")
    one = lambda c: F.coalesce(c, F.lit(1))
    each = lambda c, name: F.explode(F.sequence(F.lit(0), one(c) - 1)).alias(name)
    own = lambda row, c, name: F.pmod(F.xxhash64(row), one(c)).cast("int").alias(name)
    a = a.join(blocks, at, "left").select(*at, "a", own("a", "ps", "p"), each("os", "o"))
    b = b.join(blocks, at, "left").select(*at, "b", own("b", "os", "o"), each("ps", "p"))
    return a, b, [*at, "p", "o"]


def within(points: DataFrame, others: DataFrame, key: list[str], radius: float, crowded: int = 20_000) -> DataFrame:
    """Distance join: rows of points and others with equal key no farther apart than radius.

    Both go into cells of that size; each point looks at the 27 cells around it, so the join is on key and cell. Where there are
    more rows than crowded, dense cells are split first.
    """
    if any(df.limit(crowded + 1).count() > crowded for df in (points, others)):
        a, b, keys = dealt_cells(points, others, key, radius, crowded)
    else:
        a, b, keys = _around(points, key, radius), others.select(*key, F.struct(*others.columns).alias("b"), *_cells(radius)), [*key, *_CELL]
    return a.join(b, keys).withColumn("distance", distance("a", "b")).where(F.col("distance") <= radius).select(*key, "a", "b", "distance")


#: Rows of one cell that go as one row.
BLOCK = 2_048


def _packed(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, cell, block, name): the rows (key, cell, row) of each cell in arrays of some BLOCK."""
    sizes = rows.groupBy(*key, *_CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1))).cast("int")
    return rows.join(sizes, [*key, *_CELL], "left").groupBy(*key, *_CELL, block.alias("block")).agg(F.collect_list("row").alias(name))


def _tiles(xyz: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, least, greatest) of tiles of at most that many rows which lie close together: a sort by halvings of the box around all."""
    low, high = xyz.min(axis=0), xyz.max(axis=0)
    if len(xyz) <= most:
        return np.arange(len(xyz)), np.zeros(1, dtype=np.int64), low[None], high[None]
    at, code = ((xyz - low) / np.where(high > low, high - low, 1) * 63).astype(np.int64), np.zeros(len(xyz), dtype=np.int64)
    for bit in reversed(range(6)):
        for axis in range(3):
            code = code << 1 | at[:, axis] >> bit & 1
    order, starts = np.argsort(code, kind="stable"), np.arange(0, len(xyz), most)
    return order, starts, np.minimum.reduceat(xyz[order], starts), np.maximum.reduceat(xyz[order], starts)


def _around_each(a: np.ndarray, b: np.ndarray, values: np.ndarray, bound: float, crowded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a: how many rows of b have a squared distance of at most bound, the sum of their values, the greatest squared distance (-1 if none).

    Tiles that lie within the bound as a whole are counted as a whole, and of these only such are compared as can hold the farthest.
    """
    if max(abs(int(values.max())), abs(int(values.min()))) * len(values) >= 1 << 63:
        raise OverflowError("a sum of values is beyond a long")
    if len(a) * len(b) <= 1 << 14:
        crowded = max(len(a), len(b))  # one tile
    order_a, starts_a, low_a, high_a = _tiles(a, crowded)
    order_b, starts_b, low_b, high_b = _tiles(b, crowded)
    b, values, sizes = b[order_b], values[order_b], np.diff([*starts_b, len(b)])
    sums, tile = np.add.reduceat(values, starts_b), np.repeat(np.arange(len(starts_b)), sizes)
    n, total, far = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64), np.full(len(a), -1.0)
    for s, low, high in zip(starts_a, low_a, high_a):
        rows = order_a[s : s + crowded]
        least = (np.maximum(0, np.maximum(low_b - high, low - high_b)) ** 2).sum(axis=1)
        most = (np.maximum(high_b - low, high - low_b) ** 2).sum(axis=1)
        # Room for rounding: what is near the bound is compared row by row.
        inside, apart = most <= bound * (1 - 1e-9), least > bound * (1 + 1e-9)
        n[rows], total[rows] = sizes[inside].sum(), sums[inside].sum()
        held = (~inside & ~apart)[tile]
        if inside.any():
            # A row nearer the middle of the tile by more than its width than another is farthest from none of its rows.
            middle, within = (low + high) / 2, inside[tile]
            off = np.where(within, np.sqrt(((b - middle) ** 2).sum(axis=1)), -1.0)
            held |= within & (off >= off.max() * (1 - 1e-9) - np.sqrt(((a[rows] - middle) ** 2).sum(axis=1).max()) * 2 * (1 + 1e-9))
        if not held.any():
            continue
        x, whole, v = b[held], inside[tile[held]], values[held]
        d = a[rows][:, None, 0] - x[None, :, 0]
        d *= d
        for axis in (1, 2):
            e = a[rows][:, None, axis] - x[None, :, axis]
            e *= e
            d += e
        met = d <= bound
        far[rows] = np.where(met, d, -1.0).max(axis=1)
        if not whole.all():
            new = met[:, ~whole]
            n[rows] += new.sum(axis=1)
            total[rows] += np.where(new, v[~whole], 0).sum(axis=1)
    return n, total, far


def _counted(key: int, radius: float, crowded: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, a, b) to (key, name, n, total, farthest) for each row of a block a that has rows of block b around it."""
    bound = radius * radius
    while np.sqrt(bound) <= radius:
        bound = np.nextafter(bound, np.inf)
    while np.sqrt(bound) > radius:
        bound = np.nextafter(bound, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(key)[i].values, batch.column(key + 1)[i].values
                xyz = [np.stack([rows.field(c).to_numpy() for c in "xyz"], axis=1) for rows in (a, b)]
                n, total, far = _around_each(*xyz, b.field("value").to_numpy(), bound, crowded)
                rows = np.flatnonzero(n)
                if len(rows):
                    own = [batch.column(k).take(pa.array(np.full(len(rows), i))) for k in range(key)]
                    made = [a.field("name").take(pa.array(rows)), pa.array(n[rows]), pa.array(total[rows]), pa.array(np.sqrt(far[rows]))]
                    yield pa.RecordBatch.from_arrays([*own, *made], names=[*batch.schema.names[:key], "name", "n", "total", "farthest"])

    return run


def neighbourhoods(points: DataFrame, others: DataFrame, key: list[str], radius: float, name: str, value: str, crowded: int = 64) -> DataFrame:
    """(key, name, n, total, farthest) of points that have others around them: what within gives, counted by key and name without a row for each pair.

    total is the sum of the others' value (a whole number; null counts as 0), farthest the greatest distance. Rows of a cell go in
    blocks, points also to the cells within the radius, and one block of others is one key of the join. Within two blocks, tiles of at
    most crowded rows are told apart by the boxes around them. Points without a place have nothing around them.
    """
    a, b = (df.dropna(subset=["x", "y", "z"]) for df in (points, others))
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*xyz, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("value"))
    b = stored(_packed(b.select(*key, row.alias("row"), *_cells(radius)), key, "b"), "blocks")
    blocks = b.groupBy(*key, *_CELL).agg(F.collect_list("block").alias("blocks"))
    a = _around(a.select(*key, *xyz, F.col(name).alias("name")), key, radius).where(_reaches(radius, F.lit(0), [F.lit(0)] * 3))
    a = a.join(blocks.select(*key, *_CELL), [*key, *_CELL], "left_semi").select(*key, *_CELL, F.struct("a.x", "a.y", "a.z", "a.name").alias("row"))
    a = _packed(a, key, "a").drop("block").join(blocks, [*key, *_CELL]).select(*key, "a", *_CELL, F.explode("blocks").alias("block"))
    a = a.repartition(tasks, *key, *_CELL, "block")  # a stated number: few bytes are much work
    met = a.join(b, [*key, *_CELL, "block"]).select(*key, "a", "b")
    kinds = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in key), f"name {points.schema[name].dataType.simpleString()}", "n bigint, total bigint, farthest double"])
    made = met.mapInArrow(_counted(len(key), radius, crowded), kinds)
    return made.groupBy(*key, F.col("name").alias(name)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))


def contacts(ligand_atoms: DataFrame, receptor_atoms: DataFrame, chains: tuple[str, str], rule: ContactRule = ContactRule()) -> DataFrame:
    """One row for each pose: residues in contact by chain and in total, contact flags, nearest distance to the named residue."""
    met = within(ligand_atoms, receptor_atoms, ["system"], rule.radius)
    pose = [F.col(f"a.{c}").alias(c) for c in POSE]
    residue = F.struct(F.col("b.chain"), F.col("b.residue"))
    on = lambda chain: F.countDistinct(F.when(F.col("b.chain") == chain, F.col("b.residue")))
    counted = met.groupBy(*pose).agg(on(chains[0]).alias("contacts_1"), on(chains[1]).alias("contacts_2"), F.countDistinct(residue).alias("contacts"))
    site = receptor_atoms.where(F.col("residue") == rule.residue).select("system", F.struct("x", "y", "z").alias("b"))
    far = ligand_atoms.select(*POSE, F.struct("x", "y", "z").alias("a")).join(site, "system").groupBy(*POSE).agg(F.min(distance("a", "b")).alias("distance_site"))
    out = ligand_atoms.select(*POSE).distinct().join(counted, POSE, "left").join(far, POSE, "left").fillna(0, ["contacts_1", "contacts_2", "contacts"])
    one, two, total = F.col("contacts_1"), F.col("contacts_2"), F.col("contacts")
    return out.select(
        "*", ((one >= 1) & (two >= 1)).alias("dual_chain"), ((one >= rule.each_chain) & (two >= rule.each_chain) & (total >= rule.in_total)).alias("strong_cleft"),
        F.coalesce(F.col("distance_site") <= rule.near, F.lit(False)).alias("near_site"),
    )


def pose_rmsd(atoms: DataFrame, group: list[str], pose: str, atom: str, axes: list[str], rule: ContactRule = ContactRule()) -> DataFrame:
    """Per group: poses, mean, median and greatest RMSD over unordered pose pairs matched by atom, which a pose names once; a pose is one row before pairs are made; reproducible if the median is low. Groups of one pose have null RMSD."""
    poses = atoms.groupBy(*group, pose).agg(F.array_sort(F.collect_list(F.struct(F.col(atom).alias("atom"), F.array(*axes).alias("p")))).alias("atoms"))
    side = lambda n: poses.select(*group, F.col(pose).alias(f"pose_{n}"), F.transform("atoms", lambda x: x["atom"]).alias(f"names_{n}"), F.transform("atoms", lambda x: x["p"]).alias(f"p{n}"))
    total = lambda x: F.aggregate(x, F.lit(0.0).cast("double"), lambda s, v: s + v)
    square = lambda a, b: total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))
    other = F.map_from_arrays("names_2", "p2")
    common = F.filter(F.arrays_zip(F.col("names_1").alias("n"), F.col("p1").alias("p")), lambda x: F.map_contains_key(other, x["n"]))
    each = F.when(F.col("names_1") == F.col("names_2"), F.zip_with("p1", "p2", square)).otherwise(F.transform(common, lambda x: square(x["p"], F.element_at(other, x["n"]))))
    met = side(1).join(side(2), group).where("pose_1 < pose_2").select(*group, each.alias("squares")).where(F.size("squares") > 0)
    pairs = met.select(*group, F.sqrt(total(F.col("squares")) / F.size("squares")).alias("rmsd"))
    made = pairs.groupBy(*group).agg(F.avg("rmsd").alias("mean_pairwise_rmsd"), F.median("rmsd").alias("median_pairwise_rmsd"), F.max("rmsd").alias("max_pairwise_rmsd"))
    n = atoms.groupBy(*group).agg(F.countDistinct(pose).alias("n_poses"))
    return n.join(made, group, "left").withColumn("pose_cluster_low_rmsd", F.coalesce(F.col("median_pairwise_rmsd") <= rule.low_rmsd, F.lit(False)))


def pose_summary(poses: DataFrame, ligand: str, grid: str, score: str, flags: list[str], means: list[str]) -> DataFrame:
    """Per ligand and grid, and per ligand (grid null), in one pass of grouping sets: n, mean and sample sd of score, shares of flags, means."""
    return poses.groupingSets([[F.col(ligand), F.col(grid)], [F.col(ligand)]], F.col(ligand), F.col(grid)).agg(
        F.grouping(grid).cast("int").alias("overall"), F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("sd_score"),
        *(F.avg(F.col(f).cast("int")).alias(f"{f}_fraction") for f in flags), *(F.avg(m).alias(f"mean_{m}") for m in means),
    )


def low_rmsd_share(rmsd: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted over the rows of the RMSD table (system and run mode)."""
    return rmsd.groupBy(*by).agg(F.avg("median_pairwise_rmsd").alias("mean_median_rmsd"), F.avg(F.col("pose_cluster_low_rmsd").cast("int")).alias("low_rmsd_system_fraction"))


#: The parts of a verdict.
GATE, PASSES, FAILS = "Stage16 contact gate: ", "passes automated dual-chain/contact screen", "fails automated dual-chain/contact screen"
POSES, STEADY, MOVING = "; pose reproducibility ", "moderate", "variable/manual review needed"


def verdict(role: Column, dual: Column, cleft: Column, reproducible: Column, rule: ContactRule = ContactRule()) -> Column:
    gate = F.when((dual >= rule.gate[0]) & (cleft >= rule.gate[1]), PASSES).otherwise(FAILS)
    moved = F.when(reproducible >= rule.reproducible, STEADY).otherwise(MOVING)
    return F.concat_ws(" | ", role, F.concat(F.lit(GATE), gate, F.lit(POSES), moved))


def final_decision(summary: DataFrame, roles: DataFrame, rule: ContactRule = ContactRule()) -> DataFrame:
    """Verdict, roles and ligand efficiency, by the given priority. roles is a dimension table (one row for each ligand)."""
    out = summary.join(roles, "ligand_std", "left")
    text = verdict(F.col("role_text"), F.col("dual_chain_fraction"), F.col("strong_cleft_fraction"), F.col("low_rmsd_system_fraction"), rule)
    return out.withColumn("stage16_preliminary_verdict", text).withColumn("mean_LE", F.try_divide("mean_score", "mean_heavy_atoms")).orderBy("priority_order")


def publish(decision: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Display names and rounding: score and sd to 2 decimals, efficiency to 3, percentages to 0, contacts and distance to 1."""
    named = decision.withColumn("Compound", F.replace("ligand_std", F.lit("_"), F.lit(" ")))
    r = lambda c, k, name: F.round(F.col(c), k).alias(name)
    percent = lambda c, name: F.round(100 * F.col(c), 0).cast("int").alias(name)
    return named.join(descriptors, "Compound", "left").orderBy("priority_order").select(
        "Compound", *[c for c in descriptors.columns if c != "Compound"], F.col("n").alias("n poses"), r("mean_score", 2, "Mean score"), r("sd_score", 2, "SD"), r("mean_LE", 3, "Ligand eff"),
        percent("dual_chain_fraction", "Dual-chain contact %"), percent("strong_cleft_fraction", "Strong cleft contact %"), percent("low_rmsd_system_fraction", "Pose repro %"),
        r("mean_contacts_1", 1, "Mean contacts 1"), r("mean_contacts_2", 1, "Mean contacts 2"), r("mean_distance_site", 1, "Mean dist site"),
    )


def grid_gate(grids: DataFrame, key: list[str], state: str, most: float = 0.0) -> DataFrame:
    """Pairs of states of one key whose grid centres are no farther apart than most."""
    side = lambda n: grids.select(*key, F.col(state).alias(f"{state}_{n}"), F.struct("x", "y", "z").alias(f"s{n}"))
    met = side(1).join(side(2), key).where(F.col(f"{state}_1") < F.col(f"{state}_2")).withColumn("distance", F.round(distance("s1", "s2"), 6))
    return met.withColumn("comparable", F.col("distance") <= most).drop("s1", "s2")
