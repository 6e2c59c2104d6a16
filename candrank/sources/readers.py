"""Scans: FASTA, annotations, hit tables, headered tables, keyed JSON, run metadata. By Spark's readers, but for files that tasks name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candrank.functions.exprs import strip, with_scheme, zip_lists
from candrank.sources.catalogue import opened

#: Bytes of a file that a task reads at once.
CHUNK = 1 << 20

#: The positional columns of both hit-table layouts.
HITS_1 = "query string, subject string, pident double, aln_len int, qlen int, slen int, evalue double, bitscore double, qcov double, scov double, qstart int, qend int"
HITS_2 = "qseqid string, saccver string, pident double, length int, qlen int, slen int, qcovs double, evalue double, bitscore double, staxids string, sscinames string, stitle string"

#: The columns of a run catalogue that are read, and those of a depth table, a published triage table each.
CATALOGUE = "Run string, LibraryStrategy string, LibrarySource string, size_MB string, BioProject string, ReleaseDate string, ScientificName string, bases string"
DEPTH = "reference string, pos bigint, depth bigint"
_SUMMARY = "n int, mean_score double, sd_score double, dual_chain_fraction double, mean_total_contacts double, mean_optn_contacts double, mean_tbk1_contacts double, strong_cleft_fraction double, res50_within_8A_fraction double, mean_dist_res50 double, mean_median_rmsd double"
PUBLISHED = {
    "verdict": f"ligand_std string, {_SUMMARY}, low_rmsd_system_fraction double, stage16_preliminary_verdict string",
    "summary": f"ligand_std string, grid_category string, {_SUMMARY}, systems_low_rmsd_fraction double",
    "rmsd": "ligand_std string, system string, grid_category string, run_mode string, n_poses int, mean_pairwise_rmsd double, median_pairwise_rmsd double, max_pairwise_rmsd double, pose_cluster_low_rmsd boolean",
    "decision": f"ligand_std string, {_SUMMARY}, low_rmsd_system_fraction double, stage16_preliminary_verdict string, mean_LE double, mean_heavy_atoms double, recommended_role string, mmgbsa_recommendation string, priority_order int",
    "triage": "Compound string, `Source herb` string, `Scaffold class` string, Role string, `n poses` int, `Mean score (kcal/mol)` double, SD double, `Ligand eff. (kcal/mol·HA⁻¹)` double, `Heavy atoms` int, `Dual-chain contact %` int, `Strong cleft contact %` int, `Pose repro. (low-RMSD sys %)` int, `Mean OPTN contacts` double, `Mean TBK1 contacts` double, `Mean dist res50 (Å)` double, MW double, cLogP double, `Lipinski viol.` int, `PAINS flag` string",
}


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds the order of scan: file, block of the file, row within. Only straight after a file scan."""
    return df.withColumn("ordinal", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")))


def text_records(spark: SparkSession, path: str, separator: str = "\n>") -> DataFrame:
    return with_ordinal(spark.read.option("lineSep", separator).text(path))


def file_records(files: DataFrame, path: str, separator: str = "\n>") -> DataFrame:
    """(ordinal, value, is_first) of the files named in the column file, below path, as write_files gives them: tasks open them by name, and
    nothing lists their folders. A task holds a chunk and a record at a time."""
    cut = separator.encode()
    place = pa.struct([("file_path", pa.string()), ("file_block_start", pa.int64()), ("n", pa.int64())])
    schema = "ordinal struct<file_path string, file_block_start bigint, n bigint>, value string, is_first boolean"

    def records(names: Iterator[str]) -> Iterator[tuple[str, int, bytes]]:
        store, base = opened(path)
        for name in names:
            rest, n = b"", 0
            with store.open_input_stream(f"{base}/{name}", buffer_size=0) as f:
                while part := f.read(max(CHUNK, len(rest))):
                    *whole, rest = (rest + part).split(cut)
                    for value in whole:
                        yield name, n, value
                        n += 1
            if rest:
                yield name, n, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            names, n, values = (list(c) for c in zip(*some))
            ordinal = pa.StructArray.from_arrays([pa.array([f"{path}/{x}" for x in names]), pa.array([0] * len(n), pa.int64()), pa.array(n, pa.int64())], fields=list(place))
            return pa.RecordBatch.from_arrays([ordinal, pa.array(values, pa.binary()).cast(pa.string()), pa.array([k == 0 for k in n])], names=["ordinal", "value", "is_first"])

        some, size = [], 0
        for record in records(x for b in batches for x in b.column(0).to_pylist()):
            some.append(record)
            size += len(record[2])
            if size > CHUNK or len(some) > 10_000:
                yield made()
                some, size = [], 0
        if some:
            yield made()

    # A stated number of tasks: names are small and files are not, so that an adaptive plan would give all of them to one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(tasks, "file").mapInArrow(run, schema)


def fasta(raw: DataFrame) -> DataFrame:
    """Records (ordinal, value, is_first) to (ordinal, id, header, seq); is_first marks the record at the head of a file.

    Lines are stripped and blank lines dropped; a header that stands after blanks begins a record too; text before the
    first header of a file is dropped.
    """
    cut = raw.select("ordinal", F.posexplode(F.split(F.concat(F.lit("\n>"), F.regexp_replace("value", r"^\s*>|\r", "")), r"\n[ \t]*>")).alias("part", "body"), F.col("value"), "is_first")
    cut = cut.where(F.col("part") > 0)
    lines = F.filter(F.transform(F.split("body", "\n"), strip), lambda x: x != "")
    whole = cut.withColumn("lines", lines).withColumn("header", strip(F.split("body", "\n")[0]))
    first = F.col("is_first") & (F.col("part") == 1) & ~F.col("value").rlike(r"^\s*>")
    seq = F.array_join(F.when(F.col("header") == "", F.col("lines")).otherwise(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))), "")
    return whole.where(~first).select(F.struct("ordinal", "part").alias("ordinal"), F.split("header", r"\s+")[0].alias("id"), "header", seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    raw = text_records(spark, path)
    file = F.col("ordinal.file_path")
    heads = raw.where("ordinal.file_block_start = 0").groupBy(file.alias("file")).agg(F.min("ordinal.n").alias("n"))
    marked = raw.withColumn("file", file).join(heads, "file", "left")
    return fasta(marked.select("ordinal", "value", (F.col("ordinal.n").eqNullSafe(F.col("n"))).alias("is_first")))


def annotations(lines: DataFrame) -> DataFrame:
    """Lines (ordinal, value) `id TAB key=value TAB ...` to (ordinal, id, attrs): items without = are ignored, the last of equal keys wins, rows without id go."""
    items = F.split(F.regexp_replace("value", r"\r?\n?$", ""), "\t")
    found = F.filter(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda x: F.contains(x, F.lit("=")))
    split_ = F.transform(found, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v"), i.alias("i")))
    rows = lines.select("ordinal", items[0].alias("id"), split_.alias("kv")).where("id <> ''")
    last = F.filter("kv", lambda x: ~F.exists("kv", lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return rows.select("ordinal", "id", F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))).alias("attrs"))


def hits(lines: DataFrame, schema: str, least: int | None = None) -> DataFrame:
    """Headerless tab-separated lines (ordinal, value) by position; lines with too few fields are skipped, fields that do not parse are null."""
    fields = StructType.fromDDL(schema).fields
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= (least or len(fields))).select("ordinal", *(F.get(parts, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", must_exist: bool = False, name: str | None = None) -> DataFrame:
    """A headered table by explicit schema; absent gives an empty frame unless must_exist; with name, all files of that name below path, in one scan."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False)
    if name:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    try:
        return reader.csv(path)
    except AnalysisException as e:
        if must_exist or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_named(spark: SparkSession, paths: list[str], schema: str, sep: str = ",") -> DataFrame:
    """Columns of schema by the names in the headers of files, in whatever order; those that a file lacks are null, fields that do not parse too.

    No path, or files without a byte, give an empty frame; bytes that are not UTF-8 are replaced.
    """
    fields = StructType.fromDDL(schema).fields
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(paths) if paths else None
    if raw is None or not raw.columns:
        return spark.createDataFrame([], schema)
    return raw.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def read_catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Run catalogues as they come, with header and many columns; only those that selection needs. All are text, as in the files."""
    return read_named(spark, paths, CATALOGUE)


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, reference, pos, depth): the first three fields of each line, without a header."""
    return hits(with_ordinal(spark.read.text(path)), DEPTH)


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A published table of PUBLISHED by name."""
    return read_named(spark, [path], PUBLISHED[table])


def keyed_json(documents: DataFrame, value: str, key: str = "key") -> DataFrame:
    """One JSON object whose keys name rows: (position, key, fields of value), in key order of the document."""
    parsed = documents.select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return parsed.select(F.posexplode(F.map_entries("m")).alias("position", "e")).select("position", F.col("e.key").alias(key), "e.value.*")


def keyed_variant(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of documents (value), each one JSON object whose keys name rows of whatever types.

    rows: (position, key, value, kind), position in key order of the document, value a VARIANT, kind its type. bad: the
    documents (value) that do not parse, repeat a key, or are no object; they give no rows. Null documents go to bad too.
    """
    parsed = documents.select("value", F.try_parse_json("value").alias("whole"))
    is_object = F.coalesce(F.schema_of_variant("whole").startswith("OBJECT"), F.lit(False))
    good = parsed.where(is_object).select("whole", F.json_object_keys("value").alias("keys"))
    each = good.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("whole").outer()).select(F.col("key"), F.col("value")))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    rows = each.select((F.array_position("keys", F.col("key")) - 1).cast("int").alias("position"), "key", "value", kind.alias("kind"))
    return rows, parsed.where(~is_object).select("value")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document for each file; documents that do not parse are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def download_plan(runs: DataFrame, urls: Column, md5: Column, size: Column, *keys: str) -> DataFrame:
    """One row for each non-empty url of packed parallel lists."""
    zipped = zip_lists(("url", urls), ("md5", md5), ("bytes", size))
    files = runs.select(*keys, F.explode(F.filter(zipped, lambda x: x["url"] != "")).alias("f"))
    return files.select(*keys, with_scheme(F.col("f.url")).alias("url"), "f.md5", "f.bytes")
