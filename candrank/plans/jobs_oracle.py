"""DuckDB SQL with the results of the queries of jobs.py."""

from __future__ import annotations

from candrank.plans.oracle import _CANDIDATES, _ORDER, ORACLE_SQL as _FIRST

_MEMBERS = f"""m AS (SELECT l_orderkey AS lineage, l_linenumber AS i, l_suppkey AS run, l_returnflag IN ('A', 'N') AS complete, l_discount * 1000 AS pident, l_returnflag FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, {_ORDER}) AS k FROM lineitem) WHERE k = 1)"""
_RANKED = f"""a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS k FROM lineitem WHERE l_linenumber < 7),
b AS (SELECT l_partkey, l_suppkey, min(k) AS k FROM a GROUP BY ALL), c AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY k) AS r FROM b)"""
_DISTANCE = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"

ORACLE_SQL = {
    "replication_summary": f"""WITH {_MEMBERS},
s AS (SELECT a.lineage, count(*) AS strong FROM m a JOIN m b ON a.lineage = b.lineage AND a.i < b.i AND a.run <> b.run AND (a.run - b.run) % 2 = 0 GROUP BY a.lineage),
g AS (SELECT lineage, count(*) AS member_count, count(DISTINCT run) AS distinct_runs, string_agg(DISTINCT CAST(run AS VARCHAR), ';' ORDER BY CAST(run AS VARCHAR)) AS runs, bool_and(complete) AS all_complete,
  round(min(pident), 3) AS min_value, round(max(pident), 3) AS max_value FROM m GROUP BY lineage)
SELECT g.*, coalesce(strong, 0) AS strong_cross_run_pairs, CASE WHEN distinct_runs >= 2 AND all_complete AND coalesce(strong, 0) >= 1 THEN 'strong' ELSE 'not_established' END AS cross_run_replication
FROM g LEFT JOIN s ON g.lineage = s.lineage""",
    "homolog_lists": f"""WITH {_RANKED}, l AS (SELECT l_partkey, string_agg(l_suppkey, ';' ORDER BY r) AS subjects FROM c WHERE r <= 4 GROUP BY l_partkey)
SELECT 'p ' || p_partkey AS id, coalesce(subjects, '') AS subjects FROM part LEFT JOIN l ON p_partkey = l_partkey""",
    "homolog_bundles": f"""WITH {_RANKED}, x AS (SELECT 'p_' || p_partkey AS query, 'candidate|p ' || p_partkey || '|CANDIDATE' AS record, 0 AS h FROM part
UNION ALL SELECT 'p_' || l_partkey, 'homolog|' || s_name, 1 FROM c JOIN supplier ON l_suppkey = s_suppkey WHERE r <= 4)
SELECT query, string_agg(record, ',' ORDER BY record) AS records, CAST(sum(h) AS BIGINT) AS retrieved FROM x GROUP BY query""",
    "headline": f"WITH {_CANDIDATES} SELECT (SELECT count(DISTINCT p_brand) FROM part) AS completed_accessions, count(*) AS candidates, count(*) FILTER (WHERE high_interest_screen) AS high_interest FROM c",
    "ranked_report": f"""WITH {_CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY high_interest_screen DESC, coalesce(pident, -1), palm_score DESC, aa_length DESC, p_partkey) AS rank FROM c)
SELECT CAST(rank AS INTEGER) AS rank, CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CAST(subject AS VARCHAR), 'NA') AS subject, coalesce(CAST(CAST(round(pident, 3) AS DECIMAL(9, 3)) AS VARCHAR), 'NA') AS identity,
coalesce(CAST(CAST(round(palm_score, 3) AS DECIMAL(9, 3)) AS VARCHAR), 'NA') AS score, novelty_screen FROM o WHERE rank <= 50""",
    "flag_counts": "WITH f AS (SELECT event_type, event_id % 4096 AS flag FROM events) SELECT event_type, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE flag & {bit} = {bit}) AS {name}" for name, bit in (("paired", 1), ("proper", 2), ("unmapped", 4), ("reverse", 16), ("secondary", 256), ("qc_fail", 512), ("duplicate", 1024), ("supplementary", 2048)))
    + " FROM f GROUP BY event_type",
    "low_rmsd_share": f"WITH p AS ({_FIRST['pose_rmsd']}) SELECT label, round(avg(median_pairwise_rmsd), 4) AS mean_median_rmsd, round(avg(CAST(pose_cluster_low_rmsd AS INTEGER)), 4) AS low_rmsd_system_fraction FROM p GROUP BY label",
    "pose_contacts": f"""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS system, vec_id % 53 AS residue, vec_id % 2 AS chain, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z
  FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT a.system, a.vec_id AS seed, b.chain, b.residue, {_DISTANCE} AS distance FROM e a LEFT JOIN e b ON a.system = b.system AND b.vec_id % 5 <> 0 WHERE a.vec_id % 5 = 0),
g AS (SELECT system, seed, count(DISTINCT residue) FILTER (WHERE distance <= 2.5 AND chain = 0) AS contacts_1, count(DISTINCT residue) FILTER (WHERE distance <= 2.5 AND chain = 1) AS contacts_2,
  round(min(distance) FILTER (WHERE residue = 50), 6) AS distance_site FROM m GROUP BY ALL)
SELECT *, contacts_1 + contacts_2 AS contacts, contacts_1 >= 1 AND contacts_2 >= 1 AS dual_chain, contacts_1 >= 2 AND contacts_2 >= 2 AND contacts_1 + contacts_2 >= 5 AS strong_cleft, coalesce(distance_site <= 3, FALSE) AS near_site FROM g""",
    "published": f"""WITH v AS ({_FIRST['verdict_table']})
SELECT ligand_std || ' x' AS compound, CASE WHEN ligand_std <> 'R' THEN lower(ligand_std) END AS herb, n AS n_poses, -5.8 AS mean_score, 0.26 AS sd, "mean_LE" AS ligand_eff, dual_percent AS dual_chain_contact_percent, 90 AS strong_cleft_contact_percent,
38 AS pose_repro_percent, 3.4 AS mean_contacts_1, 2.3 AS mean_contacts_2, 8.2 AS mean_dist_site FROM v""",
    "table_roundtrip": """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_custkey % 3 > 0) AS with_customer, CAST(sum(o_custkey) FILTER (WHERE o_custkey % 3 > 0) AS BIGINT) AS customers,
count(*) FILTER (WHERE o_totalprice > 1000) AS complete FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') GROUP BY o_orderpriority""",
    "depth_scan": """WITH d AS (SELECT l_partkey, CAST(trunc(l_quantity) AS BIGINT) AS pos, max(l_linenumber) AS depth FROM lineitem GROUP BY ALL),
g AS (SELECT l_partkey, count(*) FILTER (WHERE depth >= 1) AS covered, sum(depth) AS total FROM d JOIN part ON l_partkey = p_partkey WHERE pos BETWEEN 1 AND p_size GROUP BY l_partkey)
SELECT 'p' || p_partkey AS reference, CAST(p_size AS BIGINT) AS reference_length, coalesce(round(covered / p_size, 6), 0) AS breadth_1x, coalesce(round(total / p_size, 6), 0) AS mean_depth, p_size - coalesce(covered, 0) AS zero_bases
FROM part LEFT JOIN g ON p_partkey = l_partkey""",
    "hit_table_2": """SELECT CAST(l_partkey AS VARCHAR) AS qseqid, count(*) AS hits, count(*) FILTER (WHERE l_linenumber <> 1) AS with_qcov, count(*) FILTER (WHERE l_orderkey % 4 > 1) AS with_title, min(1e-9) AS evalue, CAST(sum(l_linenumber) AS DOUBLE) AS bitscore
FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_partkey""",
    "run_files": """WITH x AS (SELECT 'R' || o_orderkey AS run_accession, 'https://h/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS read_count FROM orders
UNION ALL SELECT 'R' || o_orderkey, 'http://h/' || o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END FROM orders WHERE o_orderkey % 3 = 0)
SELECT run_accession, url, '' AS md5, '' AS bytes, read_count FROM x""",
    "json_roundtrip": f"WITH {_CANDIDATES} SELECT p_brand AS accession, count(*) AS candidates, count(*) FILTER (WHERE high_interest_screen) AS high_interest FROM c GROUP BY p_brand",
    "motif_table": f"WITH {_MEMBERS} SELECT CASE l_returnflag WHEN 'R' THEN 'ACB' WHEN 'A' THEN 'CAB' ELSE 'ABC' END AS \"pssm_ABC\", count(*) AS members, count(*) FILTER (WHERE complete) AS complete FROM m GROUP BY 1",
    "usable_runs": """SELECT 'ERR' || o_orderkey AS run, floor(o_totalprice / 50) AS size_mb, 'unknown' AS bioproject FROM orders
WHERE o_orderstatus <> 'P' AND (o_orderstatus = 'O' OR o_orderkey % 3 = 0) AND floor(o_totalprice / 50) <= 4500""",
    "bundle_files": f"""WITH {_RANKED}
SELECT 'p_' || p_partkey AS query, CAST(0 AS BIGINT) AS place, 'p ' || p_partkey || '|CANDIDATE' AS header FROM part
UNION ALL SELECT 'p_' || l_partkey, r, s_name FROM c JOIN supplier ON l_suppkey = s_suppkey WHERE r <= 4""",
    "catalogue_pushed": """WITH r AS (SELECT o_orderpriority AS label, 'SRR' || o_orderkey AS run, strftime(o_orderdate, '%Y-%m-%d') AS release_date, o_orderstatus AS organism,
  CASE WHEN o_orderkey % 3 = 0 THEN 'RNA-Seq' ELSE 'WGS' END AS library_strategy, CASE WHEN o_orderkey % 2 = 0 THEN 'TRANSCRIPTOMIC' END AS library_source, CAST(o_custkey AS VARCHAR) AS bioproject FROM orders)
SELECT label, run, release_date, organism, library_strategy, library_source, bioproject FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY release_date DESC, run) AS k FROM r
  WHERE organism IN ('O', 'F') AND release_date BETWEEN '1995-01-15' AND '1996-11-30' AND (library_strategy = 'RNA-Seq' OR library_source = 'TRANSCRIPTOMIC')) WHERE k <= 50""",
    "incremental_rank": f"""WITH {_CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY high_interest_screen DESC, coalesce(pident, -1), palm_score DESC, aa_length DESC, p_partkey) AS rank FROM c)
SELECT CAST(rank AS INTEGER) AS rank, CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CAST(subject AS VARCHAR), 'NA') AS subject, coalesce(CAST(CAST(round(pident, 3) AS DECIMAL(9, 3)) AS VARCHAR), 'NA') AS identity,
coalesce(CAST(CAST(round(palm_score, 3) AS DECIMAL(9, 3)) AS VARCHAR), 'NA') AS score, novelty_screen FROM o WHERE rank <= 50""",
    "file_digests": """WITH v AS (SELECT s_suppkey, s_name || '|' || CAST(CAST(s_acctbal AS DECIMAL(15, 2)) AS VARCHAR) || chr(10) AS value FROM supplier),
f AS (SELECT CAST(s_suppkey AS BIGINT) AS supplier, value FROM v UNION ALL SELECT -1, string_agg(value, '' ORDER BY s_suppkey) FROM v)
SELECT supplier, strlen(value) AS bytes, sha256(value) AS sha256, md5(value) AS md5 FROM f""",
    "running_groups": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN '> ' ELSE ';' END || o_orderkey AS header, count(l_orderkey) AS lines, CAST(coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)), 0) AS BIGINT) AS quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "keyed_variant": """WITH e AS (SELECT event_id AS id, event_id % 7 = 0 OR event_id % 11 = 0 AS bad FROM events WHERE props IS NOT NULL),
r AS (SELECT 'z' AS key, 'OBJECT' AS kind, 0 AS position, 0 AS v FROM e WHERE NOT bad
UNION ALL SELECT 'n', CASE id % 5 WHEN 0 THEN 'DECIMAL' WHEN 1 THEN 'STRING' WHEN 2 THEN 'VOID' WHEN 3 THEN 'ARRAY' ELSE 'BIGINT' END, 1, 0 FROM e WHERE NOT bad
UNION ALL SELECT 'id', 'BIGINT', 2, id FROM e WHERE NOT bad)
SELECT key, kind, CAST(position AS INTEGER) AS position, count(*) AS n, CAST(sum(v) AS BIGINT) AS ids FROM r GROUP BY ALL UNION ALL SELECT 'bad', '', -1, count(*), 0 FROM e WHERE bad""",
    "sql_novelty": _FIRST["novelty_distribution"],
    "sql_homologs": f"WITH {_RANKED} SELECT 'p_' || l_partkey AS name, CAST(r AS INTEGER) AS rank, CAST(l_suppkey AS VARCHAR) AS value FROM c WHERE r <= 4",
    "reference_coverage": """WITH a AS (SELECT l_partkey AS k, CAST(floor(l_quantity) AS BIGINT) - 3 AS s, CAST(floor(l_quantity) AS BIGINT) - 3 + l_linenumber * 3 AS e, l_suppkey % 61 AS q FROM lineitem WHERE (l_orderkey % 4096) & 1796 = 0),
p AS (SELECT k, unnest(generate_series(s, e - 1)) AS pos FROM a),
g AS (SELECT k, count(*) AS n, count(DISTINCT pos) AS covered FROM p JOIN part ON k = p_partkey WHERE pos >= 0 AND pos < p_size * 3 GROUP BY k),
r AS (SELECT k, count(*) AS reads, avg(q) AS q FROM a GROUP BY k)
SELECT p_partkey AS reference, CAST(p_size * 3 AS BIGINT) AS length, coalesce(reads, 0) AS reads, coalesce(covered, 0) AS covered_bases, coalesce(round(covered * 100 / (p_size * 3), 6), 0) AS coverage,
coalesce(round(n / (p_size * 3), 6), 0) AS mean_depth, coalesce(round(r.q, 6), 0) AS mean_mapq FROM part LEFT JOIN g ON p_partkey = g.k LEFT JOIN r ON p_partkey = r.k""",
    "flag_summary": "WITH f AS (SELECT event_type, event_id % 4096 AS flag FROM events) "
    + " UNION ALL ".join(
        f"SELECT event_type, '{name}' AS category, count(*) FILTER (WHERE {c} AND flag & 512 = 0) AS passed, count(*) FILTER (WHERE {c} AND flag & 512 = 512) AS failed FROM f GROUP BY event_type"
        for name, c in (
            ("total", "TRUE"), ("primary", "flag & 2304 = 0"), ("secondary", "flag & 256 = 256"), ("supplementary", "flag & 2304 = 2048"), ("duplicates", "flag & 1024 = 1024"), ("primary duplicates", "flag & 3328 = 1024"),
            ("mapped", "flag & 4 = 0"), ("primary mapped", "flag & 2308 = 0"), ("paired", "flag & 2305 = 1"), ("read1", "flag & 2369 = 65"), ("read2", "flag & 2433 = 129"), ("properly paired", "flag & 2311 = 3"),
            ("with itself and mate mapped", "flag & 2317 = 1"), ("singletons", "flag & 2317 = 9"),
        )
    ),
    "crowded_contacts": f"""WITH e AS (SELECT label % 2 AS system, vec_id, CASE WHEN vec_id % 2 = 0 THEN 0.4 ELSE 20 END::DOUBLE AS s, CAST(embedding[1] AS DOUBLE) * s AS x, CAST(embedding[2] AS DOUBLE) * s AS y, CAST(embedding[3] AS DOUBLE) * s AS z
  FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT a.system, a.vec_id, b.vec_id AS other, {_DISTANCE} AS distance FROM e a JOIN e b ON a.system = b.system)
SELECT system, vec_id, count(*) AS n, CAST(sum(other) AS BIGINT) AS ids, round(max(distance), 6) AS farthest FROM m WHERE distance <= 0.75 GROUP BY system, vec_id""",
    "published_scan": """SELECT s_name || ', é' AS compound, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 40 END AS n_poses, round(s_acctbal / 1000, 2) AS mean_score, s_suppkey % 3 AS violations,
CASE WHEN s_suppkey % 7 > 0 THEN 'none' END AS flag, round(s_acctbal) / 4 AS distance, CAST(NULL AS VARCHAR) AS herb FROM supplier""",
    "target_runs": """WITH o(organism, label, i) AS (VALUES ('Glycyrrhiza glabra', 'glycyrrhiza', 0), ('Glycyrrhiza uralensis', 'glycyrrhiza', 1), ('Panax ginseng', 'panax', 2), ('Panax notoginseng', 'panax', 3), ('Panax quinquefolius', 'panax', 4),
  ('Platycodon grandiflorus', 'platycodon', 5), ('Rehmannia glutinosa', 'rehmannia', 6), ('Schisandra chinensis', 'schisandra', 7), ('Scutellaria baicalensis', 'scutellaria', 8))
SELECT label, organism, count(*) AS runs FROM o JOIN orders ON o_orderkey % 9 = i GROUP BY ALL
UNION ALL SELECT 'positive_control', 'Waxsystermes-associated sample', 0 UNION ALL SELECT 'panax_legacy', 'Panax ginseng', 0""",
    "output_manifest": """WITH f AS (SELECT s_nationkey, string_agg(s_suppkey || '|' || s_name || chr(10), '' ORDER BY s_suppkey) AS value FROM supplier GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS BIGINT) AS nation, strlen(value) AS bytes, sha256(value) AS sha256 FROM f UNION ALL SELECT -1, 1, 'same'""",
    "empty_outputs": """SELECT status, skip_empty, count(o_orderkey) AS rows, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys
FROM (VALUES ('O'), ('F'), ('none')) AS s(status) CROSS JOIN (VALUES (FALSE), (TRUE)) AS k(skip_empty) LEFT JOIN orders ON o_orderstatus = status GROUP BY ALL""",
    "near_identical": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount * 1000 >= 90 AND l_quantity * 2 >= 80) AS known, count(*) AS n FROM lineitem GROUP BY l_returnflag",
}
