"""DuckDB SQL with the results of the queries; written on its own, from the meaning of each."""

from __future__ import annotations

_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _first(flag: str = "") -> str:
    where = f"WHERE l_returnflag = '{flag}'" if flag else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS k FROM lineitem {where}) WHERE k = 1"


_CANDIDATES = f"""
h AS (SELECT l_partkey, l_suppkey AS subject, l_discount * 1000 AS pident, l_quantity * 2 AS qcov FROM ({_first()})),
c AS (SELECT p_partkey, p_brand, p_retailprice - 900 AS palm_score, p_size * 5 AS aa_length, subject, pident, qcov,
  CASE WHEN pident IS NULL THEN 'no_PALMdb_hit' WHEN qcov < 40 THEN 'weak_partial_hit' WHEN pident < 35 THEN 'very_divergent_lt35pct'
    WHEN pident < 50 THEN 'divergent_35_50pct' WHEN pident < 70 THEN 'moderate_50_70pct' WHEN pident < 90 THEN 'close_70_90pct' ELSE 'PALMdb_sOTU_level_ge90pct' END AS novelty_screen,
  (p_retailprice - 900 >= 75) AND (pident IS NULL OR pident < 50) AND (qcov IS NULL OR qcov >= 40) AND p_size * 5 >= 90 AS high_interest_screen
  FROM part LEFT JOIN h ON p_partkey = l_partkey)"""

_CATALOGUE = """
r AS (SELECT o_orderpriority AS label, (CASE WHEN o_orderstatus = 'P' THEN 'XRR' ELSE 'SRR' END) || o_orderkey AS run,
  CASE WHEN o_orderstatus = 'O' THEN 'RNA-Seq' ELSE 'WGS' END AS strategy, CASE WHEN o_orderkey % 3 = 0 THEN 'transcriptomic' ELSE 'GENOMIC' END AS source,
  round(o_totalprice / 100, 2) AS size_mb, 'P' || o_custkey AS bioproject, strftime(o_orderdate, '%Y-%m-%d') AS release_date, o_orderkey AS ordinal, o_orderstatus AS organism FROM orders)"""


def _selection(direction: str) -> str:
    return f"""
WITH {_CATALOGUE},
u AS (SELECT * FROM r WHERE run LIKE 'SRR%' AND (upper(strategy) IN ('RNA-SEQ', 'OTHER') OR upper(source) = 'TRANSCRIPTOMIC') AND size_mb <= 4500),
p AS (SELECT label, bioproject, row_number() OVER (PARTITION BY label ORDER BY least(count(*), 10) {direction}, max(release_date) DESC, min(ordinal)) AS best FROM u GROUP BY label, bioproject),
k AS (SELECT u.*, row_number() OVER (PARTITION BY u.label ORDER BY size_mb, run) AS k FROM u JOIN p ON u.label = p.label AND u.bioproject = p.bioproject AND best = 1)
SELECT label, CAST(k AS INTEGER) AS k, run AS accession, bioproject, release_date, size_mb, 'recent replicated RNA-seq' AS reason
FROM k WHERE k <= 3 ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, label, k LIMIT 8
"""


_TEXTS = """x AS (SELECT doc_id, upper(replace(replace(text, ' ', ''), 'ß', 'SS')) AS seq FROM documents),
f AS (SELECT doc_id, length(seq) AS n, length(seq) BETWEEN 600 AND 100000 AND length(regexp_replace(seq, '[^A-Z]', '', 'g')) / length(seq) >= 0.9 AS ok FROM x)"""
_SEQ = f"WITH {_TEXTS} SELECT doc_id, n AS length FROM f WHERE ok"
_SUPPORT = """s AS (SELECT l_partkey AS reference, l_suppkey AS run FROM lineitem GROUP BY ALL
  HAVING max(l_quantity / 50) >= 0.9 AND count(*) * 5 >= 5 AND sum(l_quantity) >= 20)"""
_POSES = """p AS (SELECT l_returnflag AS ligand_std, coalesce(l_linestatus, 'all') AS grid_category, grouping(l_linestatus) AS overall, count(*) AS n, avg(l_extendedprice) AS mean_score,
  stddev_samp(l_extendedprice) AS sd_score, avg(CAST(l_quantity > 10 AS INTEGER)) AS dual, avg(CAST(l_quantity > 15 AS INTEGER)) AS cleft, avg(l_tax) AS tax
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag)))"""
_POINTS = "e AS (SELECT vec_id, label AS system, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings WHERE embedding IS NOT NULL)"
_HIT = "SELECT l_partkey, l_suppkey AS acc, l_discount * 1000 AS pident, l_quantity * 2 AS qcovs, l_extendedprice AS bits, CASE WHEN l_quantity * 2 > 20 THEN 0.0 ELSE 1.0 END AS evalue, l_linestatus = 'O' AS viral, l_linestatus AS status FROM"

_TEXT = "coalesce(CAST({0}.acc AS VARCHAR), '') AS {1}_hit_accession, CASE WHEN {0}.pident IS NULL THEN '' ELSE printf('%.3f', {0}.pident) END AS {1}_hit_identity, CASE WHEN {0}.qcovs IS NULL THEN '' ELSE printf('%.3f', {0}.qcovs) END AS {1}_hit_qcov"
_TAXON = "coalesce(CASE WHEN {0}.viral THEN 'O' ELSE {0}.status END, '') AS {1}_hit_taxon, coalesce(CASE WHEN {0}.viral THEN 'some Virus' WHEN NOT {0}.viral THEN 'cell' END, '') AS {1}_hit_title"
_HITS = ", ".join([_TEXT.format("v", "viral"), _TAXON.format("v", "viral"), _TEXT.format("a", "unrestricted"), _TAXON.format("a", "unrestricted"), _TEXT.format("t", "nt")])
_EVIDENCE = f"""WITH {_SUPPORT}, n AS (SELECT reference, count(*) AS runs, string_agg(run, ';' ORDER BY run) AS names FROM s GROUP BY reference),
v AS ({_HIT} ({_first("A")})), a AS ({_HIT} ({_first("N")})), t AS ({_HIT} ({_first("R")})),
j AS (SELECT p_partkey AS lineage, coalesce(p_name, '') <> '' AND p_size > 3 AND coalesce(p_type, '') <> '' AND coalesce(p_brand, '') <> '' AS motif_complete,
  CASE WHEN p_size > 20 THEN 'strong' WHEN p_size > 10 THEN 'not_established' ELSE 'missing' END AS replication, coalesce(n.runs, 0) AS supported_run_count,
  coalesce(v.pident, 0) >= 90 AND coalesce(v.qcovs, 0) >= 80 OR coalesce(a.pident, 0) >= 90 AND coalesce(a.qcovs, 0) >= 80 OR coalesce(t.pident, 0) >= 95 AND coalesce(t.qcovs, 0) >= 80 AS known,
  CASE WHEN a.l_partkey IS NOT NULL AND v.l_partkey IS NOT NULL THEN a.bits > 1.2 * v.bits AND a.acc <> v.acc AND NOT a.viral WHEN a.l_partkey IS NOT NULL THEN NOT a.viral ELSE FALSE END AS override,
  v.l_partkey IS NOT NULL AND coalesce(v.evalue, 1) <= 1e-5 AS viral,
  coalesce(v.pident, 0) >= 90 AND coalesce(v.qcovs, 0) >= 80 OR coalesce(a.pident, 0) >= 90 AND coalesce(a.qcovs, 0) >= 80 AS protein, coalesce(t.pident, 0) >= 95 AND coalesce(t.qcovs, 0) >= 80 AS nucleotide,
  p_size, p_retailprice, n.names, {_HITS}
  FROM part LEFT JOIN v ON p_partkey = v.l_partkey LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN t ON p_partkey = t.l_partkey LEFT JOIN n ON p_partkey = n.reference)"""
_LABEL = """CASE WHEN known THEN 'currently_known_or_near_identical_sequence' WHEN override THEN 'rejected_or_ambiguous_cellular_match'
  WHEN motif_complete AND replication = 'strong' AND viral AND supported_run_count >= 2 THEN 'supported_unreported_RdRP_lineage_candidate'
  WHEN motif_complete AND replication = 'strong' AND viral THEN 'assembly_replicated_RdRP_candidate_raw_support_incomplete' ELSE 'insufficient_validation' END"""
_DECISIONS = f"""SELECT CAST(lineage AS VARCHAR) AS lineage, {_LABEL} AS decision, replication AS assembly_cross_run_replication, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '0' END AS assembly_distinct_runs,
CAST(supported_run_count AS VARCHAR) AS raw_supported_run_count, coalesce(names, '') AS raw_supported_runs, printf('%.3f', CAST(CASE WHEN p_size > 10 AND p_size % 3 > 0 THEN p_size * 1.5 ELSE p_retailprice / 100 END AS DOUBLE)) AS "minimum_PALMdb_2023_identity",
COLUMNS('^(viral|unrestricted|nt)_hit_'), CAST(protein AS VARCHAR) AS current_near_identical_protein, CAST(nucleotide AS VARCHAR) AS current_near_identical_nucleotide FROM j"""

ORACLE_SQL = {
    "candidate_rank": f"""WITH {_CANDIDATES},
o AS (SELECT *, row_number() OVER (ORDER BY high_interest_screen DESC, pident ASC NULLS FIRST, aa_length DESC, p_partkey) AS rank FROM c)
SELECT CAST(rank AS INTEGER) AS rank, p_partkey, subject, round(pident, 6) AS pident, round(qcov, 6) AS qcov, round(palm_score, 6) AS palm_score, aa_length, novelty_screen, high_interest_screen FROM o WHERE rank <= 20""",
    "novelty_distribution": f"WITH {_CANDIDATES} SELECT novelty_screen, count(*) AS n FROM c GROUP BY novelty_screen",
    "accession_summary": f"""WITH {_CANDIDATES}, g AS (SELECT p_brand, novelty_screen, count(*) AS n, count(*) FILTER (WHERE high_interest_screen) AS hi FROM c GROUP BY ALL)
SELECT p_brand AS accession, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(hi) AS BIGINT) AS high_interest, string_agg(novelty_screen || '=' || n, ';' ORDER BY novelty_screen) AS novelty_counts FROM g GROUP BY p_brand""",
    "first_hit": f"SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM ({_first()})",
    "last_wins": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS k,
min(l_orderkey) OVER (PARTITION BY l_partkey) AS first_orderkey FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, first_orderkey FROM n WHERE k = 1""",
    "top_n_distinct": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS k FROM lineitem),
b AS (SELECT l_partkey, l_suppkey, min(k) AS k FROM a GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY k) AS rank FROM b)
SELECT l_partkey, CAST(rank AS INTEGER) AS rank, l_suppkey FROM c WHERE rank <= 3""",
    "seq_filter": _SEQ,
    "stream_filter": _SEQ,
    "seq_filter_stats": f"WITH {_TEXTS} SELECT count(*) AS records_seen, count(*) FILTER (WHERE ok) AS records_kept, CAST(coalesce(sum(n) FILTER (WHERE ok), 0) AS BIGINT) AS bases_kept, 600 AS min_len, 100000 AS max_len FROM f",
    "fasta_roundtrip": """WITH x AS (SELECT doc_id, lang, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents)
SELECT 'doc' || doc_id AS id, 'doc' || doc_id || ' lang=' || lang AS header, length(seq) AS length, md5(seq) AS seq_md5 FROM x""",
    "run_selection_fewest": _selection("ASC"),
    "run_selection_most": _selection("DESC"),
    "catalogue_filter": f"""WITH {_CATALOGUE}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY release_date DESC, run) AS k FROM r
WHERE organism IN ('O', 'F') AND release_date BETWEEN '1995-01-01' AND '1996-12-31') SELECT label, run, release_date, organism FROM k WHERE k <= 200""",
    "fallback_append": """SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL
SELECT c_custkey, 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "multi_table_union": """WITH u AS (SELECT *, l_quantity > 40 AS hi, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 1000 END AS pident FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')),
k AS (SELECT *, row_number() OVER (ORDER BY hi DESC, coalesce(pident, -1), l_extendedprice DESC, l_linenumber DESC, l_orderkey, l_partkey, l_suppkey, l_tax, l_shipdate) AS rank FROM u)
SELECT CAST(rank AS INTEGER) AS rank, l_orderkey, l_partkey, l_returnflag, round(pident, 6) AS pident, round(l_extendedprice, 2) AS palm_score FROM k WHERE rank <= 50""",
    "pair_enumeration": """WITH m AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey) AS BIGINT) AS i FROM m)
SELECT a.l_partkey, count(*) AS pairs, CAST(sum((a.i * 1000003 + b.i * 10007 + a.l_suppkey * 31 + b.l_suppkey * 37 + a.l_orderkey * 41 + b.l_orderkey * 43) % 1000000007) AS BIGINT) AS digest
FROM n a JOIN n b ON a.l_partkey = b.l_partkey AND a.i < b.i AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_partkey""",
    "pair_candidates": """WITH m AS (SELECT role, conv_id, turn, text, length(text) AS size, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS BIGINT) AS i FROM conversations WHERE text IS NOT NULL),
u AS (SELECT role, i, text[k] AS x, count(*) AS n FROM m, generate_series(1, size) AS g(k) GROUP BY ALL),
b AS (SELECT role, i, text[k:k + 1] AS x, count(*) AS n FROM m, generate_series(1, size - 1) AS g(k) GROUP BY ALL),
p AS (SELECT a.role, a.i AS i_1, b.i AS i_2, a.conv_id AS conv_id_1, a.turn AS turn_1, b.conv_id AS conv_id_2, b.turn AS turn_2, greatest(a.size, b.size) AS size
  FROM m a JOIN m b ON a.role = b.role AND a.i < b.i AND a.conv_id <> b.conv_id AND least(a.size, b.size) >= 0.499995 * greatest(a.size, b.size)),
su AS (SELECT x.role, x.i AS i_1, y.i AS i_2, sum(least(x.n, y.n)) AS n FROM u x JOIN u y ON x.role = y.role AND x.x = y.x AND x.i < y.i GROUP BY ALL),
sb AS (SELECT x.role, x.i AS i_1, y.i AS i_2, sum(least(x.n, y.n)) AS n FROM b x JOIN b y ON x.role = y.role AND x.x = y.x AND x.i < y.i GROUP BY ALL)
SELECT p.role, p.i_1, p.i_2, conv_id_1, turn_1, conv_id_2, turn_2 FROM p JOIN su ON p.role = su.role AND p.i_1 = su.i_1 AND p.i_2 = su.i_2 LEFT JOIN sb ON p.role = sb.role AND p.i_1 = sb.i_1 AND p.i_2 = sb.i_2
WHERE su.n >= 0.899995 * 0.499995 * size AND coalesce(sb.n, 0) >= (0.899995 - 0.100005 - (2 * 0.899995 - 0.100005) / 5) * 0.499995 * size - 1""",
    "lineage_rollup": """WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS runs, count(*) AS member_count, count(DISTINCT o_orderstatus) AS distinct_runs,
bool_and(o_totalprice > 1000) AS all_complete, round(min(o_totalprice), 3) AS min_value, round(max(o_totalprice), 3) AS max_value FROM orders GROUP BY o_custkey) SELECT * FROM s""",
    "depth_from_intervals": """WITH i AS (SELECT user_id AS reference, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS s, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
v AS (SELECT reference, s AS pos, 1 AS d FROM i UNION ALL SELECT reference, s + 1 + k, -1 FROM i),
g AS (SELECT reference, pos, sum(d) AS d FROM v GROUP BY ALL HAVING sum(d) <> 0),
w AS (SELECT reference, pos AS start, lead(pos) OVER (PARTITION BY reference ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY reference ORDER BY pos) AS depth FROM g)
SELECT reference, start, "end", CAST(depth AS BIGINT) AS depth FROM w WHERE "end" IS NOT NULL AND depth > 0""",
    "depth_summary": """WITH b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
pos AS (SELECT s_suppkey AS reference, unnest(generate_series(0, CAST(hi - lo AS BIGINT))) AS p, CAST(hi - lo AS BIGINT) + 1 AS len FROM supplier, b),
r AS (SELECT l_suppkey AS reference, CAST(CAST(l_shipdate AS DATE) - lo AS BIGINT) AS p, l_returnflag AS flag, count(*) AS d FROM lineitem, b GROUP BY ALL),
c AS (SELECT reference, p, d FROM (SELECT *, row_number() OVER (PARTITION BY reference, p ORDER BY flag DESC) AS k FROM r) WHERE k = 1),
f AS (SELECT pos.reference, len, coalesce(d, 0) AS d FROM pos LEFT JOIN c ON pos.reference = c.reference AND pos.p = c.p),
l AS (SELECT reference, max(len) AS len, list(d ORDER BY d) AS s, avg(d) AS m, stddev_pop(d) AS sd, count(*) FILTER (WHERE d >= 1) AS a1, count(*) FILTER (WHERE d >= 5) AS a5, count(*) FILTER (WHERE d >= 10) AS a10, count(*) FILTER (WHERE d = 0) AS z FROM f GROUP BY reference)
SELECT reference, len AS reference_length, round(a1 / len, 6) AS breadth_1x, round(a5 / len, 6) AS breadth_5x, round(a10 / len, 6) AS breadth_10x, round(m, 6) AS mean_depth,
(s[CAST(floor((len - 1) / 2) AS BIGINT) + 1] + s[CAST(ceil((len - 1) / 2) AS BIGINT) + 1]) / 2 AS median_depth, CAST(s[CAST(round_even((len - 1) * 0.1, 0) AS BIGINT) + 1] AS DOUBLE) AS depth_p10,
CAST(s[CAST(round_even((len - 1) * 0.9, 0) AS BIGINT) + 1] AS DOUBLE) AS depth_p90, round(CASE WHEN m > 0 AND len > 1 THEN sd / m ELSE 0 END, 6) AS depth_cv, z AS zero_bases FROM l""",
    "alignment_depth": """WITH i AS (SELECT user_id AS reference, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS s, event_id % 7 AS k FROM events WHERE (event_id % 4096) & 1796 = 0),
v AS (SELECT reference, s AS pos, 1 AS d FROM i UNION ALL SELECT reference, s + 1 + k, -1 FROM i),
g AS (SELECT reference, pos, sum(d) AS d FROM v GROUP BY ALL HAVING sum(d) <> 0),
w AS (SELECT reference, pos AS start, lead(pos) OVER (PARTITION BY reference ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY reference ORDER BY pos) AS depth FROM g)
SELECT reference, start, "end", CAST(depth AS BIGINT) AS depth FROM w WHERE "end" IS NOT NULL AND depth > 0""",
    "reference_counts": """WITH a AS (SELECT user_id, count(*) FILTER (WHERE (event_id % 4096) & 4 = 0) AS mapped, count(*) FILTER (WHERE (event_id % 4096) & 4 = 4) AS unmapped FROM events GROUP BY user_id)
SELECT c_custkey AS reference, CAST(length(c_name) AS INTEGER) AS length, coalesce(mapped, 0) AS mapped, coalesce(unmapped, 0) AS unmapped FROM customer LEFT JOIN a ON c_custkey = user_id""",
    "read_counts": """WITH f AS (SELECT user_id AS reference, event_id % 4096 AS flag, event_id % 61 AS mapq FROM events)
SELECT reference, count(*) AS reads, count(*) FILTER (WHERE flag & 2308 = 0) AS mapped_primary, count(*) FILTER (WHERE flag & 2308 = 0 AND mapq >= 20) AS mapped_mapq20,
count(*) FILTER (WHERE flag & 2308 = 0 AND flag & 2 = 2) AS proper_pair_primary FROM f GROUP BY reference""",
    "supported_runs": f"WITH {_SUPPORT} SELECT reference, count(*) AS supported_run_count, string_agg(run, ';' ORDER BY run) AS supported_runs FROM s GROUP BY reference",
    "decision_label": f"{_EVIDENCE} SELECT lineage, motif_complete, replication, supported_run_count, {_LABEL} AS decision FROM j",
    "decision_table": f"{_EVIDENCE} {_DECISIONS}",
    "lineage_audit": f"""{_EVIDENCE}, z AS ({_DECISIONS}) SELECT lineage, decision, assembly_distinct_runs AS assembly_runs, raw_supported_run_count AS raw_read_runs,
coalesce(nullif(viral_hit_taxon, ''), nullif(viral_hit_accession, ''), 'none') AS current_viral_hit, coalesce(nullif(viral_hit_identity, ''), 'NA') || '/' || coalesce(nullif(viral_hit_qcov, ''), 'NA') AS protein_identity_qcov,
coalesce(nullif(nt_hit_identity, ''), 'NA') || '/' || coalesce(nullif(nt_hit_qcov, ''), 'NA') AS nt_identity_qcov FROM z""",
    "candidate_table": f"""WITH h AS (SELECT l_partkey, l_suppkey AS subject, l_discount * 1000 AS pident, l_quantity * 2 AS qcov, l_extendedprice AS bitscore FROM ({_first()})),
x AS (SELECT *, CASE WHEN p_size > 10 THEN round(p_retailprice - 900, 2) WHEN p_size > 3 THEN 80.0 END AS score FROM part LEFT JOIN h ON p_partkey = l_partkey)
SELECT 'R1' AS accession, p_brand AS target_label, p_type AS bioproject, p_name AS organism, 'c' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '_frame=1' ELSE '' END AS query, 'c' || p_partkey AS nt_contig,
CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS nt_length, p_size * 5 AS aa_length, round(score, 6) AS palm_score, CASE WHEN p_size > 3 THEN 3.0 END AS pssm_score, CASE WHEN p_size > 3 THEN p_type END AS gene,
CASE WHEN p_size > 3 THEN 'ABC' END AS motif_order, CAST(NULL AS VARCHAR) AS confidence, CASE WHEN p_size > 3 THEN 'g' END AS group_guess, CASE WHEN p_size > 3 THEN p_size END AS palmprint_start, CAST(NULL AS INTEGER) AS palmprint_end,
CAST(NULL AS VARCHAR) AS motifs, subject AS best_palmdb_sotu, round(pident, 6) AS pident, round(qcov, 6) AS qcov, CASE WHEN subject IS NOT NULL THEN 50.0 END AS scov, CASE WHEN subject IS NOT NULL THEN 0.001 END AS evalue, round(bitscore, 6) AS bitscore,
CASE WHEN pident IS NULL THEN 'no_PALMdb_hit' WHEN qcov < 40 THEN 'weak_partial_hit' WHEN pident < 35 THEN 'very_divergent_lt35pct'
  WHEN pident < 50 THEN 'divergent_35_50pct' WHEN pident < 70 THEN 'moderate_50_70pct' WHEN pident < 90 THEN 'close_70_90pct' ELSE 'PALMdb_sOTU_level_ge90pct' END AS novelty_screen,
(score IS NULL OR score >= 75) AND (pident IS NULL OR pident < 50) AND (qcov IS NULL OR qcov >= 40) AND p_size * 5 >= 90 AS high_interest_screen FROM x""",
    "annotation_map": """SELECT 'ev' || event_id AS id, CASE WHEN event_id % 3 = 0 OR coalesce(json_extract_string(props, '$.k'), '') = '' THEN 7.0 ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS score,
event_type AS gene, 3 AS n FROM events WHERE event_type IS NOT NULL""",
    "hit_table": """SELECT CAST(l_partkey AS VARCHAR) AS query, count(*) AS hits, count(*) FILTER (WHERE l_linenumber <> 2) AS with_identity,
round(sum(CASE WHEN l_linenumber <> 2 THEN l_quantity END), 2) AS identity, 5 AS qend FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_partkey""",
    "keyed_json": """WITH k AS (SELECT 'a' || event_id AS key, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 0 AS position FROM events WHERE props IS NOT NULL UNION ALL SELECT 'b', 1, 1 FROM events WHERE props IS NOT NULL)
SELECT key, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, max(position) AS position FROM k GROUP BY key""",
    "zip_lists": """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey) AS i FROM d)
SELECT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'http://h/' ELSE 'https://h/' END || l_suppkey AS url, CAST(l_partkey AS VARCHAR) AS md5, CASE WHEN i = 1 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS bytes
FROM k WHERE l_suppkey % 7 <> 0""",
    "safe_names": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages",
    "revcomp": "SELECT doc_id, md5(reverse(translate(regexp_replace(upper(text), '[^ACGTU]', '', 'g'), 'ACGTU', 'TGCAA'))) AS revcomp_md5 FROM documents",
    "digest_manifest": """SELECT CASE WHEN doc_id % 10 = 3 THEN 'unexpected' WHEN doc_id % 10 = 7 THEN 'missing' WHEN doc_id % 10 = 5 AND sha256(text) <> '0' THEN 'mismatch' ELSE 'ok' END AS status,
count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "pose_summary": f"""WITH {_POSES} SELECT ligand_std, grid_category, CAST(overall AS INTEGER) AS overall, n, round(mean_score, 4) AS mean_score, round(sd_score, 4) AS sd_score,
round(dual, 4) AS dual_chain_fraction, round(cleft, 4) AS strong_cleft_fraction, round(tax, 6) AS mean_l_tax FROM p""",
    "pose_rmsd": """WITH e AS (SELECT label, CAST(floor(vec_id / 200) AS BIGINT) AS block, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.label, a.block, sqrt(pow(list_distance(a.v, b.v), 2) / len(a.v)) AS r FROM e a JOIN e b ON a.label = b.label AND a.block = b.block AND a.vec_id < b.vec_id),
m AS (SELECT label, block, avg(r) AS mean, median(r) AS med, max(r) AS most FROM p GROUP BY ALL), n AS (SELECT label, block, count(*) AS n_poses FROM e GROUP BY ALL)
SELECT n.label, n.block, n_poses, round(mean, 5) AS mean_pairwise_rmsd, round(med, 5) AS median_pairwise_rmsd, round(most, 5) AS max_pairwise_rmsd, coalesce(med <= 0.16, FALSE) AS pose_cluster_low_rmsd
FROM n LEFT JOIN m ON n.label = m.label AND n.block = m.block""",
    "contact_join": f"""WITH {_POINTS}, m AS (SELECT a.vec_id, b.vec_id AS o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM e a JOIN e b ON a.system = b.system AND a.vec_id <> b.vec_id)
SELECT vec_id, count(*) FILTER (WHERE o % 2 = 1) AS odd, count(*) FILTER (WHERE o % 2 = 0) AS even, round(min(d), 6) AS nearest FROM m WHERE d <= 1 GROUP BY vec_id""",
    "verdict_table": f"""WITH {_POSES}, r(ligand_std, role, priority_order, atoms) AS (VALUES ('A', 'Main', 1, 24.0), ('N', 'Comparison', 0, 22.0), ('R', 'Control', 2, 20.0))
SELECT p.ligand_std, priority_order, n, round(mean_score / CAST(atoms AS DOUBLE), 3) AS "mean_LE", CAST(round(100 * dual, 0) AS INTEGER) AS dual_percent,
role || ' | Stage16 contact gate: ' || CASE WHEN dual >= 0.75 AND cleft >= 0.75 THEN 'passes' ELSE 'fails' END || ' automated dual-chain/contact screen; pose reproducibility ' || CASE WHEN tax * 12 >= 0.5 THEN 'moderate' ELSE 'variable/manual review needed' END AS stage16_preliminary_verdict
FROM p LEFT JOIN r ON p.ligand_std = r.ligand_std WHERE overall = 1""",
    "grid_gate": f"""WITH {_POINTS}, c AS (SELECT system, vec_id % 2 AS state, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e GROUP BY ALL)
SELECT a.system, a.state AS state_1, b.state AS state_2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance,
round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) <= 0.5 AS comparable FROM c a JOIN c b ON a.system = b.system AND a.state < b.state""",
}
