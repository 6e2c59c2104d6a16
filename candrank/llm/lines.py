"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its leading tokens (tokens with a digit are variable fields from
the start). At the leaf, tokens at later places that too few of its documents share become variable fields, which gives
the line's template. A line that recurs as it is, or whose later places are fixed for the most part, belongs to a
template; a template that recurs in enough documents is boilerplate: its lines stay in the first document that has it
and are dropped in all others.

The tree is not built line after line: leaf, support of each (leaf, place, token) and template are groupings, so the
result does not depend on order. Lines are masked once, in one scan, and written; all groupings read that table.

Defined results: null text stays null and has no lines; lines without a token, and lines of fewer than min_tokens
tokens, are never dropped; rows are told apart by doc_id and the hash of their text, never by their place in a scan, and
rows equal in both lose the same lines; documents of equal doc_id count once for recurrence; the first document is the
least doc_id, null last. Masked lines are told apart by two 64-bit hashes, of the whole and of the leaf: with 10 billion
different lines the chance that any two are mixed up is below one in a million.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import WORD_BREAK, materialize, table

FIELD = "<*>"
#: Lines of one leaf or template that one task takes, at most: more of them are dealt to more salts.
LINES_A_SALT = 4_000_000
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class TemplateParams:
    """min_documents: documents that a template, and a fixed token, recur in; leaf_share: least share of a leaf's lines for a
    fixed token; fixed_share and min_fixed: fixed tokens among the places below the tree, for lines that do not recur as they are."""

    depth: int = 3
    min_documents: int = 5
    min_tokens: int = 3
    fixed_share: float = 0.6
    min_fixed: int = 2
    leaf_share: float = 0.2
    salts: int = 16


def masked(line: Column) -> Column:
    """The line's tokens with one blank between them; tokens with a digit are variable fields."""
    plain = F.trim(F.regexp_replace(line, f"{WORD_BREAK}+", " "))
    tokens = F.transform(F.split(plain, " ", -1), lambda w: F.when(w.rlike("[0-9]"), FIELD).otherwise(w))
    return F.when(plain.rlike("[0-9]"), F.array_join(tokens, " ")).otherwise(plain)


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), *(F.get(tokens, i) for i in range(depth)))


def _spread(df: DataFrame, salts: int) -> DataFrame:
    """Each row once for each salt, so that a hot key of the other side is dealt to many tasks; never broadcast, as it grows with the corpus."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")


def masked_lines(docs: DataFrame, params: TemplateParams) -> DataFrame:
    """(row, doc_id, place, leaf, line, words): the lines of enough tokens of docs (row, doc_id, text); written once."""
    each = docs.select("row", "doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), masked)).alias("place", "words"))
    tokens = F.split("words", " ", -1)
    found = each.select("row", "doc_id", "place", "words", tokens.alias("tokens")).where(F.size("tokens") >= params.min_tokens)
    return materialize(found.select("row", "doc_id", "place", _leaf(F.col("tokens"), params.depth).alias("leaf"), F.xxhash64("words").alias("line"), "words"), "lines")


def templates(lines: DataFrame, params: TemplateParams) -> DataFrame:
    """(leaf, line, template): hashes of masked lines that belong to a template."""
    counts = lines.groupBy("leaf", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf", "line").agg(F.count("*").alias("documents"))
    counts = materialize(counts, "line-counts")  # no text yet; it is needed only of leaves that enough documents reach
    reached = counts.groupBy("leaf").agg(F.sum("documents").alias("n")).where(F.col("n") >= params.min_documents)
    reached = _spread(materialize(reached, "leaves"), params.salts)
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(params.salts)).cast("int")
    wanted = counts.withColumn("salt", salt("line")).join(reached, ["leaf", "salt"]).drop("salt")
    text = lines.select("leaf", "line", "words", salt("row", "place").alias("salt")).join(reached.select("leaf", "salt"), ["leaf", "salt"], "left_semi")
    text = text.groupBy("leaf", "line").agg(F.min("words").alias("words"))
    near = materialize(wanted.join(text, ["leaf", "line"]).select("leaf", "line", "documents", "n", F.split("words", " ", -1).alias("tokens")), "leaf-tokens")
    placed = near.select("leaf", "line", "documents", "n", F.posexplode("tokens").alias("place", "token")).where((F.col("place") >= params.depth) & (F.col("token") != FIELD))
    enough = F.greatest(F.lit(params.min_documents), params.leaf_share * F.max("n"))
    common = placed.groupBy("leaf", "place", "token").agg(F.sum("documents").alias("support"), enough.alias("enough")).where("support >= enough")
    fixed = placed.join(common.select("leaf", "place", "token"), ["leaf", "place", "token"], "left_semi")
    fixed = fixed.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("fixed"))
    rows = near.join(fixed, ["leaf", "line"], "left").select("leaf", "line", "documents", (F.size("tokens") - params.depth).alias("below"), "fixed")
    general = (F.size("fixed") >= params.min_fixed) & (F.size("fixed") >= params.fixed_share * F.col("below"))
    template = F.when(general, F.xxhash64("leaf", "fixed")).when(F.col("documents") >= params.min_documents, F.xxhash64("leaf", "line", F.lit("as it is")))
    return rows.select("leaf", "line", template.alias("template")).where("template IS NOT NULL")


def dropped_lines(docs: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(row, doc_id, places): the lines to drop from each row of docs (row, doc_id, text); rows may repeat."""
    lines = masked_lines(docs, params)
    params = replace(params, salts=max(params.salts, lines.count() // LINES_A_SALT))
    narrow = lines.select("row", "doc_id", "place", "leaf", "line", F.pmod(F.xxhash64("row", "place"), F.lit(params.salts)).cast("int").alias("salt"))
    found = materialize(narrow.join(_spread(templates(lines, params), params.salts), ["leaf", "line", "salt"]).select("template", "row", "doc_id", "place", "salt"), "template-lines")
    pairs = found.groupBy("template", "doc_id").agg(F.lit(1).alias("one"))
    recurring = pairs.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= params.min_documents)
    gone = found.join(_spread(recurring, params.salts), ["template", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def drop_recurring(docs: DataFrame, params: TemplateParams = TemplateParams(), counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with recurring lines dropped from text; all rows and columns stay. counts names two further columns: lines, and lines dropped."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(whole.alias("document"), "doc_id", "text").withColumn("row", F.xxhash64("text"))
    places = dropped_lines(rows.select("row", "doc_id", "text"), params).select(F.col("row").alias("other_row"), F.col("doc_id").alias("other_id"), "places")
    rows = rows.select("document", "doc_id", "row", F.split("text", "\n", -1).alias("lines"))
    joined = rows.join(places, (F.col("row") == F.col("other_row")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    # What is left are the runs between dropped lines: one slice each, in time that grows with the lines.
    before, after = F.concat(F.array(F.lit(-1)), "places"), F.concat("places", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    text = F.array_join(F.when(F.col("places").isNull(), F.col("lines")).otherwise(kept), "\n")
    old = [F.col("document").getField(c).alias(c) if c != "text" else text.alias("text") for c in docs.columns]
    more = [F.coalesce(F.size("lines"), F.lit(0)).cast("long"), F.coalesce(F.size("places"), F.lit(0)).cast("long")]
    return joined.select(*old, *(x.alias(name) for x, name in zip(more, counts or ())))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left) for each document."""
    out = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, place - 1 AS place, line, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)),
m AS (SELECT doc_id, place, line, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
t AS (SELECT *, string_split(masked, ' ') AS tokens FROM m),
k AS (SELECT masked, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS documents FROM t WHERE len(tokens) >= 3 GROUP BY masked),
f AS (SELECT *, {'n': len(tokens), 'a': tokens[1], 'b': tokens[2], 'c': tokens[3]} AS leaf FROM k),
r AS (SELECT leaf, sum(documents) AS total FROM f GROUP BY leaf HAVING sum(documents) >= 5),
n AS (SELECT f.*, r.total FROM f JOIN r ON f.leaf = r.leaf),
p AS (SELECT leaf, masked, documents, total, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM n),
s AS (SELECT leaf, place, token FROM p WHERE place > 3 AND token <> '<*>' GROUP BY leaf, place, token
  HAVING sum(documents) >= 5 AND 5 * sum(documents) >= max(total)),
x AS (SELECT p.masked, count(*) AS fixed, string_agg(p.place || ':' || p.token, ' ' ORDER BY p.place) AS pattern
  FROM p JOIN s ON p.leaf = s.leaf AND p.place = s.place AND p.token = s.token GROUP BY p.masked),
y AS (SELECT n.masked, n.leaf, CASE WHEN x.fixed >= 2 AND 5 * x.fixed >= 3 * (len(n.tokens) - 3) THEN 'general ' || x.pattern
    WHEN n.documents >= 5 THEN 'as it is ' || n.masked END AS pattern
  FROM n LEFT JOIN x ON n.masked = x.masked),
g AS (SELECT y.leaf, y.pattern, t.doc_id, t.place FROM t JOIN y ON t.masked = y.masked WHERE y.pattern IS NOT NULL),
c AS (SELECT leaf, pattern, min(doc_id) AS first FROM g GROUP BY leaf, pattern HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT DISTINCT g.doc_id, g.place FROM g JOIN c ON g.leaf = c.leaf AND g.pattern = c.pattern WHERE g.doc_id <> c.first)
SELECT l.doc_id, count(*) AS n_lines, count(d.place) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE d.place IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.place = d.place GROUP BY l.doc_id
"""
