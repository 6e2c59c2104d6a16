"""Frames with the edge rows that every operator must stand."""

from candrank.llm.common import materialize

LONG = "x" * 40_000 + " " + "lorem ipsum dolor sit amet 12 " * 4_000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (4, " \n\t \n", "fr", "s"),
    (5, LONG, "en", "s"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi", None, "s"),
    (7, "été 'll <|endoftext|> 　\U0001f600 don't  password: hunter2hunter2", "fr", None),
    (7, "été 'll <|endoftext|> 　\U0001f600 don't  password: hunter2hunter2", "fr", None),
    (None, "no id here at all", "en", "s"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, fp string, words int, n_words string, line int, place int, kept string, bin int, label int"


def documents(spark, rows=None):
    """With further columns whose names clash with those used inside the operators."""
    data = [(i, t, l, s, len(t or ""), 1, "a", 2, "b", 3, 4, "c", 5, 6) for i, t, l, s in (ROWS if rows is None else rows)]
    return materialize(spark.createDataFrame(data, SCHEMA).repartition(3) if data else spark.createDataFrame([], SCHEMA), "edge")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int, text string, label int")
