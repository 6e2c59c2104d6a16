"""Column expressions shared by the operators. ANSI mode is on, so parsing and division use the try_ forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nucleotide codes and their complements.
CODES, COMPLEMENTS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def num(c: Column | str, default: float | None = None) -> Column:
    """Tolerant number: text that does not parse, blank and null give the default; nan stays nan."""
    c = F.col(c) if isinstance(c, str) else c
    value = c.cast("string").try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(blank_to_null, columns))


def shown(c: Column, placeholder: str = "NA") -> Column:
    return F.coalesce(blank_to_null(c.cast("string")), F.lit(placeholder))


def alphabet_share(seq: Column, alphabet: str = "ACGTUN") -> Column:
    """Share of characters in the alphabet; null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(seq, f"[^{alphabet}]", "")), F.length(seq))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def contig_key(query: Column) -> Column:
    return F.substring_index(query, "_frame=", 1)


def zip_lists(*lists: tuple[str, Column], sep: str = ";") -> Column:
    """Packed parallel lists as an array of structs by position; shorter lists are padded with blanks."""
    zipped = F.arrays_zip(*(F.split(c, sep).alias(name) for name, c in lists))
    blank = lambda x, name: F.coalesce(x[name], F.lit("")).alias(name)
    return F.transform(zipped, lambda x: F.struct(*(blank(x, name) for name, _ in lists)))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def has_flags(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) == mask


def lacks_flags(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) == 0


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
