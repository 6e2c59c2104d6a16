"""Secret scans: fixed patterns, and a randomness battery with length-aware false-discovery control.

Base spans are the fixed patterns. The method adds spans: candidate strings without blanks, of 16 characters or more and
of any length, get an inferred encoding. Chi-squared uniformity over its alphabet, a runs test about the middle of the
alphabet and lag-one serial correlation must all accept randomness. The evidence against an ordinary string grows with
its length: how much likelier the string is under uniform draws from the encoding than under the pairs of neighbouring
characters that the shorter words of the corpus have. By Markov's inequality one over that ratio is a p-value, whatever the
length. A Benjamini-Hochberg threshold over the p-values of all candidates of the corpus controls false discoveries;
candidates that a test refuses have p-value 1, so what is reported is what the threshold finds.

The model of ordinary strings keeps a tenth of its weight for any neighbour whatever, so that names of a kind the corpus
has not seen do not look random at once. It is one table of fixed size, counted over all documents.

Defined results: null or empty text has no spans; offsets are code points; a span found by the method that overlaps a
base span is dropped in favour of the base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candrank.llm.common import id_and_text, materialize, table

#: Fixed by the contract: kind, pattern, and the least length of the text that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

SHORTEST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}(?![A-Za-z0-9+/_-])")
#: Encodings from the narrowest: name and alphabet in order.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("hex upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
PLACES = [({c: i for i, c in enumerate(alphabet)}, len(alphabet)) for _, alphabet in ENCODINGS]
BINS = 4000
PIECE = 1 << 20
#: Folded characters of the model: letters without case, any digit, four signs; what is none of them ends a word.
DIGIT, OTHER = 26, 31
FOLD = np.full(256, OTHER, dtype=np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(26)
FOLD[48:58] = DIGIT
FOLD[list(b"+/_-")] = np.arange(27, 31)
#: 0 lower, 1 upper, 2 neither.
CASE = np.full(256, 2, dtype=np.uint8)
CASE[97:123], CASE[65:91] = 0, 1


@dataclass(frozen=True)
class BatteryParams:
    """accept: least p-value of each test under randomness; fdr: share of false discoveries over the corpus; floor: weight of unseen neighbours."""

    accept: float = 0.002
    fdr: float = 0.01
    floor: float = 0.1


def _upper(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def neighbours(text: str) -> np.ndarray:
    """Counts of neighbouring folded characters (32 x 32) and of neighbouring cases (3 x 3), end to end.

    Strings as long as a candidate are left out, so that keys and encoded files, however many, are no model of ordinary words.
    """
    x = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
    fold, case = FOLD[x], CASE[x]
    ends = np.concatenate([[-1], np.flatnonzero(fold == OTHER), [len(x)]])
    for k in np.flatnonzero(np.diff(ends) > SHORTEST):
        fold[ends[k] + 1 : ends[k + 1]], case[ends[k] + 1 : ends[k + 1]] = OTHER, 2
    out = np.zeros(32 * 32 + 9, dtype=np.int64)
    for at in range(0, len(x), PIECE):
        f, c = fold[max(0, at - 1) : at + PIECE].astype(np.int64), case[max(0, at - 1) : at + PIECE].astype(np.int64)
        out[:1024] += np.bincount(f[:-1] * 32 + f[1:], minlength=1024)
        out[1024:] += np.bincount(c[:-1] * 3 + c[1:], minlength=9)
    return out


@dataclass(frozen=True)
class Ordinary:
    """Log-probabilities of a character after another in ordinary strings."""

    fold: np.ndarray
    case: np.ndarray

    @classmethod
    def learn(cls, counts: np.ndarray, floor: float) -> Ordinary:
        fold = counts[:1024].reshape(32, 32)[:OTHER, :OTHER] + 0.5
        fold = (1 - floor) * fold / fold.sum(axis=1, keepdims=True) + floor / OTHER
        fold[:, DIGIT] /= 10  # each digit alike
        case = counts[1024:].reshape(3, 3)[:, :2] + 0.5
        return cls(np.log(fold), np.log((1 - floor) * case / case.sum(axis=1, keepdims=True) + floor / 2))

    def logp(self, s: str) -> float:
        """Of all characters but the first, given the one before."""
        x = np.frombuffer(s.encode("ascii"), dtype=np.uint8)
        fold, case = FOLD[x], CASE[x]
        letter = case[1:] < 2
        return float(self.fold[fold[:-1], fold[1:]].sum() + self.case[case[:-1][letter], case[1:][letter]].sum())


def battery(s: str) -> tuple[float, int] | None:
    """(least p-value of the tests under randomness, size of the alphabet); None if of no encoding."""
    for places, k in PLACES:
        if all(c in places for c in s):
            break
    else:
        return None
    x = np.fromiter((places[c] for c in s), dtype=np.int64, count=len(s))
    n = len(x)
    counts = np.bincount(x, minlength=k)
    pairs = float((counts * (counts - 1)).sum())  # coincidences: chi-squared up to shift and scale, and normal also where counts are small
    mean, var = n * (n - 1) / k, 2.0 * n * (n - 1) / k * (1 - 1 / k)
    uniform = _upper((pairs - mean) / sqrt(var))
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        return 0.0, k
    runs, expected = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
    spread = sqrt(max(1e-9, (expected - 1) * (expected - 2) / (n - 1)))
    run = 2 * _upper(abs(runs - expected) / spread)
    d = x - x.mean()
    serial = 2 * _upper(abs(float((d[1:] * d[:-1]).sum() / max(1e-9, float((d * d).sum()))) * sqrt(n) + 1 / sqrt(n)))
    return min(uniform, run, serial), k


def p_value(s: str, least: float, k: int, model: Ordinary, params: BatteryParams) -> float:
    """That an ordinary string looks this random; 1 if a test refuses randomness. The encoding is the best of several."""
    if least < params.accept:
        return 1.0
    ratio = model.logp(s) + (len(s) - 1) * np.log(k) + np.log(len(ENCODINGS))
    return float(np.exp(min(0.0, ratio)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float, int]]:
    """(start, end, least p-value of the tests, size of the alphabet) of strings of an encoding outside the base spans."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][2] <= m.start() and all(b <= m.start() for _, _, b in base[k : k + 3]):
            k += 1
        if any(a < m.end() and m.start() < b for a, _, b in base[k:]):
            continue
        p = battery(m.group())
        if p:
            out.append((m.start(), m.end(), *p))
    return out


def _with_found(docs: DataFrame) -> DataFrame:
    """docs with a further column, found: what the scan finds in text, which may be null."""
    kind = to_arrow_schema(StructType.fromDDL(f"x {FOUND}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scan([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=kind)], names=[*batch.schema.names, "found"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"found {FOUND}").fields]))


def _scan(texts: list[str]) -> list[dict]:
    """Of each text its base spans, end to end, and its candidates with their strings; of the batch the counts of neighbours, with its first text."""
    found, counts = [], 0
    for t in texts:
        base = base_spans(t)
        more = candidates(t, base)
        found.append({"base": [v for x in base for v in x], "more": [{"start": a, "end": b, "least": p, "k": k, "s": t[a:b]} for a, b, p, k in more], "counts": None})
        counts = counts + neighbours(t)
    if texts:
        found[0]["counts"] = counts
    return found


FOUND = "struct<base:array<int>,more:array<struct<start:int,end:int,least:double,k:int,s:string>>,counts:array<bigint>>"


def _model(found: DataFrame, params: BatteryParams) -> Ordinary:
    sums = found.where(F.col("found.counts").isNotNull()).select(F.posexplode("found.counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(32 * 32 + 9)
    for at, n in sums:
        counts[at] = n
    return Ordinary.learn(counts, params.floor)


def discovery_threshold(found: DataFrame, model: Ordinary, params: BatteryParams) -> float:
    """Benjamini-Hochberg over all candidates from a histogram of log p-values with a fixed number of bins."""

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for more in batch.column(0).to_pylist():
                for x in more:
                    p = p_value(x["s"], x["least"], x["k"], model, params)
                    n[min(BINS - 1, int(-np.log10(max(p, 1e-300)) * (BINS / 40)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["bin", "n"])

    rows = found.where(F.size("found.more") > 0).select(F.col("found.more").alias("more"))
    bins = dict(rows.mapInArrow(depths, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n")).collect())
    total, seen, out = sum(bins.values()), 0, 0.0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        bound = 10 ** (-b * 40 / BINS)  # the largest p-value of the bin
        if bound <= params.fdr * seen / total:
            out = bound
    return out


def _spans(x: dict, most: float, model: Ordinary, params: BatteryParams) -> list[tuple[int, int, int]]:
    base = x["base"]
    out = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
    return sorted(out + [(c["start"], 3, c["end"]) for c in x["more"] if p_value(c["s"], c["least"], c["k"], model, params) <= most])


def _found(docs: DataFrame, params: BatteryParams, *unused: str) -> tuple[DataFrame, Ordinary, float]:
    found = materialize(_with_found(docs).drop(*unused), "secrets")
    model = _model(found, params)
    return found, model, discovery_threshold(found, model, params)


def secret_spans(docs: DataFrame, params: BatteryParams = BatteryParams()) -> DataFrame:
    """(doc_id, spans array<struct<start,kind,end>>) for each row of docs, by start, then kind; kind numbers index KINDS."""
    found, model, most = _found(id_and_text(docs), params, "text")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            got = [[{"start": a, "kind": k, "end": b} for a, k, b in _spans(x, most, model, params)] for x in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, kind)], names=["doc_id", "spans"])

    some = found.where((F.size("found.base") > 0) | (F.size("found.more") > 0)).select("doc_id", F.struct("found.base", "found.more").alias("found"))
    none = found.where((F.size("found.base") == 0) & (F.size("found.more") == 0))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    made = some.mapInArrow(spans, f"doc_id {doc_id}, spans array<struct<start:int,kind:int,end:int>>")
    return made.unionByName(none.select("doc_id", F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans")))


def redact(docs: DataFrame, params: BatteryParams = BatteryParams(), mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark; rows and other columns stay. Texts without secrets are untouched.

    The threshold is that of the corpus, as in secret_spans. What the scan finds is written with the row, so rows need no key.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("document")
    found, model, most = _found(docs.select(rest, "text"), params)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, x in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                if t:
                    out, at = [], 0
                    for a, _, b in _spans(x, most, model, params):
                        if b > at:
                            out += [t[at : max(a, at)], mark if a >= at else ""]
                            at = b
                    t = "".join(out) + t[at:]
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(texts, pa.string())], names=["document", "text"])

    empty = (F.size("found.base") == 0) & (F.size("found.more") == 0)
    rows = found.select("document", "text").schema
    cleaned = found.where(~empty).mapInArrow(clean, rows).unionByName(found.where(empty).select("document", "text"))
    return cleaned.select(*(F.col("document").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = secret_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
