"""Language identification by multilingual mixture inference.

Byte trigrams, hashed to a table of fixed size, are counted for each language over all documents that may be learned
from. A document is a mixture: expectation-maximisation over its words estimates the share of each language from the
trigram likelihoods. Languages join the set in the order of their shares, as long as one of the last two made the
penalised likelihood better; the best set is taken. The prediction is the largest share, the score that share.

Texts are scored in bounded memory: several short ones at once, a long one in slices that each round reads again.

Defined results: null text and text without a letter are `und` with score 0, as is everything if no language could be
learned; ties go to the language that sorts first; equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import held_out, id_and_text, map_texts, table

GRAMS = 1 << 16
CHUNK = 1 << 21
SLICE = 1 << 20
#: Numbers (words times languages) that are held at once, at least one word for every two bytes.
CELLS = 1 << 23


def trigrams(x: np.ndarray, starts: np.ndarray = np.zeros(1, dtype=np.int64)) -> np.ndarray:
    """A bucket for each byte position, from it and the two bytes before; texts of two bytes or more begin at starts and share nothing."""
    y = x.astype(np.uint32)
    one, two = np.roll(y, 1), np.roll(y, 2)
    one[starts] = 0
    two[starts] = two[starts + 1] = 0
    code = y * np.uint32(83492791) ^ one * np.uint32(19349663) ^ two * np.uint32(73856093)
    return (code ^ (code >> np.uint32(15))) & np.uint32(GRAMS - 1)


def sliced_trigrams(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """trigrams(x) of one text, piece by piece."""
    for a in range(0, len(x), size):
        before = min(a, 2)
        yield trigrams(x[a - before : a + size])[before:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                gram = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n[gram])], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for grams in sliced_trigrams(np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8), SLICE):
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, minlength=GRAMS)
            if len(sums) > 64:  # bounded memory, however many languages there are
                yield from out()
        yield from out()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-likelihoods (buckets x languages). What comes to the driver is one table of 512 kB for each language."""

    def packed(rows: pa.Table) -> pa.Table:
        n = np.zeros(GRAMS, dtype=np.int64)
        n[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([n.tobytes()], pa.binary())})

    got = sorted(gram_counts(docs).groupBy("lang").applyInArrow(packed, "lang string, counts binary").collect())
    out = np.zeros((GRAMS, len(got)), dtype=np.float32)
    for i, r in enumerate(got):
        n = np.frombuffer(r.counts, dtype=np.int64)
        out[:, i] = np.log((n + 0.5) / (n.sum() + 0.5 * GRAMS))
    return [r.lang for r in got], out


def word_likelihoods(x: np.ndarray, table_: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, log-likelihood of each word by language); texts begin at starts.

    A word goes with the blanks before it, blanks that end a text with its last word, and no word goes over two texts.
    """
    blank = x <= 32
    opens = np.concatenate([[True], blank[1:] & ~blank[:-1]])
    opens[starts] = True
    first = np.flatnonzero(opens)
    full = np.add.reduceat(~blank, first, dtype=np.int64) > 0
    first = first[full | np.isin(first, starts, assume_unique=True)]
    out = np.zeros((len(first), table_.shape[1]), dtype=np.float64)
    codes = trigrams(x, starts)
    a = 0
    while a < len(x):  # slices end where a text does, if one does, so that sums are those of the text alone
        b = min(len(x), a + SLICE)
        if b < len(x) and (last := starts[np.searchsorted(starts, b, side="right") - 1]) > a:
            b = int(last)
        lo, hi = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, b, side="left")
        out[lo:hi] += np.add.reduceat(table_[codes[a:b]], np.maximum(first[lo:hi], a) - a, axis=0)
        a = b
    return first, out


def mixtures(like: np.ndarray, begin: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) and log-likelihoods by EM over words; begin: each document's first word."""
    sizes = np.diff(np.append(begin, len(like)))
    top = like.max(axis=1, keepdims=True)
    p = np.exp(like - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = p * np.repeat(share, sizes, axis=0)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(w, begin, axis=0) / sizes[:, None]
    total = np.log(np.maximum((p * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(total, begin)


def long_words(x: np.ndarray, table_: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """word_likelihoods of one text, piece by piece; a word may go over any number of slices."""
    waiting: list[np.ndarray] = []  # the last full word, whose trailing blanks may follow, and the word that is being read
    full, at = False, 0
    for grams in sliced_trigrams(x, size):
        part = x[at : at + len(grams)]
        blank = part <= 32
        opens = np.flatnonzero(blank & ~np.concatenate([[at == 0 or x[at - 1] <= 32], blank[:-1]]))
        starts = np.concatenate([[0], opens[opens > 0]]) if len(part) else opens
        sums = np.add.reduceat(table_[grams], starts, axis=0, dtype=np.float64)
        fulls = np.add.reduceat(~blank, starts, dtype=np.int64) > 0
        if waiting and not (len(opens) and opens[0] == 0):
            sums[0] += waiting.pop()
            fulls[0] |= full
        ready = [*waiting, *sums[:-1]]
        waiting, full, at = [ready.pop(), sums[-1]] if ready else [sums[-1]], bool(fulls[-1]), at + len(part)
        if ready:
            yield np.array(ready)
    if len(waiting) > 1 and not full:
        blanks = waiting.pop()
        waiting[-1] = waiting[-1] + blanks
    if waiting:
        yield np.array(waiting)


def long_mixture(words: Callable[[], Iterator[np.ndarray]], allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """mixtures of one text whose words come piece by piece, again for each round."""
    share = allowed / allowed.sum()
    for last in [False] * rounds + [True]:
        sums, n, total = np.zeros_like(share), 0, 0.0
        for like in words():
            top = like.max(axis=1, keepdims=True)
            w = np.exp(like - top) * share
            each = np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
            total += float((np.log(each) + top).sum())
            sums += (w / each).sum(axis=0)
            n += len(like)
        if not last:
            share = sums / n
    return share, total


def choose(single: np.ndarray, sizes: np.ndarray, mix: Callable, penalty: float) -> np.ndarray:
    """Shares of each text under its best set of languages: likelihood less penalty * log(words) for each further language.

    single: log-likelihood under each language alone; mix(allowed, rounds, rows): shares and log-likelihoods of some rows.
    """
    n_langs = single.shape[1]
    share, score = np.eye(n_langs)[single.argmax(axis=1)], single.max(axis=1)
    rows, worse = np.arange(len(single)), np.zeros(len(single), dtype=np.int64)
    order = np.argsort(-mix(np.ones_like(share), 8, rows)[0], axis=1, kind="stable") if n_langs > 1 else None
    for k in range(2, n_langs + 1):
        allowed = np.zeros((len(rows), n_langs))
        np.put_along_axis(allowed, order[rows, :k], 1.0, axis=1)
        mixed, total = mix(allowed, 6, rows)
        total = total - penalty * (k - 1) * np.log(sizes[rows] + 1)
        better = total > score[rows]
        share[rows[better]], score[rows[better]] = mixed[better], total[better]
        worse[rows] = np.where(better, 0, worse[rows] + 1)
        rows = rows[worse[rows] < 2]
        if not len(rows):
            break
    return share


def infer(texts: list[bytes], table_: np.ndarray, penalty: float = 2.0, chunk: int = CHUNK) -> np.ndarray:
    """Shares of each text. A text of more than chunk bytes comes alone."""
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(x) > chunk and len(texts) == 1:
        words = lambda: long_words(x, table_, chunk)
        single, n = np.zeros((1, table_.shape[1])), 0
        for like in words():
            single += like.sum(axis=0)
            n += len(like)

        def mix(allowed: np.ndarray, rounds: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share, total = long_mixture(words, allowed[0], rounds)
            return share[None, :], np.array([total])

        return choose(single, np.array([n]), mix, penalty)
    starts = np.cumsum([0, *map(len, texts[:-1])])
    first, like = word_likelihoods(x, table_, starts)
    begin = np.searchsorted(first, starts)
    sizes = np.diff(np.append(begin, len(like)))

    def mix(allowed: np.ndarray, rounds: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) == len(sizes):
            return mixtures(like, begin, allowed, rounds)
        ends = np.cumsum(sizes[rows])
        words = np.arange(ends[-1]) + np.repeat(begin[rows] - ends + sizes[rows], sizes[rows])
        return mixtures(like[words], ends - sizes[rows], allowed, rounds)

    return choose(np.add.reduceat(like, begin, axis=0), sizes, mix, penalty)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for each row; languages holds the set with its shares."""
    langs, likelihoods = fit_languages(docs)
    chunk = max(1 << 12, min(CHUNK, CELLS // max(1, len(langs))))

    def predict(texts: list[str]) -> dict:
        pred, score, shares = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        todo = [i for i, t in enumerate(texts) if langs and any(map(str.isalpha, t))]
        data = [f" {texts[i].lower()} ".encode() for i in todo]
        a = 0
        while a < len(todo):
            b, held = a, 0
            while b < len(todo) and (b == a or held + len(data[b]) <= chunk):
                held += len(data[b])
                b += 1
            for i, s in zip(todo[a:b], infer(data[a:b], likelihoods, chunk=chunk)):
                pred[i], score[i] = langs[int(s.argmax())], float(min(1.0, s.max()))
                shares[i] = [{"lang": langs[j], "share": float(s[j])} for j in np.flatnonzero(s > 1e-6)]
            a = b
        return {"lang_pred": pred, "score": score, "languages": shares}

    return map_texts(id_and_text(docs), predict, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score."""
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
