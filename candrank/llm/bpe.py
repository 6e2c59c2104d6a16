"""Byte-pair encoding and decoding by tree concatenation.

Texts up to leaf_chars are encoded in one call. Longer ones are halved until the parts are short; parts are rows, so
Spark encodes the parts of one text in parallel. Encodings are joined pairwise, as a tree: a window of tokens around
the join is decoded and encoded again, and grows until its first tokens equal the left side's and its last tokens the
right side's. Tokens of a byte-pair encoding that agree pairwise are the encoding of the whole, so the result is exact.

Defined results: null is empty text, which has no token; the text of the special token gives its id, as the tokenizers
library does; equal rows give equal rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.common import id_and_text, map_texts, table

VOCABULARY = "byte_bpe_50k.json"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
LEAF_CHARS = 32_768
#: Both libraries were compared on every code point below this range; texts with others go to the slower library.
NOT_COMPARED = re.compile("[\U00030000-\U0010ffff]")


class Coder:
    """Encodes with the rank file beside the vocabulary, which holds the same merges, where it is known to agree, else with the tokenizers library."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(vocabulary)
        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.pieces: list[bytes] = [b""] * (SPECIAL_ID + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.pieces[SPECIAL_ID] = SPECIAL.encode()
        self.names = [str(i) for i in range(SPECIAL_ID + 1)]

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def leaf(self, text: str) -> list[int]:
        if not NOT_COMPARED.search(text):
            return self.fast.encode(text, allowed_special={SPECIAL}, disallowed_special=())
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        """The whole text in this process."""
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        return self.tree([self.leaf(x) for x in leaves(text)])

    def array(self, text: str) -> np.ndarray:
        """encode() as unsigned 32-bit numbers."""
        if len(text) <= LEAF_CHARS and not NOT_COMPARED.search(text):
            return self.fast.encode_to_numpy(text, allowed_special={SPECIAL}, disallowed_special=())
        return np.array(self.encode(text), dtype=np.uint32)

    def bytes_of(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])

    def join(self, left: list[int], right: list[int], window: int = 32) -> list[int]:
        """The encoding of both texts together. The first window is longer than the special token and than what the splitting pattern looks ahead."""
        if not left or not right:
            return left or right
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            while i and self.pieces[left[i]][0] & 0xC0 == 0x80:  # not within a character
                i -= 1
            while j < len(right) and self.pieces[right[j]][0] & 0xC0 == 0x80:
                j += 1
            again = self.encode_window(self.bytes_of(left[i:] + right[:j]).decode())
            if (i == 0 or again[:2] == left[i : i + 2]) and (j == len(right) or again[-2:] == right[j - 2 : j]):
                return left[:i] + again + right[j:]
            window *= 2

    def encode_window(self, text: str) -> list[int]:
        return self.leaf(text)

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.cache
def coder(vocabulary: str = VOCABULARY) -> Coder:
    return Coder(vocabulary)


def leaves(text: str, most: int = LEAF_CHARS) -> list[str]:
    """Halves of halves of at most so many characters; cuts fall before a blank near the middle if there is one, never in the special token."""
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    near = text.find(" ", middle, middle + most // 4)
    cut = near if near > 0 and text[near - 1].isalnum() else middle
    inside = text.rfind(SPECIAL, max(0, cut - len(SPECIAL) + 1), cut + len(SPECIAL) - 1)
    if 0 <= inside < cut:
        cut = inside or len(SPECIAL)
    return leaves(text[:cut], most) + leaves(text[cut:], most)


def _digest(c: Coder, ids: list[int]) -> tuple[int, str, str]:
    names = c.names
    decoded = c.bytes_of(ids).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_leaves(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(row, doc_id, ids) of long texts: parts in parallel, then the tree of each text. row tells rows apart that share a doc_id."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                parts = leaves(text, leaf_chars)
                at = pa.array([k] * len(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(range(len(parts)), pa.int32()), pa.array(parts)],
                    names=["row", "doc_id", "leaf", "text"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [coder(vocabulary).leaf(t) for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    def tree(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        ids = coder(vocabulary).tree(group.column("ids").to_pylist())
        return pa.table({"row": group.column("row")[:1], "doc_id": group.column("doc_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = rows.mapInArrow(part, f"row bigint, doc_id {kind}, leaf int, text string").repartition("row", "leaf")
    coded = parts.mapInArrow(encode, f"row bigint, doc_id {kind}, leaf int, ids array<int>")
    return coded.groupBy("row").applyInArrow(tree, f"row bigint, doc_id {kind}, ids array<int>")


def bpe_digests(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""
    docs = id_and_text(docs)

    def columns(found: list[tuple]) -> dict:
        n, ids, decoded = zip(*found) if found else ((), (), ())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = map_texts(docs.where(F.length("text") <= leaf_chars), lambda texts: columns([_digest(c := coder(vocabulary), c.leaf(t)) for t in texts]), schema)
    long = encode_leaves(docs.where(F.length("text") > leaf_chars), vocabulary, leaf_chars)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pd.DataFrame(columns([_digest(coder(vocabulary), ids) for ids in batch.column("ids").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made["n_tokens"], pa.int64()), pa.array(made["ids_sha256"], pa.string()), pa.array(made["decoded_sha256"], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return short.unionByName(long.mapInArrow(digest, short.schema))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(table(spark, sf_dir, "documents"))
