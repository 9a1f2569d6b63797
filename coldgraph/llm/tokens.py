"""Token counts with a digest cache.

Counts live in a Parquet table (content digest, tokenizer digest, n_tokens). A call joins the digests of its
texts to it, encodes each content that isn't there once, and appends the new counts. The texts to encode
are combined map-side by digest, so a content that a third of all rows share is one row; the rows that ask
for such a content's count are salted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.functions.skew import HOT_ROWS, attach
from coldgraph.llm.rows import column, text_of
from coldgraph.llm.words import words_of
from coldgraph.session import materialize

STEP = 5_000
CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def encode_counts(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library gives them, without begin, end or added special tokens."""
    model = _load(path)
    if path.endswith(".model"):
        return [len(x) for x in model.encode(texts, num_threads=1)]
    model.no_truncation()
    model.no_padding()
    return [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def count_by_word(path: str, texts: pa.Array) -> np.ndarray:
    """The same for a tokenizer that drops white space and joins nothing across it: distinct words are
    encoded once and their counts added up."""
    total = np.zeros(len(texts), dtype=np.int64)
    for part in words_of(texts, False):
        if not len(part.ids):
            continue
        each = np.fromiter(
            (n for i in range(0, len(part.distinct), STEP) for n in encode_counts(path, [w.decode() for w in part.distinct[i : i + STEP]])),
            dtype=np.int64,
            count=len(part.distinct),
        )
        upto = np.concatenate([[0], np.cumsum(each[part.ids])])
        total[part.first : part.first + part.rows] = upto[part.bounds[1:]] - upto[part.bounds[:-1]]
    return total


def token_counts(
    docs: DataFrame, path: str, cache: str, by_word: bool = False, limit: int = 2048, key: str = "doc_id", text: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``docs``; null texts count as empty, with no token.

    ``path``: a tokenizer file that every executor has. ``cache``: folder of the count table, made if
    missing. ``by_word``: the tokenizer's pre-tokenizer drops white space, so words can be
    encoded one by one. A failed call leaves the cache as it was; counts written twice are read once.
    Repeated rows are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    content = text_of(text)
    keyed = docs.select(
        column(key).alias("__key"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
    )
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(1)
            if by_word:
                counts = count_by_word(path, texts)
            else:
                counts = encode_counts(path, texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())],
                ["digest", "tokenizer", "n_tokens"],
            )

    contents = docs.select(F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("__text"))
    contents = contents.groupBy("digest").agg(F.first("__text").alias("__text"))
    misses = contents.join(stored(), "digest", "left_anti").select("digest", "__text")
    misses.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    keyed = materialize(keyed, "token-digests")
    return attach(keyed, stored(), "digest", ["__key"], hot_rows=hot_rows).select(
        F.col("__key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
