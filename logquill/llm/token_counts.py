"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content, beside the digest of the tokenizer's file.
Texts are reduced to one per key on the map side and the cache is joined by key; only the distinct
misses are encoded, and their counts are appended to the cache, a Parquet table that later runs
share.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import new_path, slices
from logquill.llm.token_ids import sound

#: Words that the memo holds at most between batches, the longest that it keeps, words encoded at a time.
MEMO, LONGEST, WORDS_AT_A_TIME = 300_000, 64, 20_000
CACHE = "digest binary, n_tokens long, tokenizer string"


def content(text: Column) -> Column:
    """What counts for a tokenizer that drops white space between words: runs of ASCII white space
    become one space, those at the ends go. Special strings hold none, so they stay as they are;
    letters keep their case, since special strings are told apart by it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


@functools.cache
def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


@functools.cache
def drops_space(path: str) -> bool:
    """Whether a .json tokenizer takes words apart from each other and drops what lies between."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        cutter = json.load(f).get("pre_tokenizer") or {}
    first = cutter.get("pretokenizers", [cutter])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"\s" in first["pattern"].get("Regex", "")


class _Memo(dict):
    """Counts by word; a word that isn't held is noted in todo and stands for None."""

    def __init__(self) -> None:
        super().__init__()
        self.todo: list[str] = []

    def __missing__(self, word: str) -> None:
        self.todo.append(word)
        self[word] = None


class WordCounter:
    """Numbers of tokens of texts under a tokenizer that drops white space: the library is asked
    once for each word, and a bounded memo keeps what it said."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.memo = tokenizer, _Memo()
        self.words = re.compile(r"[^ \t\n\x0B\f\r]+").findall

    def __call__(self, texts: list[str]) -> list[int]:
        memo, words = self.memo, list(map(self.words, texts))
        for own in words:
            deque(map(memo.__getitem__, own), 0)
        todo, memo.todo = memo.todo, []
        for start in range(0, len(todo), WORDS_AT_A_TIME):
            some = todo[start : start + WORDS_AT_A_TIME]
            memo.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        out = [sum(map(memo.__getitem__, own)) for own in words]
        for word in todo:
            if len(word) > LONGEST:
                del memo[word]
        if len(memo) > MEMO:
            memo.clear()
        return out


@functools.cache
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if drops_space(path):
        return WordCounter(tokenizer)
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [sound(t or "") for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["digest"], pa.array(_counter(path)(texts), pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    path: the tokenizer's file (.json or .model). cache: the cache table's path in a store that all
    executors share; by default a new one in the shared folder. A null text counts as empty; a null
    doc_id and repeated rows are kept; an empty table gives an empty result. Whole texts are
    encoded. Counts of a key that two runs appended at the same time agree, one is taken."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    cache, version = cache or new_path(spark, "token-counts"), tokenizer_version(path)
    text = F.coalesce("text", F.lit(""))
    body = content(F.col("text")) if drops_space(path) else text
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("digest"), text.alias("text"))

    def known() -> DataFrame:
        try:
            return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "digest binary, n_tokens long")

    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known().select("digest"), "digest", "left_anti")
    encode_misses(misses, path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    out = keyed.drop("text").join(known(), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
