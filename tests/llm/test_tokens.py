"""Packing, token counts, token store and BPE against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logquill.llm import bpe, common, packing, queries, token_counts, token_ids, token_store

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "a  b\n\n c ", "don't <|endoftext|>x<|startoftext|> Y", "İstanbul ΑΣ Σ", "日本語 🙂‍", "\x1c\x1f a\x85b c　d e f", "=-" * 400 + "z" * 700, "é ẛ̣", "<|ENDOFTEXT|>"]


def ids_of(text):
    return BYTES.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def byte_ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in token_ids.encoder().encode(texts)]


def test_byte_ids_equal_the_library(texts):
    every = [*ODD, *texts.values()]
    assert byte_ids(every) == [ids_of(t) for t in every]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aA1's d!\n\t \x85\u2009\u0301é<|endoftx>日", max_size=60)))
def test_any_text_is_encoded_as_by_the_library(text):
    assert byte_ids([text]) == [ids_of(text)]


def test_every_code_point_is_encoded_as_by_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} " for c in points[k : k + 64]) for k in range(0, token_ids.KNOWN + 1024, 64)]
    assert token_ids.encoder().encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in BYTES.encode_batch_fast(texts, add_special_tokens=False)]
    own = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"{c}a{c}" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    assert list(map(own.encode, texts)) == [x.ids for x in WORDS.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.fixture(scope="session")
def long_docs(spark):
    """Texts of 2 MB: white space, one letter, and a sentence again and again."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_000_000 + "b", "x" * 2_000_000, "Some words, and more.\n" * 90_000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_long_texts_are_packed_and_stored_as_the_library_encodes_them(long_docs):
    ids = {r["doc_id"]: [*ids_of(r["text"]), 2] for r in long_docs.collect()}
    check_packing(packing.pack_documents(long_docs).collect(), ids)
    rows = token_store.store_and_read(long_docs).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rows} == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.items()}


def test_long_texts_are_counted_and_encoded_as_by_the_library(long_docs):
    n = {r["doc_id"]: len(WORDS.encode(r["text"], add_special_tokens=False).ids) for r in long_docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(long_docs).collect()} == n
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(long_docs).collect()} == n


def test_packing(spark, sf, texts):
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    ids = {k: [*ids_of(t), 2] for k, t in texts.items()}
    check_packing(rows, ids)


def check_packing(rows, ids):
    placed, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    for at in placed.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 1024
    for k, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[k])
        assert all(r["length"] == 1024 for r in own[1:])
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert len(placed) <= least * 1.03 + 1
    assert set(pieces) == set(ids)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(1, 80))
def test_fullest_is_the_best_subset_sum(counts, room):
    uses = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in uses.items())
    reach = {0}
    for k, n in counts.items():
        reach = {a + k * i for a in reach for i in range(n + 1) if a + k * i <= room}
    assert sum(k * n for k, n in uses.items()) == max(reach)


def test_bins_use_up_the_histogram():
    histogram = {k: (k * 7919) % 23 + 1 for k in range(1, 1025, 3)}
    kinds, left = packing.plan_bins(histogram), dict(histogram)
    for repeats, uses in kinds:
        assert sum(k * n for k, n in uses.items()) <= 1024
        for k, n in uses.items():
            left[k] -= n * repeats
    assert not any(left.values())


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]
    assert packing.pack_documents(no_docs).collect() == []


def test_counts(spark, sf, texts):
    rows = queries.op3_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(WORDS.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_counts_come_from_the_cache_the_second_time(spark, odd_docs, no_docs, monkeypatch):
    cache = common.new_path(spark, "cache-test")
    first = token_counts.count_tokens(odd_docs, cache=cache).collect()
    stored = spark.read.parquet(cache).count()
    assert stored == len({(r["text"] or "").strip() and " ".join(r["text"].split()) for r in odd_docs.collect()})
    again = token_counts.count_tokens(odd_docs, cache=cache).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(no_docs, cache=cache).collect() == []
    for r in first:
        text = {x["doc_id"]: x["text"] for x in odd_docs.collect()}[r["doc_id"]] if r["doc_id"] else None
        if r["doc_id"]:
            assert r["n_tokens"] == len(WORDS.encode(text or "", add_special_tokens=False).ids)


def test_counts_with_a_tokenizer_that_keeps_white_space(spark):
    docs = spark.createDataFrame([(1, "a  b\n\n c"), (2, "a b c"), (3, "  ")], "doc_id long, text string")
    rows = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {r["doc_id"]: len(ids_of(r["text"])) for r in docs.collect()}


def test_counts_with_sentencepiece(spark, odd_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in token_counts.count_tokens(odd_docs, path).where("doc_id is not null").collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]] or ""))


def test_bpe(spark, sf, texts):
    rows = queries.op9_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = WORDS.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdefgh'. \n<|>endoftx", max_size=200)))
def test_bpe_equals_the_library(text):
    own = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    ids = WORDS.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == WORDS.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_texts(odd_docs, no_docs):
    own = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    for text in ODD:
        assert own.encode(text) == WORDS.encode(text, add_special_tokens=False).ids, text[:60]
    rows = bpe.encode_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert bpe.encode_documents(no_docs).collect() == []


def test_store(spark, sf, texts):
    rows = {r["doc_id"]: r for r in queries.op6_token_store(spark, sf).collect()}
    start = 0
    for k in sorted(texts):
        ids = np.array([*ids_of(texts[k]), 2], "<u4")
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(texts)


def test_store_keeps_a_chunk_once_and_finds_damage(spark, odd_docs, no_docs):
    store = token_store.write_store(odd_docs)
    digests = [r["digest"] for r in spark.read.parquet(store.chunks).select("digest").collect()]
    used = [d for r in spark.read.parquet(store.recipes).collect() for d in r["digests"]]
    assert len(digests) == len(set(digests)) < len(used) and set(digests) == set(used)
    rows = token_store.read_store(spark, store).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    damaged = token_store.Store(common.new_path(spark, "damaged"))
    spark.read.parquet(store.recipes).write.parquet(damaged.recipes)
    spark.read.parquet(store.manifest).write.parquet(damaged.manifest)
    spark.read.parquet(store.chunks).where("pmod(xxhash64(digest), 5) > 0").write.parquet(damaged.chunks)
    with pytest.raises(Exception, match="isn't stored"):
        token_store.read_store(spark, damaged).collect()
    altered = token_store.Store(common.new_path(spark, "altered"))
    spark.read.parquet(store.recipes).write.parquet(altered.recipes)
    spark.read.parquet(store.manifest).write.parquet(altered.manifest)
    spark.read.parquet(store.chunks).withColumn("ids", F.expr("concat(substring(ids, 3), substring(ids, 1, 2))")).write.parquet(altered.chunks)
    with pytest.raises(Exception, match="doesn't have its digest"):
        token_store.read_store(spark, altered).collect()
    assert token_store.store_and_read(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=300), min_size=1, max_size=6), max_size=6))
def test_crcs_combine(strings):
    parts = [p for s in strings for p in s]
    first = np.cumsum([0, *map(len, strings)])[:-1].astype(int)
    joined = token_store.crcs_of_joined(np.array([zlib.crc32(p) for p in parts], np.int64), np.array([len(p) for p in parts], np.int64), first)
    assert joined.tolist() == [zlib.crc32(b"".join(s)) for s in strings]


def test_cuts_move_with_the_content():
    ids = np.random.default_rng(1).integers(0, 50257, 20000).astype("<u4")
    (ends,) = token_store.cut_points(ids, np.array([0]))
    assert ends[-1] == len(ids) and all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
    (moved,) = token_store.cut_points(np.concatenate([ids[:5], ids]), np.array([0]))
    assert len({e + 5 for e in ends} & set(moved)) > 0.8 * len(ends)
    # what stands before a document doesn't move its cuts
    _, same = token_store.cut_points(np.concatenate([ids[:777], ids]), np.array([0, 777]))
    assert [e - 777 for e in same] == ends
