"""Content-addressed token store.

A document's ids are cut where a rolling hash of the last WINDOW ids has its low bits zero, so equal
stretches give equal chunks wherever they stand. Four tables make up a store:

    cut       a row per document: doc_id, digests, sizes and ids of its chunks in order (an intermediate)
    chunks    digest, width, ids: each distinct chunk once, as little-endian ids in a compressed column
    recipes   in ascending doc_id: shard, line, doc_id, start, n_tokens, chunk digests in order, Merkle root
    manifest  per shard: documents, tokens and Merkle root over its documents' roots

Reading back: every chunk's digest is recomputed from its bytes; recipes meet what was read by
digest; a document's root is recomputed from those digests and compared with its recipe, and the
shard's with the manifest. As CRCs of consecutive chunks combine, documents' CRCs need no payload
in a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquill.llm.common import new_path, slices
from logquill.llm.token_ids import encoder

END_ID = 2
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
DIGEST = 16
#: Documents of a shard, about: what the Merkle root of a shard is computed from in one group.
SHARD_DOCS = 100_000
CUT = "doc_id long, text_key binary, n_tokens long, root binary, width int, digests array<binary>, ids array<binary>"
CHUNKS = "digest binary, width int, ids binary"
SUMMARY = "doc_id long, start long, n_tokens long, ids_crc32 long"


@functools.cache
def _gears() -> np.ndarray:
    """A pseudo-random 64-bit number for each id modulo 65,536."""
    return np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, ascending, in a stream of documents' ids one after the
    other; a document begins at each of starts. Its last chunk ends with it. The hash's window may
    reach into the document before only where a chunk would be too short to end anyway."""
    hashes, width = _gears()[ids & 0xFFFF], 1
    while width < WINDOW:  # a hash of twice the width is that of its second half and, shifted, of its first
        wider = hashes.copy()
        wider[width:] += hashes[:-width] << np.uint64(width)
        hashes, width = wider, 2 * width
    marks = np.flatnonzero((hashes >> np.uint64(WINDOW)) % np.uint64(MEAN) == 0) + 1
    bounds = np.append(starts, len(ids))
    first = np.searchsorted(marks, bounds)
    marks, out = marks.tolist(), []
    for start, end, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        ends, last = [], start
        for mark in (*marks[a:b], end):
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST or mark == end > last:
                last = mark
                ends.append(last)
        out.append(ends)
    return out


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.sha256(ids.astype("<u4").tobytes()).digest()[:DIGEST]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed with different prefixes, an odd
    node moves up as it is. No leaf: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@functools.cache
def _zeros_tables() -> np.ndarray:
    """What 2 ** k zero bytes do to a CRC-32, for k below 40, as four tables by byte of the CRC."""
    square = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit, as a matrix over GF(2)
    out = np.zeros((40, 4, 256), np.uint32)
    for k in range(-3, 40):
        if k >= 0:
            out[k] = [[_times(square, v << 8 * byte) for v in range(256)] for byte in range(4)]
        square = [_times(square, row) for row in square]
    return out


def crcs_of_joined(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each of several byte strings made of parts one after the other: crcs and sizes in
    bytes of all parts, and the index of each string's first part. Every string has a part.

    A string's CRC is the sum over GF(2) of its parts' CRCs, each after as many zero bytes as follow
    the part; all parts are taken at once, bit by bit of those numbers."""
    if not len(first):
        return np.empty(0, np.uint32)
    upto = np.cumsum(sizes)
    ends = upto[np.append(first[1:], len(sizes)) - 1]
    behind = np.repeat(ends, np.diff(np.append(first, len(sizes)))) - upto
    out, tables = crcs.astype(np.uint32), _zeros_tables()
    for k in range(int(behind.max(initial=0)).bit_length()):
        at = np.flatnonzero(behind >> k & 1)
        c, t = out[at], tables[k]
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return np.bitwise_xor.reduceat(out, first)


@dataclass
class Store:
    """Paths of a store's tables."""

    root: str

    def __post_init__(self) -> None:
        self.cut, self.chunks, self.recipes, self.manifest = (f"{self.root}/{x}" for x in ("cut", "chunks", "recipes", "manifest"))


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """The stretches of data up to each of ends, as a binary column that shares its memory."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def cut_documents(docs: DataFrame, end_id: int = END_ID) -> DataFrame:
    """A row of CUT for each row of docs: its ids, with end_id, cut into chunks, and its Merkle root."""
    closing = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in slices(batches):
            found = [x + closing for x in encode(batch["text"].to_pylist())]
            n_tokens = np.array([len(x) // 4 for x in found], np.int64)
            data = b"".join(found)
            ids = np.frombuffer(data, "<u4")
            per_doc = cut_points(ids, np.cumsum(n_tokens) - n_tokens)
            ends = [e for doc in per_doc for e in doc]
            view = memoryview(data)
            digests = [hashlib.sha256(view[4 * a : 4 * b]).digest()[:DIGEST] for a, b in zip([0, *ends], ends, strict=False)]
            lists = np.append(0, np.cumsum([len(doc) for doc in per_doc])).astype(np.int32)
            roots = [merkle(digests[a:b]) for a, b in itertools.pairwise(lists.tolist())]
            width = 2 if ids.max(initial=0) < 1 << 16 else 4
            chunks = _binaries(ids.astype(f"<u{width}").tobytes(), np.array(ends, np.int64) * width)
            columns = [batch["doc_id"], batch["text_key"], pa.array(n_tokens), pa.array(roots, pa.binary()), pa.array([width] * len(found), pa.int32())]
            columns += [pa.ListArray.from_arrays(lists, x) for x in (pa.array(digests, pa.binary()), chunks)]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "n_tokens", "root", "width", "digests", "ids"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("text_key")).mapInArrow(cut, CUT)


def write_chunks(spark: SparkSession, store: Store) -> None:
    """Each distinct chunk once. Copies meet in the map tasks first, then by digest."""
    cut = spark.read.schema(CUT).parquet(store.cut)
    chunks = cut.select("width", F.explode(F.arrays_zip("digests", "ids")).alias("chunk")).select("chunk.digests", "width", "chunk.ids").toDF("digest", "width", "ids")
    chunks.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(store.chunks)


def write_recipes(spark: SparkSession, store: Store) -> None:
    """Recipes by range of doc_id, in order inside a range, and the manifest of their shards. Each
    of several rows with one id and text gets its recipe; their order doesn't matter, as they are
    equal."""
    cut = spark.read.schema(CUT).parquet(store.cut).select("doc_id", "text_key", "n_tokens", "root", "digests")
    cut = cut.withColumn("row", F.monotonically_increasing_id())  # parts one very common id
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // SHARD_DOCS))
    order = ["doc_id", "text_key", "row"]
    ordered = cut.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, at = 0, 0
        for batch in batches:
            n = batch["n_tokens"].to_numpy()
            own = [pa.array(np.arange(line + 1, line + 1 + len(n))), pa.array(at + np.cumsum(n) - n)]
            line, at = line + len(n), at + int(n.sum())
            yield pa.record_batch([*own, *(batch[c] for c in ("doc_id", "n_tokens", "digests", "root"))], names=["line", "inside", "doc_id", "n_tokens", "digests", "root"])

    placed = f"{store.root}/ordered"
    kinds = "line long, inside long, doc_id long, n_tokens long, digests array<binary>, root binary"
    shard = F.spark_partition_id().alias("shard")  # fixed from here on by being written
    ordered.drop("row").mapInArrow(numbered, kinds).select(shard, "*").write.parquet(placed)
    rows = spark.read.schema("shard int, " + kinds).parquet(placed)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    totals = totals.withColumn("shard_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    recipes = rows.join(totals.select("shard", "shard_start"), "shard")
    recipes.select("shard", "line", "doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "digests", "root").write.parquet(store.recipes)
    shard_roots(spark.read.parquet(store.recipes)).join(totals, "shard").write.parquet(store.manifest)


def shard_roots(recipes: DataFrame) -> DataFrame:
    """shard, shard_root: Merkle root over the roots of a shard's documents in their order."""

    def root(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(p for b in rows for p in zip(b["line"].to_pylist(), b["root"].to_pylist(), strict=True))
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([merkle([r for _, r in pairs])], pa.binary())], names=["shard", "shard_root"])

    return recipes.select("shard", "line", "root").groupBy("shard").applyInArrow(root, "shard int, shard_root binary")


def write_store(docs: DataFrame, root: str | None = None) -> Store:
    """A store of docs (doc_id, text) at a new path. Null texts are empty (the end id alone); null
    ids come first; an empty table gives an empty store; texts of any length are encoded whole;
    other columns are not read."""
    spark = docs.sparkSession
    store = Store(root or new_path(spark, "token-store"))
    cut_documents(docs).write.option("compression", "zstd").parquet(store.cut)
    write_chunks(spark, store)
    write_recipes(spark, store)
    return store


def read_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """digest, n_ids and crc32 of each stored chunk, from its bytes; a chunk whose bytes don't have
    its digest fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, crc = [], []
            for digest, width, data in zip(batch["digest"].to_pylist(), batch["width"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                wide = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                if hashlib.sha256(wide).digest()[:DIGEST] != digest:
                    raise ValueError("a stored chunk doesn't have its digest")
                n.append(len(wide) // 4)
                crc.append(zlib.crc32(wide))
            yield pa.record_batch([batch["digest"], pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "read_ids", "crc"])

    return spark.read.schema(CHUNKS).parquet(store.chunks).mapInArrow(read, "digest binary, read_ids long, crc long")


def read_store(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document as reconstructed from the files, all of it
    verified; anything missing or altered fails the job."""
    recipes = spark.read.parquet(store.recipes)
    manifest = spark.read.parquet(store.manifest)
    sound = shard_roots(recipes).withColumnRenamed("shard_root", "found").join(manifest, "shard", "full")
    checked = F.assert_true(F.col("found").eqNullSafe(F.col("shard_root")), "a shard's root differs from the manifest")
    sound = sound.select("shard", F.coalesce(checked.cast("string"), F.lit("")).alias("sound"))
    # equal documents have equal roots: each content is put together once
    contents = recipes.groupBy("root").agg(F.first("digests").alias("digests"))
    parts = contents.select("root", F.posexplode("digests").alias("pos", "digest"))
    found = parts.join(read_chunks(spark, store), "digest", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "read_ids", "crc"))).alias("parts"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            lists = batch["parts"]
            parts = lists.flatten()
            if parts.field("crc").null_count:
                raise ValueError("a chunk of a recipe isn't stored")
            first = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
            digests, bounds = parts.field("digest").to_pylist(), [*first.tolist(), len(parts)]
            if [merkle(digests[a:b]) for a, b in itertools.pairwise(bounds)] != batch["root"].to_pylist():
                raise ValueError("a document can't be put together from its recipe")
            n, crcs = (parts.field(c).to_numpy() for c in ("read_ids", "crc"))
            n_tokens, joined = (np.add.reduceat(n, first), crcs_of_joined(crcs, 4 * n, first)) if len(first) else (n, crcs)
            yield pa.record_batch([batch["root"], pa.array(n_tokens, pa.int64()), pa.array(joined.astype(np.int64))], names=["root", "n_tokens", "ids_crc32"])

    rebuilt = found.mapInArrow(rebuild, "root binary, n_tokens long, ids_crc32 long")
    lines = recipes.select("shard", "doc_id", "start", "root").join(rebuilt, "root").join(sound, "shard")
    return lines.where(F.col("sound") == "").select("doc_id", "start", "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame) -> DataFrame:
    """docs written as a store and read back."""
    return read_store(docs.sparkSession, write_store(docs))
