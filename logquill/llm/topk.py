"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers. Candidates and queries meet in tiles of bounded size. In a tile
the postings (vector, component) are cut into segments by impact, the component's absolute value,
largest first. Segments are added to the accumulators in that order; after each, what the rest can
still add to a pair is at most the product of the query's norm and the norm of the vector's
unprocessed components. A tile's scan of a block of queries stops only when that bound proves that
few vectors can be among the best k; those possible members are scored exactly. Tiles' winners are
merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquill.llm.common import stored

SCALE, TOP = 256, 5
#: Vectors and queries of a tile, about, and queries whose accumulators are held at a time.
TILE, QUERY_TILE, QUERIES_AT_A_TIME = 8192, 4096, 128
#: Shares of a tile's postings up to the end of each impact segment.
SEGMENTS = (0.12, 0.3, 0.5, 0.7, 0.85, 1.0)
#: A scan stops once a query has this many possible members or fewer, on average.
FEW = 48
#: Sums of integers up to this size are exact in float32 and float64; beyond, sums have an error bound.
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}
#: Scores are reported as long; one beyond its range, which only ranks by its true value, as the nearest long.
LONG = np.iinfo(np.int64)
#: Largest score that is ranked by its own value.
MOST = 10**38 - 1
FOUND = "query_row long, query_id long, row long, vec_id long, score decimal(38,0)"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id and v (array<long>): floor(scale * x) of each component, in double arithmetic; what
    is beyond a long's range becomes the nearest long.

    Left out: null vectors, those with a null or non-finite component, and rows without vec_id.
    Every other row takes part as itself, also if rows share a vec_id."""
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors, in order of id and row."""
    rows, ids = (table[c].to_numpy() for c in ("row", "vec_id"))
    order, values = np.lexsort((rows, ids)), table["v"].combine_chunks()
    return rows[order], ids[order], values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), table["dims"][0].as_py())[order]


class ImpactIndex:
    """Segments of a tile's postings by falling impact, and what stays unprocessed after each."""

    def __init__(self, vectors: np.ndarray, kind: type) -> None:
        size = np.abs(vectors.astype(np.float64))
        cuts = np.quantile(size, [1 - s for s in SEGMENTS[:-1]]) if size.size else np.zeros(len(SEGMENTS) - 1)
        tops = [np.inf, *cuts, -1]
        self.segments = [np.where((size <= hi) & (size > lo), vectors, 0).astype(kind).T.copy() for hi, lo in zip(tops, tops[1:], strict=False)]
        self.rest = [np.sqrt(np.where(size > lo, 0, vectors.astype(np.float64) ** 2).sum(axis=1)) for lo in tops[1:]]
        self.vectors = vectors


def exact_scores(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products row by row, in integers without a limit if wide."""
    return (a.astype(object) * b.astype(object)).sum(axis=1) if wide else np.einsum("ij,ij->i", a, b)


def best_of_tile(rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int = TOP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query positions, vector positions, scores) of the k best candidates of each query but itself;
    vectors stand in the order that settles ties.

    Vectors that can't be among the best of any query of a block are left out of its later segments."""
    dims = vectors.shape[1]
    bound = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, dims)
    kind = np.float32 if bound < EXACT[np.float32] else np.float64
    wide = bound >= EXACT[np.float64]
    error = bound * 2.0**-50 * (dims + 1) if wide else 0.0
    index = ImpactIndex(vectors, kind)
    for start in range(0, len(query_rows), QUERIES_AT_A_TIME):
        q, own_row = queries[start : start + QUERIES_AT_A_TIME], query_rows[start : start + QUERIES_AT_A_TIME]
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        at = np.arange(len(rows))
        partial = np.zeros((len(q), len(at)), kind)
        for segment, rest in zip(index.segments, index.rest, strict=True):
            own = own_row[:, None] == rows[at][None, :]
            partial += q.astype(kind) @ segment[:, at]
            slack = (norm[:, None] * rest[at][None, :] * (1 + 1e-9) + 1e-6 + error).astype(np.float64)
            low = np.where(own, -np.inf, partial - slack)
            best = min(k, len(at)) - 1
            possible = (partial + slack >= -np.partition(-low, best, axis=1)[:, best : best + 1]) & ~own
            if possible.sum() <= FEW * len(q):
                break
            stay = np.flatnonzero(possible.any(axis=0) | own.any(axis=0))
            if len(stay) < len(at) / 2:
                at, partial, possible = at[stay], partial[:, stay], possible[:, stay]
        row, col = np.nonzero(possible)
        col = at[col]
        score = exact_scores(q[row], vectors[col], wide)
        order = np.lexsort((col, -score, row)) if not wide else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], col[i])), int)
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield start + row[keep], col[keep], score[keep]


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every other row for each row of vectors (vec_id,
    embedding) where `queries` holds; ties go to the smaller vec_id.

    Only vectors of as many components are compared. Several rows with one vec_id are queries and
    candidates of their own. Fewer than k candidates give fewer rows; an empty table or query set
    gives an empty result; other columns are not read. Pairs of tiles are searched apart; indexing a
    tile takes a small share of multiplying it with its queries."""
    rows = stored(quantised(vectors, scale).withColumn("dims", F.size("v")), "quantised")
    asked = rows.where(queries)
    n, m = rows.count(), asked.count()
    parts, query_parts = max(1, -(-n // TILE)), max(1, -(-m // QUERY_TILE))
    tile = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("dims", tile(parts).alias("part"), every(query_parts).alias("query_part"), "row", "vec_id", "v")
    right = asked.select("dims", every(parts).alias("part"), tile(query_parts).alias("query_part"), "row", "vec_id", "v")

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if len(candidates) and len(wanted):
            (own, ids, values), (asking, asking_ids, questions) = _block(candidates), _block(wanted)
            for q, c, score in best_of_tile(own, values, asking, questions, k):
                for column, found in zip(columns, (asking[q], asking_ids[q], own[c], ids[c], (Decimal(max(-MOST, min(MOST, x))) for x in score.tolist())), strict=True):
                    column += list(found)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_row", "query_id", "row", "vec_id", "score"])

    keys = ("dims", "part", "query_part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.greatest(F.least("score", F.lit(int(LONG.max)).cast("decimal(38,0)")), F.lit(int(LONG.min)).cast("decimal(38,0)")).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
