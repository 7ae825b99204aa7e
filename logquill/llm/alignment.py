"""Alignment of two tokenizers over whole texts: a byte-level BPE (A) and a piece BPE (B).

A text is cut before each space that follows a character that isn't white space: there tokens of both end,
since a byte-level word never goes on over such a space and no piece has one inside. Stretches that a worker hasn't
seen are encoded by both libraries, many at a time, and the two lists of token ends are intersected by galloping: the
shorter list drives an exponential and then a binary search into the longer one, for all its ends at once. Common ends cut the tokens
into groups, and differences of ranks give the tokens of each side in a group. A document's figures are
those of its stretches, from a bounded memo.

Counts of id pairs over all documents come back to documents by chunks: a chunk of documents asks once
for each pair that it holds, so a common pair is as many rows as there are chunks, not tokens.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import slices, stored
from logquill.llm.token_ids import sound

#: Stretches and linked pairs that the memo holds at most between batches, stretches encoded at a time, characters of texts at a time.
MEMO, HELD, AT_A_TIME, CHARACTERS = 400_000, 8_000_000, 20_000, 1 << 20
#: Different pairs of documents that a chunk holds (about; one document may have more), and its documents at most.
CHUNK_PAIRS, CHUNK_DOCS = 1 << 18, 1 << 13
#: An id pair is one number: A's id times this, plus B's.
BASE = 1 << 20

_CUT = re.compile(r" (?<=\S )(?=.)", re.S).split
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def gallop(keys: np.ndarray, within: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place of within that is not less than each key; both ascend and no place is before start. Steps from start
    double until they pass the key, and the last step is halved."""
    low, high, n = start.copy(), start.copy(), len(within)
    active, step = np.arange(len(keys)), 1
    while len(active := active[high[active] < n]) and len(active := active[within[high[active]] < keys[active]]):
        low[active] = high[active] + 1
        high[active] += step
        step *= 2
    high = np.minimum(high, n)
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        less = within[middle] < keys[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, a_starts: np.ndarray | None = None, b_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the ends that both have; the shorter list drives. Starts: for each end, a rank in the other
    list before which its equal can't be."""
    if len(a) > len(b):
        return common_ends(b, a, b_starts, a_starts)[::-1]
    if not len(b):
        return np.array([], np.int64), np.array([], np.int64)
    at = gallop(a, b, np.zeros(len(a), np.int64) if a_starts is None else a_starts)
    found = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a))
    return found, at[found]


class _Memo(dict):
    """Numbers of stretches; one that isn't held is given the next number and noted in todo."""

    def __init__(self) -> None:
        super().__init__()
        self.todo: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self.todo.append(stretch)
        self[stretch] = at = len(self)
        return at


class _Rows:
    """A numpy array that grows."""

    def __init__(self, *shape: int) -> None:
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros((max(len(rows), self.n), *self.held.shape[1:]), np.int64)])
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """What texts and their stretches give: token and group counts, how groups read, linked pairs."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # tokens of B never go on over a space
        if any(re.search("[^▁]▁", x) for x in pieces):
            raise ValueError("a piece with a space inside")
        b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(x)) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        # the byte that each character of an entry stands for: printable ones for themselves, the others in order from 256
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        own = [b for b in range(256) if chr(b) in alphabet]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        specials = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = {i: x for x, i in self.a.get_vocab().items()}
        a_bytes = [b"" if (x := vocabulary.get(i)) is None else x.encode() if x in specials else bytes(map(byte_of.__getitem__, x)) for i in range(max(vocabulary) + 1)]
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        # an id as text with what may follow it: within a side, between sides, between groups, at a stretch's end
        self.ids = max(map(len, self.bytes))
        self.told = [f"{i}{x}" for x in ",|;\n" for i in range(self.ids)]
        self._clear()

    def _clear(self) -> None:
        self.at = _Memo()
        self.groups: list[bytes | None] = []  # None: the stretch isn't what its tokens say
        self.numbers = _Rows(4)  # tokens of A, tokens of B, groups, where its pairs begin
        self.pairs = _Rows()  # linked pairs, with repetitions

    def _learn(self) -> None:
        """Aligns the stretches that are noted as new."""
        todo, self.at.todo = self.at.todo, []
        for start in range(0, len(todo), AT_A_TIME):
            some = todo[start : start + AT_A_TIME]
            a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in some], add_special_tokens=False)]
            self._add([(" " + x).encode() for x in some], a, self.b.encode(some, num_threads=1))

    def _add(self, stretches: list[bytes], *sides: list[list[int]]) -> None:
        n, whole, wrong = len(stretches), b"".join(stretches), np.zeros(len(stretches), bool)
        sizes = np.fromiter(map(len, stretches), np.int64, n)
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in sides]
        counts = [np.fromiter(map(len, x), np.int64, n) for x in sides]
        for k in (0, 1):
            ends = np.cumsum(np.concatenate([[0], self.lengths[k][ids[k]]]))[np.cumsum(np.concatenate([[0], counts[k]]))]
            said = b"".join(map(self.bytes[k].__getitem__, ids[k].tolist()))
            if said != whole or np.any(np.diff(ends) != sizes):
                wrong |= np.array([said[p:q] != x for p, q, x in zip(ends.tolist(), ends[1:].tolist(), stretches, strict=False)], bool)
        if wrong.any():
            for k in (0, 1):
                ids[k] = ids[k][np.repeat(~wrong, counts[k])]
                counts[k] = np.where(wrong, 0, counts[k])
        of = [np.repeat(np.arange(n), c) for c in counts]
        first = [np.cumsum(c) - c for c in counts]
        ends = [np.cumsum(self.lengths[k][ids[k]]) for k in (0, 1)]
        i, j = common_ends(*ends, first[1][of[0]], first[0][of[1]])
        # ranks where groups end, and of each token its group, place among all tokens told, and what follows it
        stretch = of[0][i]
        last = np.append(stretch[1:] != stretch[:-1], True)[: len(i)]
        told = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        for k, (own, other, after) in enumerate(((i, np.append(-1, j[:-1]), np.full(len(i), 1)), (j, i, np.where(last, 3, 2)))):
            group = np.repeat(np.arange(len(own)), np.diff(own, prepend=-1))
            follows = np.zeros(len(ids[k]), np.int64)
            follows[own] = after
            told[np.arange(len(ids[k])) + other[group] + 1] = ids[k] + self.ids * follows
        texts = iter("".join(map(self.told.__getitem__, told.tolist())).encode().split(b"\n"))
        n_groups = np.bincount(stretch, minlength=n)
        self.groups.extend(None if bad else next(texts) if m else b"" for bad, m in zip(wrong.tolist(), n_groups.tolist(), strict=True))
        self.numbers.add(np.stack([*counts, n_groups, self.pairs.n + np.cumsum(n_groups) - n_groups], 1))
        self.pairs.add(ids[0][i] * BASE + ids[1][j])

    def align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and B, groups and how they read, different linked pairs and how often each is linked."""
        out, start = [], 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= CHARACTERS:
                size, end = size + len(texts[end]), end + 1
            out += self._align(texts[start:end])
            start = end
        return out

    def _align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
        if len(self.at) > MEMO or self.pairs.n > HELD:
            self._clear()
        number = self.at.__getitem__
        places = [list(map(number, _CUT(sound(x)))) if x else [] for x in texts]
        self._learn()
        sizes = np.array([len(x) for x in places], np.int64)
        every = np.fromiter(chain.from_iterable(places), np.int64, int(sizes.sum()))
        own = self.numbers.held[every]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(own[:, :3], axis=0)])
        numbers = (sums[ends[1:]] - sums[ends[:-1]]).tolist()
        # of all stretches' pairs those of each text, and how often
        times = own[:, 2]
        pairs = self.pairs.held[np.repeat(own[:, 3] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        text = np.repeat(np.repeat(np.arange(len(texts)), sizes), times)
        found, linked = np.unique((text << 40) + pairs, return_counts=True)
        cuts = np.searchsorted(found, np.arange(len(texts) + 1) << 40)
        found &= (1 << 40) - 1
        none = (0, 0, 0, b"", found[:0], linked[:0])
        out = []
        for k, at in enumerate(places):
            groups = list(map(self.groups.__getitem__, at))
            if not at or None in groups:
                out.append(none)  # no text, or tokens that say something else
            else:
                out.append((*numbers[k], b";".join(groups), found[cuts[k] : cuts[k + 1]], linked[cuts[k] : cuts[k + 1]]))
        return out


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, loaded once per Python worker."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, groups, chunk, pairs, times) of each row of docs.

    groups reads a1,a2|b1;a3|b2,b3 in ids of A and B, if it is asked for; pairs are linked ids as a * BASE + b, each
    once a document, times how often it is linked there. chunk numbers stretches of rows of bounded size."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, chunk long, pairs array<long>, times array<long>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, rows = TaskContext.get().partitionId() << 32, 0, 0
        tell = aligner(a_path, b_path).align
        for batch in slices(batches):
            found, chunks = tell([x or "" for x in batch["text"].to_pylist()]), []
            for one in found:
                if rows and (held + len(one[4]) > CHUNK_PAIRS or rows == CHUNK_DOCS):
                    chunk, held, rows = chunk + 1, 0, 0
                held, rows = held + len(one[4]), rows + 1
                chunks.append(chunk)
            ends = pa.array(np.cumsum([0, *(len(x[4]) for x in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in found]), pa.int64())) for k in (4, 5)]
            numbers = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(x[3]).hexdigest() if x[3] else "" for x in found], pa.string())
            groups = pa.array([x[3].decode() if with_groups else None for x in found], pa.string())
            yield pa.record_batch([batch["doc_id"], *numbers, digests, groups, pa.array(chunks, pa.int64()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "chunk", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(align, schema)


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best) of (pair, n): how many links hold the pair, and whether no pair with its B id is in more.

    The highest counts have a row for each id of B, at most as many as its vocabulary, so they are broadcast."""
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts").withColumn("b", F.col("pair") % BASE)
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text), and groups if asked for.

    A (tokenizers, .json) encodes a space and the text, B (sentencepiece, .model) the text, to which it adds
    the space; strings of special tokens inside a text are plain text. Links are pairs of occurrences whose bytes end
    together: no token is empty, so there is one for each group. n_best counts links whose pair is linked as
    often in all documents as any with the same B id, count_sum adds the pairs' counts over links. A text that is
    null or empty, or whose tokens don't say it back, has no tokens: zeros and an empty digest.

    Null ids, repeated rows and very long texts are kept; an empty table gives an empty result; other
    columns are left out, whatever their names."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    table = stored(aligned(docs, a_path, b_path, with_groups), "alignment-documents")
    asked = table.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("chunk", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    asked = stored(asked, "alignment-pairs")
    known = asked.select("chunk", "pair").join(pair_counts(asked), "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        pairs, count, best = (right[c].to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pairs)
        lengths = np.array([0, *(len(x) for x in left["pairs"])], np.int64)
        held, times = (np.array(left[c].combine_chunks().flatten(), np.int64) for c in ("pairs", "times"))
        at = order[np.searchsorted(pairs, held, sorter=order)] if len(held) else held
        ends = np.cumsum(lengths)

        def added(x: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(x)])
            return pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64))

        return pa.table({
            "doc_id": left["doc_id"], "n_a": left["n_a"], "n_b": left["n_b"], "n_groups": left["n_groups"], "n_links": left["n_groups"],
            "n_best": added(times * best[at].astype(np.int64)), "count_sum": added(times * count[at]), "groups_sha256": left["groups_sha256"], "groups": left["groups"],
        })

    out = table.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(tell, schema)
    return out if with_groups else out.drop("groups")
