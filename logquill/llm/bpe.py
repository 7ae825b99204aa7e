"""BPE encoding and decoding with contiguous rank arrays.

A word is an array of parts (the stretches between its boundaries) and an array of the ranks of
adjacent parts. The smallest rank is looked for again and again; its boundary is deleted and the
ranks on either side are refreshed. Words are short, so scanning beats a queue; a word of more than
SHORT parts, such as a long run of symbols, is merged through a heap. What a stretch of text without
white space gives is kept by worker in two bounded generations of a memo; what the words in it give,
which many stretches share ("word", "Word,", "(word)"), in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from logquill.llm.common import slices
from logquill.llm.token_ids import sound

SHORT = 96
#: Stretches that a generation of the memo holds at most, and words in the cache: some 300 MB in all.
MEMO, WORDS = 300_000, 300_000
#: White space as the tokenizer's patterns have it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + chr(0x2000) + "-" + chr(0x200A)
FAR = 1 << 60
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free
    code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a BPE file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        library = Tokenizer.from_file(path)
        self.normal, self.cut_words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        # the pattern of the file for lower-case ASCII without white space
        self.find_words = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.find_runs = re.compile(f"[^{SPACE}]+").findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.letters = dict(enumerate(byte_letters()))
        self.cached_forms = functools.lru_cache(WORDS)(self.word_forms)
        self.young: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def word_ids(self, word: str) -> list[int]:
        parts = [self.vocab[x] for x in word[:-1]]
        parts.append(self.vocab[word[-1] + self.suffix])
        return self.scan(parts) if len(parts) <= SHORT else self.queue(parts)

    def scan(self, parts: list[int]) -> list[int]:
        get, none = self.ranks.get, (FAR, -1)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least[0] == FAR:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def queue(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get((parts[k], parts[after[k]]))):
                    heapq.heappush(heap, (r[0], k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def words_of(self, run: str) -> list[str]:
        """The words of text without white space, written in the letters of bytes. ASCII text is
        lower-cased and cut here; what other code points compose to and which of them are letters
        or digits is the library's to say."""
        if run.isascii():
            words = self.find_words(run.lower())
            return words if run.isprintable() else [word.translate(self.letters) for word in words]
        return [word for word, _ in self.cut_words(self.normal(run))]

    def word_forms(self, word: str) -> tuple[str, str, int]:
        """Ids and tokens, each joined by spaces, and their number, of a word."""
        ids = self.word_ids(word)
        return " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids)), len(ids)

    def run_forms(self, run: str) -> tuple[str, str, int]:
        """The same of text without white space."""
        found = [self.cached_forms(w) if len(w) <= SHORT else self.word_forms(w) for w in self.words_of(run)]
        if len(found) == 1:
            return found[0]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum(x[2] for x in found)

    def forms(self, text: str) -> list[tuple[str, str, int]]:
        out = []
        for k, part in enumerate(self.cut_special(text) if "<|" in text else [text]):
            if k % 2:
                out.append((str(self.special[part]), part, 1))
                continue
            for run in self.find_runs(part):
                found = self.young.get(run)
                if found is None:
                    found = self.old.get(run) or self.run_forms(run)
                    if len(self.young) >= MEMO:
                        self.old, self.young = self.young, {}
                    if len(run) <= SHORT:
                        self.young[run] = found
                out.append(found)
        return [x for x in out if x[2]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.forms(text) for i in x[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file has no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of decoded text for docs (doc_id, text).

    A null text is empty: no tokens, digests of the empty string. Null ids and repeated rows are
    kept; an empty table gives an empty one; whole texts are encoded."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                forms = bpe.forms(sound(text or ""))
                rows.append((sum(x[2] for x in forms), *(hashlib.sha256(" ".join([x[k] for x in forms]).encode()).hexdigest() for k in (0, 1))))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digests, DIGESTS)
