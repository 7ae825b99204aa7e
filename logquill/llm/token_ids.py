"""Token ids of whole texts under a byte-level BPE file, for packing and the token store.

Every id comes from the tokenizers library and the .json file with add_special_tokens=False. Its
pattern cuts a text into words that are encoded apart from each other, so a worker keeps what the
library gave for a word in a bounded memo and hands over only the words that it hasn't seen. Which
code points are letters, digits or white space to the pattern is asked of the library once per
worker, up to KNOWN; a stretch of text with another code point, or with a special string, goes to
the library as it is. Long texts are handled in stretches, cut where the pattern always cuts.
"""

from __future__ import annotations

import array
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

#: Code points below this are told apart by class; those above go to the library.
KNOWN = 0x3000
#: Words that the memo holds at most between batches (some 200 bytes each), the longest that it keeps,
#: and words encoded at a time.
MEMO, LONGEST, WORDS_AT_A_TIME = 1_000_000, 64, 20_000
#: Characters of a stretch of a long text, about.
STRETCH = 1 << 20


def _ranges(points: list[int]) -> str:
    """A regular expression's class content of the sorted code points."""
    cuts = [i for i in range(len(points) + 1) if i in (0, len(points)) or points[i] != points[i - 1] + 1]
    return "".join(rf"\u{points[a]:04x}-\u{points[b - 1]:04x}" for a, b in zip(cuts, cuts[1:], strict=False))


class _Memo(dict):
    """Ids, as bytes, by word; a word that isn't held is noted in todo and stands for None."""

    def __init__(self) -> None:
        super().__init__()
        self.todo: list[str] = []

    def __missing__(self, word: str) -> None:
        self.todo.append(word)
        self[word] = None


class Encoder:
    """From texts to their ids, each as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = MEMO) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters, digits, spaces = self._classes()
        # the pattern of the byte-level step, with classes written out
        self.words = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        ).findall
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        if not all("<" in x for x in specials):
            raise ValueError("a special string without '<'")
        self.other = re.compile("|".join([rf"[^\0-\u{KNOWN - 1:04x}]", *map(re.escape, specials)])).search
        self.gap = re.compile(f"(?<=[^{spaces}]) (?=[^{spaces}])").search
        # words are cut already: the same file without the pattern, and without a second memo
        self.of_words = Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_words.model._resize_cache(0)
        self.memo = _Memo()

    def _classes(self) -> tuple[str, str, str]:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        found: tuple[list[int], ...] = ([], [], [])
        for point in range(KNOWN):
            c = chr(point)
            joined = [k for k, before in enumerate("a1!") if len(pieces(before + c)) == 1]
            if joined != [2]:  # not one of the remaining characters
                found[joined[0] if joined else 2].append(point)
        return tuple(map(_ranges, found))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH and (gap := self.gap(text, start + STRETCH)):
            yield text[start : gap.start()]
            start = gap.start()
        yield text[start:] if start else text

    def _learn(self) -> None:
        """Puts the ids of the noted words into the memo."""
        todo, self.memo.todo = self.memo.todo, []
        for start in range(0, len(todo), WORDS_AT_A_TIME):
            some = todo[start : start + WORDS_AT_A_TIME]
            for word, found in zip(some, self.of_words.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[word] = array.array("I", found.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        memo, parts = self.memo, []
        for text in texts:
            own = []
            for stretch in self._stretches(sound(text)):
                if not (stretch.isascii() and "<" not in stretch) and self.other(stretch):
                    own.append(self._library([stretch])[0])
                    continue
                words = self.words(stretch)
                try:
                    own.append(b"".join(map(memo.__getitem__, words)))
                except TypeError:  # a word is new; all have been looked up, so all new ones are noted
                    own.append(words)
            parts.append(own)
        todo = memo.todo
        self._learn()
        out = [b"".join([x if isinstance(x, bytes) else b"".join(map(memo.__getitem__, x)) for x in own]) for own in parts]
        for word in todo:
            if len(word) > LONGEST:
                del memo[word]
        if len(memo) > self.most:
            memo.clear()
        return out


@functools.cache
def encoder(path: str | None = None, most: int = MEMO) -> Encoder:
    """The encoder of a file with a memo of that many words at most, loaded once per Python worker."""
    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), most)


_SURROGATES = re.compile("[\ud800-\udfff]")


def sound(text: str) -> str:
    """text without lone surrogates, which UTF-8 can't hold."""
    return text if text.isascii() else _SURROGATES.sub("�", text)
