"""Fast exact encoding with public byte-pair vocabularies.

A text is split by the vocabulary's own pattern; each distinct word is encoded once per worker by the
library and remembered in flat tables, and a batch of texts becomes one table lookup.  Only texts whose characters
are all in ``_PLAIN`` and that hold no added token (such as ``<|endoftext|>``) take this way: on them the pattern's classes
and lower-casing are the same in every engine.  Any other text goes whole to the library, so ids are the library's for every input.
"""

from __future__ import annotations

import base64
import gc
import os
import re
from collections.abc import Callable, Sequence

import numpy as np

from groundspark.llm.common import gather

_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \xa0"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*\Z")
_BYTE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_LOWER_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Distinct words that a worker remembers before it starts afresh (bounds its memory, changes no result).
MEMORY_WORDS = 400_000


class _Numbered(dict):
    """Words to numbers in order of first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordTable:
    """Ids of remembered words in one flat array that grows by doubling."""

    def __init__(self, encode_words: Callable[[list[str]], list[Sequence[int]]]):
        self.encode_words = encode_words
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbered()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.length, self.known = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0

    def learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        collecting = gc.isenabled()
        gc.disable()  # one list a word makes the collector go through all of them again and again, though none is in a cycle
        try:
            found = self.encode_words(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))
            del found
        finally:
            if collecting:
                gc.enable()
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(new) > len(self.start):
            self.start, self.length = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.known, self.known + len(new))
        self.length[at], self.start[at] = lengths, self.used + np.cumsum(lengths) - lengths
        self.known, self.used = self.known + len(new), self.used + len(ids)


class Encoder:
    """``encode(texts)`` gives all ids end to end and the offsets of the texts among them; null is as empty text."""

    def __init__(self, path: str, words: re.Pattern, lower: bool, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Texts that may hold an added token (in any case, as the vocabulary may fold it) are left to the library.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.words, self.lower = words, lower
        self.table = WordTable(self._by_ranks(ranks) if ranks else self._by_library)

    def _by_library(self, words: list[str]) -> list[Sequence[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _by_ranks(path: str) -> Callable[[list[str]], list[Sequence[int]]]:
        """The same vocabulary as ranks, which its library encodes word by word several times faster."""
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [own.encode_ordinary(w) for w in words]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.table.numbers) > MEMORY_WORDS:
            self.table.clear()
        number = self.table.numbers.__getitem__
        found: list[np.ndarray | None] = []
        for text in texts:
            if not text:
                found.append(np.zeros(0, dtype=np.int32))
            elif _PLAIN.match(text) and not (self.added and self.added.search(text)):
                words = self.words.findall(text.lower() if self.lower else text)
                found.append(np.fromiter(map(number, words), np.int32, len(words)))
            else:
                found.append(None)
        self.table.learn()
        odd = [k for k, x in enumerate(found) if x is None]
        whole = dict(zip(odd, self._by_library([texts[k] for k in odd]))) if odd else {}
        pieces, counts, run = [], np.zeros(len(found), dtype=np.int64), []

        def flush() -> None:
            if run:
                w = np.concatenate([found[k] for k in run])
                lengths = self.table.length[w]
                pieces.append(gather(self.table.flat, self.table.start[w], lengths))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                sizes = np.concatenate([[0], np.cumsum([len(found[k]) for k in run])])
                counts[run] = np.diff(ends[sizes])
                run.clear()

        for k in range(len(found)):
            if found[k] is None:
                flush()
                pieces.append(np.asarray(whole[k], dtype=np.int32))
                counts[k] = len(whole[k])
            else:
                run.append(k)
        flush()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return (np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)), offsets


_ENCODERS: dict[tuple, Encoder] = {}


def byte_encoder(path: str, ranks: str | None = None) -> Encoder:
    """The worker's encoder for a byte-level vocabulary with the common pattern."""
    if (key := ("byte", path, ranks)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, _BYTE_WORDS, lower=False, ranks=ranks)
    return _ENCODERS[key]


def word_encoder(path: str) -> Encoder:
    """The worker's encoder for the lower-casing vocabulary with word ends."""
    if (key := ("word", path)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, _LOWER_WORDS, lower=True)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
