"""Byte-level byte-pair encoding by a finite-state transducer that is determinised as it is used.

The merges of a vocabulary define for every string of bytes one sequence of tokens. Such a sequence can be told by its
neighbours alone: it is the encoding if, and only if, each pair of adjacent tokens is the encoding of
their bytes. So each prefix of a string has one possible last token, and reading a byte extends some
earlier prefix by a token that ends there.

A state of the transducer is what the future depends on: the longest suffix read that begins some token, and for each
place in it the last token of the prefix that ends there and the tokens not yet emitted. What all
places have in common can't change any more and is emitted; so tokens come out after a lookahead
of at most the longest token. States are made when first reached, and all are forgotten when there are
too many.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import regex

#: Fixed value: the pattern by which byte_bpe_50k splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

MAX_STATES = 1 << 18
MAX_WORDS = 1 << 19


def load_ranks(name: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The tokens of a rank file, bytes -> id; a lesser id is an earlier merge."""
    with open(os.path.join(folder, name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one pretoken, a string of bytes, after another."""

    START = 0

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._ending: dict[bytes, list[tuple[int, int]]] = {}
        self._forget()

    def _forget(self) -> None:
        """Begin anew with what was learnt from texts; what is known of single tokens is bounded by the vocabulary and stays."""
        self._fits.clear()
        self._ending.clear()
        start = (b"", ((),), (-1,))
        self._states = [start]
        self._number = {start: self.START}
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.final: list[tuple[int, ...]] = [()]

    def merge(self, text: bytes) -> list[int]:
        """The encoding by definition: again and again the merge of least rank. Quadratic; for short strings."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether token can follow before; -1 is the start."""
        known = self._fits.get((before, token))
        if known is None:
            if token not in self._whole:
                self._whole[token] = self.merge(self.tokens[token]) == [token]
            known = self._whole[token] and (before < 0 or self.merge(self.tokens[before] + self.tokens[token]) == [before, token])
            self._fits[before, token] = known
        return known

    def _tokens_ending(self, suffix: bytes) -> list[tuple[int, int]]:
        """(length, id) of the tokens that end suffix, longest first."""
        found = self._ending.get(suffix)
        if found is None:
            found = [(len(suffix) - k, self.ranks[suffix[k:]]) for k in range(len(suffix)) if suffix[k:] in self.ranks]
            self._ending[suffix] = found
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens that are certain now."""
        known = self._next[state].get(byte)
        if known is not None:
            return known
        suffix, pending, lasts = self._states[state]
        longer = suffix + bytes((byte,))
        read = longer
        while read not in self.prefixes:
            read = read[1:]
        places = len(longer)  # the place of the new end; place 0 is where suffix begins
        for length, token in self._tokens_ending(longer):
            if self.fits(lasts[places - length], token):
                pending, lasts = (*pending, (*pending[places - length], token)), (*lasts, token)
                break
        else:
            raise AssertionError("each byte is a token, so one fits")
        keep = len(read) + 1
        pending, lasts = pending[-keep:], lasts[-keep:]
        shared = 0
        shortest = min(map(len, pending))
        first = pending[0]
        while shared < shortest and all(p[shared] == first[shared] for p in pending):
            shared += 1
        out = first[:shared]
        after = (read, tuple(p[shared:] for p in pending), lasts)
        number = self._number.get(after)
        if number is None:
            number = len(self._states)
            self._number[after] = number
            self._states.append(after)
            self._next.append({})
            self.final.append(after[1][-1])
        self._next[state][byte] = number, out
        return number, out

    def encode(self, pretoken: bytes) -> tuple[int, ...]:
        """The ids of one pretoken."""
        if len(self._states) > MAX_STATES:
            self._forget()
        state, out = self.START, []
        for byte in pretoken:
            state, sure = self.move(state, byte)
            out += sure
        return (*out, *self.final[state])


class _Words(dict):
    """Pretoken -> ids: ways through the transducer as one step. Forgotten when there are too many."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = found
        return found


class Tokenizer:
    """Texts to ids and back. Names of special tokens inside a text are ordinary text."""

    def __init__(self, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS, pattern: str = PATTERN) -> None:
        self.transducer = Transducer(load_ranks(name, folder))
        self.words = _Words(self.transducer)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0

    def encode_stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """The ids of UTF-8 text that comes in pieces cut anywhere. Held back is the last pretoken, which more text could make longer, and one that begins in the last two characters, which could become a contraction."""
        decoder, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
        for piece, last in chain(((p, False) for p in pieces), [(b"", True)]):
            rest += decoder.decode(piece, last)
            found = self.split(rest)
            ready = found if last else found[:-1]
            if ready and not last and len(found[-1]) + len(ready[-1]) <= 2:
                ready = ready[:-1]
            rest = rest[sum(map(len, ready)) :]
            for word in ready:
                yield from self.words[word]

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, as far as its bytes are whole characters; bytes that are none become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := decoder.decode(self.transducer.tokens[i]):
                yield text
        if text := decoder.decode(b"", True):
            yield text

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_LOADED: dict[tuple[str, str, str], Tokenizer] = {}


def tokenizer(name: str = BYTE_BPE_50K, folder: str = TOKENIZERS, pattern: str = PATTERN) -> Tokenizer:
    """The tokenizer of this process, loaded once."""
    key = (name, folder, pattern)
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(*key)
    return _LOADED[key]
