"""Byte-pair encoding with a public vocabulary, in linear time (problem 6).

The bytes of a text are mapped to Latin-1 characters, so that an Aho-Corasick
automaton over characters finds, for each byte, the longest token that starts
there. A text is encoded by taking longest matches from left to right; where two
neighbours are not what the merges would give, the search steps back to the next
shorter token. Whether two tokens may stand side by side is remembered per pair,
and positions that led nowhere are never tried again, so the work is linear.

The vocabulary file's path is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

import base64
import functools
import re
from itertools import chain

import ahocorasick
import regex

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A blank beside other white space; texts without one fall apart at each blank, which then belongs to what follows.
LOOSE_BLANK = re.compile(r" \s|\s |\x00|^ | $")

#: Words, and pairs of tokens, that a Python worker remembers; beyond that its memory starts anew.
REMEMBERED = 300_000


class BytePairEncoder(dict):
    """Maps a stretch of text to its tuple of ids, computed when first asked for."""

    def __init__(self, path: str = VOCABULARY, pattern: str = SPLIT) -> None:
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.ranks: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, _, rank = line.strip().partition(b" ")
                if rank:
                    self.ranks[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        pieces = self.split(stretch)
        if len(pieces) > 1:
            ids = tuple(chain.from_iterable(map(self.__getitem__, pieces)))
        else:
            ids = tuple(self.encode_bytes(stretch.encode("utf-8", "surrogatepass").decode("latin-1")))
        self[stretch] = ids
        return ids

    def stretches(self, text: str) -> list[str]:
        """Parts of a text that are encoded alone: words with the blank before them, or else the split's own pieces."""
        if LOOSE_BLANK.search(text):
            return self.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.stretches(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.stretches(text))))

    def encode_bytes(self, data: str) -> list[int]:
        """Ids of ``data``, bytes written as Latin-1 characters, without any split."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        longest: list[int] = [-1] * len(data)
        for end, (length, token) in self.automaton.iter(data):
            start, best = end - length + 1, longest[end - length + 1]
            if best < 0 or len(self.tokens[best]) < length:
                longest[start] = token
        alive = bytearray(b"\x01" * (len(data) + 1))
        ids: list[int] = []
        start, token = 0, longest[0] if data else -1
        while start < len(data):
            while token is not None:
                end = start + len(self.tokens[token])
                if alive[end] and (not ids or self.may_follow(ids[-1], token)):
                    break
                token = self.next_shorter(token)
            if token is None:  # nothing fits here: this place is dead, take back the token before it
                alive[start] = 0
                token = ids.pop()
                start -= len(self.tokens[token])
                continue
            ids.append(token)
            start = end
            token = longest[start] if start < len(data) else None
        return ids

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper beginning of ``token``."""
        if token not in self.shorter:
            text = self.tokens[token]
            starts = (self.ranks.get(text[:n]) for n in range(len(text) - 1, 0, -1))
            self.shorter[token] = next((rank for rank in starts if rank is not None), None)
        return self.shorter[token]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the merges leave the two tokens side by side as they are."""
        pair = (first, second)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[pair] = self.stays_apart(first, second)
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, the latest first, and look whether their inner ends would have joined before.

        Of two merges of one rank the left one comes first: one across the border must come before those of the
        left token, and no later than those of the right one.
        """
        before = len(self.ranks)
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], before) < before:
                return False
            of_left, of_right = self.split_token(left), self.split_token(right)
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True

    def split_token(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merge of this rank joins; None for a single byte."""
        if token not in self.halves:
            parts = self.merge(self.tokens[token], token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def merge(self, data: str, below: int | None = None) -> list[int]:
        """The plain definition: join the neighbours of lowest rank, the leftmost first, while any can be joined.

        With ``below`` only the merges that come before that rank are made.
        """
        below = len(self.ranks) if below is None else below
        parts = list(data)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> BytePairEncoder:
    """One encoder for each Python worker and vocabulary."""
    return BytePairEncoder(path)
