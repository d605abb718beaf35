"""All pairs of words within few edits of each other, by tries and Levenshtein automata.

How many edits are few depends on the shorter word: two from ``LONG`` letters on,
else one; words of two letters must be equal, those of three may exchange two
neighbours. A word is cut to one piece more than it may have edits, so that one
piece stands in the other word unchanged, and the edits that the others may hold
say where. Words are sharded by these pieces: each shard is a small trie, and
only words that hold the piece at a fitting place are sent to traverse it. The
traversal steps an automaton of the word along the trie and leaves a branch as
soon as no ending can be within the bound.

Distances count insertions, deletions, substitutions and exchanges of neighbours.
An exchange is two edits for the automaton, whose bound is two for all words; an
exchange and a further edit together are beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagekeep.runtime import hot_values

BOUND, LONG = 2, 8
#: Share of the rows from which on a shard is spread, and the parts it is spread to.
HOT_SHARD, SALTS = 0.01, 32


def edits_allowed(a: str, b: str) -> int:
    """Edits within which two words count as near."""
    if min(len(a), len(b)) >= LONG:
        return 2
    longer = max(len(a), len(b))
    return 1 if longer > 3 or longer == 3 and sorted(a) == sorted(b) else 0


def pieces(word: str) -> list[tuple[int, str]]:
    """Start and text of the pieces of a word, as equal as can be."""
    count = 3 if len(word) >= LONG else 2
    base, longer = divmod(len(word), count)
    found, start = [], 0
    for i in range(count):
        end = start + base + (i >= count - longer)
        found.append((start, word[start:end]))
        start = end
    return found


def shards_of(word: str) -> list[str]:
    """The shards that hold a word: length, number and text of each piece."""
    return [f"{len(word)}/{i}/{text}" for i, (_, text) in enumerate(pieces(word))]


def shards_to_ask(word: str) -> set[str]:
    """The shards in which near words may stand.

    The first piece of a near word can't be shifted, the last one is shifted by
    the difference of lengths; a middle one is asked for with one edit on each
    side of it, as otherwise another piece is whole too. An exchange across the
    border of two pieces breaks both; for it the first piece is asked for as it
    was before.
    """
    asked, size = set(), len(word)
    for length in range(max(2, size - BOUND), size + BOUND + 1):
        more = size - length
        if abs(more) > (2 if min(size, length) >= LONG else 1):
            continue
        parts = pieces("x" * length)
        for i, (start, text) in enumerate(parts):
            shifts = [0] if i == 0 else [more] if i == len(parts) - 1 else [s for s in (-1, 0, 1) if abs(more - s) <= 1]
            for at in (start + s for s in shifts):
                if 0 <= at and at + len(text) <= size:
                    asked.add(f"{length}/{i}/{word[at : at + len(text)]}")
        if len(parts) == 2 and more == 0:
            border = parts[1][0]
            asked.add(f"{length}/0/{word[: border - 1]}{word[border]}")
    return asked


class Automaton:
    """Accepts what is within ``BOUND`` edits of a word; states are rows of edit counts, made as they are met."""

    def __init__(self, word: str) -> None:
        self.word = word
        self.start = tuple(min(i, BOUND + 1) for i in range(len(word) + 1))
        self.steps: dict[tuple, tuple | None] = {}

    def step(self, state: tuple, letter: str) -> tuple | None:
        key = (state, letter)
        if key not in self.steps:
            row = [min(state[0] + 1, BOUND + 1)]
            for i, own in enumerate(self.word, 1):
                row.append(min(row[-1] + 1, state[i] + 1, state[i - 1] + (own != letter), BOUND + 1))
            self.steps[key] = tuple(row) if min(row) <= BOUND else None
        return self.steps[key]


def make_trie(words: list[str]) -> dict:
    trie: dict = {}
    for word in words:
        node = trie
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = word
    return trie


def traverse(trie: dict, automaton: Automaton) -> Iterator[str]:
    """The words of a trie that the automaton accepts."""
    open_nodes = [(trie, automaton.start)]
    while open_nodes:
        node, state = open_nodes.pop()
        for letter, child in node.items():
            if not letter:
                if state[-1] <= BOUND:
                    yield child
            elif (following := automaton.step(state, letter)) is not None:
                open_nodes.append((child, following))


def distance(a: str, b: str) -> int:
    """Edits between two words, an exchange of neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [*rows[-1:], row]
    return rows[-1][-1]


def near_words(words: DataFrame) -> DataFrame:
    """kind, word, other, distance of the near pairs of distinct (kind, word), each once: word < other.

    Words of one letter take no part. A shard is read as a run of its words
    followed by its askers, so that only one shard's words are held; a shard that
    may hold more than ``HOT_SHARD`` of the rows is copied to several parts, to
    which its askers are dealt.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(f"{kind}/{s}", False, word) for s in shards_of(word)]
                rows += [(f"{kind}/{s}", True, word) for s in shards_to_ask(word)]
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000], strict=True)
                types = (pa.string(), pa.bool_(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "asks", "word"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            types = (pa.string(), pa.string(), pa.string(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "word", "other", "distance"])

        for (shard, _), run in groupby(entries(batches), key=lambda e: (e[0], e[1])):
            held: list[str] = []
            trie, kind = None, shard.partition("/")[0]
            for _, _, asks, word in run:
                if not asks:
                    held.append(word)
                    continue
                if not held:
                    break
                if word >= held[-1]:  # they come sorted, and each pair is given once
                    continue
                trie = trie if trie is not None else make_trie(held)
                for other in traverse(trie, Automaton(word)):
                    if other > word and (allowed := edits_allowed(word, other)) and (edits := distance(word, other)) <= allowed:
                        found.append((kind, word, other, edits))
            if len(found) >= 20_000:
                yield flush()
        yield flush()

    rows = words.filter(F.length("word") > 1).select("kind", "word").mapInArrow(spread, "shard string, asks boolean, word string")
    hot = hot_values(rows.select("shard"), "shard", HOT_SHARD)
    is_hot = F.col("shard").isin(hot) if hot else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    own = F.array(F.when(is_hot, F.pmod(F.hash("word"), F.lit(SALTS))).otherwise(F.lit(0)))
    dealt = rows.withColumn("part", F.explode(F.when(is_hot & ~F.col("asks"), every).otherwise(own)))
    return (
        dealt.select("shard", "part", "asks", "word")
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "part", "asks", "word")
        .mapInArrow(join, "kind string, word string, other string, distance int")
        .distinct()
    )
