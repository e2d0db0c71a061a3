"""Byte-level BPE by corpus-level merge replay (operator 6).

The corpus here is all words of a block of documents that the task has not met before. An inverted index leads from
each rank to the positions where a pair that merges at this rank begins; the ranks are replayed in order over all words
at once with array operations, and only the neighbours of a merged pair get new index entries. The ids of a word are
then remembered by the task, up to a bound, and a document's ids are those of its words.

Edge cases: a null or empty text has no ids; a very long text is a block of its own, encoded whole; of equal pairs the
leftmost merges first; repeated rows keep their rows; a null id stays null; other columns are ignored; an empty table
gives an empty result. An id that the vocabulary lacks makes decoding fail.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import map_rows

#: Words whose ids a Python worker remembers at most; beyond this it starts afresh.
REMEMBERED = 250_000
#: Characters in the block of documents whose new words are replayed together.
BLOCK_CHARS = 4_000_000


class Vocabulary:
    """The ranks of a vocabulary file, its tokens by rank and the pairs that merge."""

    def __init__(self, ranks_file: bytes):
        lines = (line.split() for line in ranks_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        codes, products = [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    products.append(rank)
        order = np.argsort(codes)
        self.codes = np.append(np.array(codes, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.products = np.append(np.array(products, dtype=np.int64)[order], -1)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair of ids merges, or -1."""
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.products[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each (non-empty) word as little-endian unsigned 32-bit integers, by replaying the merges over all words in the order of rank."""
        lengths = np.array([len(w) for w in words])
        token = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        size, word = len(token), np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        ends = np.cumsum(lengths)
        after[ends - 1], before[ends - lengths] = -1, -1
        merges_at = np.full(size, -1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(ranks: np.ndarray, at: np.ndarray) -> None:
            found = ranks >= 0
            ranks, at = ranks[found], at[found]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, begin, end in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(at[begin:end])

        first = np.flatnonzero(after >= 0).astype(np.int32)
        merges_at[first] = self.product(token[first], token[first + 1])
        enter(merges_at[first], first)
        while queue:
            rank = heapq.heappop(queue)
            at = np.concatenate(index.pop(rank))
            at = _distinct(at[merges_at[at] == rank])
            if not len(at):
                continue
            chosen = self._chosen(rank, at, word, token, after, before)
            if len(chosen) < len(at):
                enter(np.full(len(at), rank), at)
            gone = after[chosen]
            beyond = after[gone]
            token[chosen], token[gone], merges_at[gone] = rank, -1, -1
            after[chosen] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = chosen[inner]
            touched = _distinct(np.concatenate([chosen, before[chosen][before[chosen] >= 0]]))
            follows = after[touched]
            merges_at[touched] = np.where(follows >= 0, self.product(token[touched], token[follows]), -1)
            enter(merges_at[touched], touched)
        alive = token >= 0
        stops = 4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))
        made = token[alive].astype("<u4").tobytes()
        return [made[begin:end] for begin, end in zip([0, *stops.tolist()], stops.tolist())]

    def _chosen(self, rank, at, word, token, after, before) -> np.ndarray:
        """Of a rank's positions (ascending) those to merge now.

        A word's first position is always right. Its others, left to right without overlap, are merged at once if no
        pair that this can create merges as early as this rank; else they wait until those pairs have had their turn.
        """
        opens = np.append(True, word[at][1:] != word[at][:-1])
        if opens.all():
            return at
        chained = np.append(False, after[at[:-1]] == at[1:])
        run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        apart = (np.arange(len(at)) - run) % 2 == 0
        left, right = before[at], after[after[at]]
        same = np.full(len(at), rank)
        made = [self.product(token[left], same), self.product(same, token[right]), self.product(same, same)]
        made[0][left < 0] = made[1][right < 0] = -1
        early = np.logical_or.reduce([(m >= 0) & (m <= rank) for m in made])
        waits = np.isin(word[at], word[at][early])
        return at[opens | (apart & ~waits)]


def _distinct(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    return positions[np.append(True, positions[1:] != positions[:-1])] if len(positions) else positions


class Words(dict):
    """Numbers words in the order in which they are met; ``ids`` has their ids, as bytes, by number."""

    def __init__(self):
        super().__init__()
        self.ids: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def clear(self) -> None:
        super().clear()
        self.ids.clear()


@functools.lru_cache(maxsize=2)
def _vocabulary(ranks_file: bytes) -> tuple[Vocabulary, Words]:
    """A worker's vocabulary and the words that it has met."""
    return Vocabulary(ranks_file), Words()


def encode_block(texts: list[str | None], pattern, vocabulary: Vocabulary, known: Words) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    if len(known) > REMEMBERED:
        known.clear()
    before = len(known)
    # A document is held as the numbers of its words, which takes a tenth of the words' own memory.
    numbered = [array("i", map(known.__getitem__, pattern.findall(t))) if t else array("i") for t in texts]
    new = [w.encode() for w in itertools.islice(known, before, None)]
    whole = [vocabulary.ranks.get(w, -1) for w in new]
    merged = iter(vocabulary.replay([w for w, rank in zip(new, whole) if rank < 0]) if -1 in whole else ())
    known.ids.extend(int(rank).to_bytes(4, "little") if rank >= 0 else next(merged) for rank in whole)
    for numbers in numbered:
        yield b"".join(map(known.ids.__getitem__, numbers))


def _blocks(columns: list[list], most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of consecutive rows with about ``most`` characters together."""
    begin = size = 0
    ids, texts = columns
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most or k + 1 == len(texts):
            yield ids[begin : k + 1], texts[begin : k + 1]
            begin, size = k + 1, 0


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers in a binary column."""

    def rows(columns: list[list]) -> Iterator[tuple]:
        vocabulary, known = _vocabulary(ranks_file)
        words = regex.compile(pattern)
        for doc_ids, texts in _blocks(columns, BLOCK_CHARS):
            yield from zip(doc_ids, encode_block(texts, words, vocabulary, known))

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, ids binary", batch=1500)


def decode(encoded: DataFrame, ranks_file: bytes) -> DataFrame:
    """encoded (doc_id, ids) with the column ``decoded``, the bytes of the ids' tokens."""

    def rows(columns: list[list]) -> Iterator[tuple]:
        token = _vocabulary(ranks_file)[0].tokens.__getitem__
        for doc_id, ids in zip(*columns):
            yield doc_id, ids, b"".join(map(token, np.frombuffer(ids or b"", dtype="<u4").tolist()))

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of each text's ids and of the bytes that they decode to."""
    both = decode(encode(docs, ranks_file, pattern, id_col, text_col), ranks_file)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
