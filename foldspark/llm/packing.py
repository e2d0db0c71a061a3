"""Packing of tokenised documents into sequences by swap-based local search (operator 5).

Documents are tokenised where they are read; only (document, piece, length) rows are shuffled, dealt by hash to groups
of bounded size. A group starts from a plain fill in order of arrival. The local search then works on its least filled
bin: it moves a document to another underfull bin that has room, or exchanges one for one, two for one or one for two,
always towards a greater sum of squared fills, until the bin is empty or no step is left; then it takes up the next
one, until no bin of the group allows a step or the free room of the others can't hold the least filled one. As a group
has thousands of pieces, parting the corpus costs at most one underfull bin a group.

Edge cases: a null or empty text is the end id alone; a very long text is cut into full pieces and a rest; repeated rows
are packed as documents of their own, dealt to groups by a copy number; of equal lengths the earlier row is taken; a null
id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from foldspark.llm.common import BLOCK_BYTES, map_rows

CAPACITY, END_ID = 2048, 0
#: Documents in a group.
GROUP_DOCS = 4096
#: Stretches and words beyond which a Python worker forgets those that only one block of texts had.
REMEMBERED = 400_000
#: Characters for which lower-casing and normal form C act on each alone, whatever the library's Unicode version.
_SIMPLE = re.compile("[^\t\n\r -~\xa0-˿Ѐ-ԯ]|<\\|")
#: The tokenizer's pattern of words (a fixed value), and the same in Python for the characters above.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves, others follow."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """The ids of texts, remembered by stretches between white space where the tokenizer treats these apart.

    The stretches of a block of texts are told apart by Arrow, and only those that are new become Python objects. They
    are cut into the tokenizer's words here, so that the library only merges words that are new as well.
    Where the definition isn't of this make, or a text has other characters, the library reads the whole text.
    """

    def __init__(self, definition: str):
        self.whole = Tokenizer.from_str(definition)
        self.inner = None
        parsed = json.loads(definition)
        steps = [s["type"] for s in (parsed.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        cut = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
        letters = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        like = len(cuts) == 2 and cuts[0] == cut and letters.items() <= cuts[1].items()
        if steps == ["NFC", "Replace", "Lowercase"] and like and not parsed["model"].get("dropout"):
            self.inner = Tokenizer.from_str(json.dumps(parsed | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
            self.closing = self._closing(parsed["model"].get("end_of_word_suffix"))
        self.letters = dict(enumerate(_byte_letters()))
        self._forget()

    def _forget(self) -> None:
        """Known stretches and words, where each one's ids end in ``ids``, and whether a later block had it too."""
        self.known = pa.array([], pa.large_string())
        self.ends = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.again = np.zeros(0, dtype=bool)

    def _closing(self, suffix: str | None) -> np.ndarray:
        """By id, whether its token ends a word."""
        tokens = self.inner.get_vocab(with_added_tokens=False)
        closing = np.zeros(max(tokens.values()) + 1, dtype=bool)
        closing[[i for token, i in tokens.items() if suffix and token.endswith(suffix)]] = True
        return closing

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        simple = [self.inner is not None and not _SIMPLE.search(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t, s in zip(texts, simple) if s], pa.large_string()))
        stretches = split.flatten().dictionary_encode()
        ids, ends = self._gather(self._rows_of(stretches.dictionary)[stretches.indices.to_numpy()])
        bounds = iter((4 * ends[split.offsets.to_numpy()]).tolist())
        ids, at, made = ids.tobytes(), next(bounds), []
        for text, s in zip(texts, simple):
            begin, at = at, next(bounds) if s else at
            made.append(ids[begin:at] if s else self._encode(text))
        return made

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known ``rows`` one after the other, and where each row's begin; the last number is their count."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.ends[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _rows_of(self, stretches: pa.Array) -> np.ndarray:
        """The rows of different ``stretches`` among the known ones, where new ones are added."""
        if len(self.known) > REMEMBERED:
            self._thin_out()
        rows, new = self._find(stretches)
        self.again[rows[~new]] = True
        if not new.any():
            return rows
        places, found = np.flatnonzero(new), stretches.filter(pa.array(new)).to_pylist()
        plain = np.array([w.isalpha() for w in found])
        mixed = [_WORD.findall(w) for w, p in zip(found, plain) if not p]
        rows[places[plain]] = self._learn([w for w, p in zip(found, plain) if p])
        if not mixed:
            return rows
        parts = pa.array([w for words in mixed for w in words], pa.large_string()).dictionary_encode()
        of_part, unknown = self._find(parts.dictionary)
        of_part[unknown] = self._learn(parts.dictionary.filter(pa.array(unknown)).to_pylist())
        ids, ends = self._gather(of_part[parts.indices.to_numpy()])
        # A stretch that is one word is known as that by now.
        rows[places[~plain]], missing = self._find(stretches.take(pa.array(places[~plain])))
        ends = ends[np.cumsum([0, *map(len, mixed)])]
        kept = np.repeat(missing, np.diff(ends))
        words = [w for w, p in zip(found, plain) if not p]
        rows[places[~plain][missing]] = self._add([w for w, m in zip(words, missing) if m], ids[kept], np.diff(ends)[missing])
        return rows

    def _find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of words among the known ones, and which aren't known."""
        rows = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return rows, rows < 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rows that new words get."""
        rows = np.arange(len(self.known), len(self.known) + len(words))
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.large_string())])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        self.again = np.concatenate([self.again, np.zeros(len(words), dtype=bool)])
        return rows

    def _thin_out(self) -> None:
        """Keep what more than one block had; start afresh where that is most of it."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > REMEMBERED:
            return self._forget()
        words, (ids, ends) = self.known.take(pa.array(kept)), self._gather(kept)
        self.known, self.ends, self.ids, self.again = words, ends, ids, np.zeros(len(kept), dtype=bool)

    def _learn(self, words: list[str]) -> np.ndarray:
        ids, sizes = [], []
        for at in range(0, len(words), 4096):
            part = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words[at : at + 4096]]
            # Without offsets, which cost half the time, the library doesn't say where words end; their last tokens do.
            made = np.array(self.inner.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.closing[made]) + 1
            if len(ends) != len(part) or ends[-1] != len(made):
                slow = self.inner.encode(part, is_pretokenized=True, add_special_tokens=False)
                made, ends = np.array(slow.ids, dtype=np.int64), np.cumsum(np.bincount(np.array(slow.word_ids, dtype=np.int64), minlength=len(part)))
            ids.append(made)
            sizes.append(np.diff(ends, prepend=0))
        return self._add(words, np.concatenate(ids), np.concatenate(sizes)) if words else np.zeros(0, dtype=np.int64)

    def _encode(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str) -> WordTokenizer:
    return WordTokenizer(definition)


def tokenize(docs: DataFrame, definition: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, as little-endian unsigned 32-bit integers in a binary column."""
    end = int(end_id).to_bytes(4, "little")

    def rows(columns: list[list]) -> Iterator[tuple]:
        doc_ids, texts = columns
        for doc_id, ids in zip(doc_ids, _tokenizer(definition).encode_block([t or "" for t in texts])):
            yield doc_id, ids + end

    # Larger blocks repeat fewer stretches, each of which is looked up once a block.
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, ids binary", batch=2048, size=2 * BLOCK_BYTES)


def cut_pieces(tokenized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents cut into pieces of at most ``capacity`` ids."""
    count = F.ceil(F.octet_length("ids") / (4 * capacity)).cast("int")
    pieces = tokenized.select("doc_id", "ids", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("piece"))
    part = F.substring("ids", F.col("piece") * (4 * capacity) + 1, F.lit(4 * capacity))
    return pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), (F.octet_length(part) / 4).cast("long").alias("length"), part.alias("ids"))


def next_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length in order of arrival: the last bin if it has room, else a new one."""
    bins, room, last = [], 0, -1
    for length in lengths.tolist():
        if length > room:
            last, room = last + 1, capacity
        room -= length
        bins.append(last)
    return np.array(bins, dtype=np.int64)


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """The bins after the local search, numbered from 0 without gaps.

    Each step raises the sum of squared fills, so the search ends. It stops early only where the least filled bin
    holds more than the room of all others, so that no bin can be emptied.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    moved = True
    while moved:
        moved = False
        waiting = fill > 0
        while waiting.any():
            source = int(np.where(waiting, fill, capacity + 1).argmin())
            waiting[source] = False
            if fill[source] == capacity:
                break
            if fill[source] == fill[fill > 0].min() and (capacity - fill[fill > 0]).sum() - (capacity - fill[source]) < fill[source]:
                return np.unique(bins, return_inverse=True)[1]
            while fill[source] and (step := _best_step(lengths, bins, fill, capacity, source)):
                out, back, target = step
                bins[out], bins[back] = target, source
                gain = int(lengths[out].sum() - lengths[back].sum())
                fill[target] += gain
                fill[source] -= gain
                moved = True
    return np.unique(bins, return_inverse=True)[1]


def _best_step(lengths, bins, fill, capacity, source):
    """(documents that leave the source, documents that come back, other bin) of a step, None if there is none.

    The first kind of step that exists is taken: a move of the longest document that fits anywhere, into the fullest
    such bin; else the exchange of one for one, two for one or one for two that takes most from the source.
    """
    own = np.flatnonzero(bins == source)
    own = own[np.argsort(lengths[own], kind="stable")]
    sizes = lengths[own]
    room = np.where(fill > 0, capacity - fill, 0)
    room[source] = 0
    # A gain must make the other bin fuller than the source is now.
    least = np.maximum(1, fill[source] - fill + 1)
    room[room < least] = 0
    fitting = int(np.searchsorted(sizes, room.max(), side="right"))
    for k in range(fitting - 1, -1, -1):
        fits = np.flatnonzero((room >= sizes[k]) & (sizes[k] >= least))
        if len(fits):
            return own[k : k + 1], own[:0], int(fits[room[fits].argmin()])
    others = np.flatnonzero(room[bins])
    if not len(others):
        return None
    there, back = bins[others], lengths[others]
    most, need = room[there], least[there]

    def greatest(gain: np.ndarray, allowed: np.ndarray) -> tuple[int, int]:
        gain = np.where(allowed & (gain <= most) & (gain >= need), gain, 0)
        k = int(gain.argmax())
        return int(gain[k]), k

    # One for one: for each document elsewhere the longest own one that its bin can take instead.
    at = np.searchsorted(sizes, back + most, side="right") - 1
    gain, k = greatest(sizes[at] - back, at >= 0)
    if gain:
        return own[at[k] : at[k] + 1], others[k : k + 1], int(there[k])
    # Two for one: with each own document the longest other own one that fits beside it.
    best, found = 0, None
    for i, first in enumerate(sizes[:-1]):
        pair = np.searchsorted(sizes[i + 1 :], back + most - first, side="right") + i
        gain, k = greatest(first + sizes[pair] - back, pair > i)
        if gain > best:
            best, found = gain, (own[[i, pair[k]]], others[k : k + 1], int(there[k]))
    if best:
        return found
    # One for two: with each document elsewhere the shortest other one of its bin that makes enough room.
    order = np.lexsort((back, there))
    others, there, back, most, need = others[order], there[order], back[order], most[order], need[order]
    base = there * (2 * capacity + 2)
    for i in range(len(sizes)):
        second = np.searchsorted(base + back, base + np.clip(sizes[i] - most - back, 0, capacity + 1))
        second += second == np.arange(len(others))
        inside = second < len(others)
        second = np.minimum(second, len(others) - 1)
        gain, k = greatest(sizes[i] - back - back[second], inside & (there[second] == there))
        if gain > best:
            best, found = gain, (own[i : i + 1], others[[k, second[k]]], int(there[k]))
    return found


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset.

    ``n_docs`` sets the number of groups; a group packs alone, so none grows with the corpus. Equal rows are counted
    before the shuffle and then told apart by a number, which spreads them over the groups.
    """
    groups = max(1, -(-n_docs // group_docs))

    def fill_bins(group: pd.DataFrame) -> pd.DataFrame:
        # The order of arrival is that of a hash, so that it depends on the rows alone.
        group = group.sort_values(["mix", "doc_id", "piece", "ids_crc32", "copy"], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins = improve(lengths, next_fit(lengths, capacity), capacity)
        group["sequence_id"] = (int(group["part"].iloc[0]) << 32) + bins
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns=["part", "mix", "copy"])

    alike = pieces.groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("copies"))
    single = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    mixed = single.withColumn("mix", F.xxhash64("doc_id", "piece", "ids_crc32", "copy"))
    dealt = mixed.withColumn("part", F.pmod("mix", F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(fill_bins, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, definition: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The place of every document's pieces in sequences of at most ``capacity`` ids, with a digest of their ids."""
    pieces = cut_pieces(tokenize(docs, definition, id_col=id_col, text_col=text_col), capacity)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(light, docs.count(), capacity)
