"""Toxicity by compression distance (operator 8).

Zstandard dictionaries are made from labelled text. The ordinary one is trained on windows of ordinary documents. The
toxic one puts before it the beginnings of words that toxic documents have and ordinary ones lack: a greedy cover picks
few of them so that every toxic document holds several. A window that compresses better with the toxic dictionary than
with the ordinary one resembles toxic text; as the dictionaries differ by these stretches alone, other windows compress
alike. A second pair differs by stems that ordinary documents also have, but seldom, where toxic documents repeat them.
A document's gains, of its best window, in all, from stems and for its length, are calibrated on labelled documents
that no dictionary has seen. (Zstandard's own trainer chooses by frequency alone and fills a toxic dictionary with
ordinary syllables.)

Edge cases: a null or empty text is one empty window, with no gain; all windows of a very long text are compared; where
one class has no labels every score is the share of toxic labels, 0 without labels; a score of exactly 0.5 is toxic;
repeated rows keep their rows, and of rows that repeat an id the least is learned from; a null id is never learned from
and not held out; other columns are ignored by the scores and kept by the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import by_text, crc_of, map_rows, rows_of, sample_ids, use_checkpoints

#: Bytes in a window and between the starts of windows.
WINDOW, STRIDE = 80, 64
#: Documents of each class for the dictionaries and for the calibration, and ordinary documents whose windows, all of
#: them, the ordinary dictionary is trained on; whole texts are learned from.
FOR_DICTIONARY, FOR_CALIBRATION, FOR_TRAINER = 1000, 500, 250
#: Bytes of text whose windows the trainer of the ordinary dictionary gets at most, on the driver.
TRAINER_BYTES = 32_000_000
DICTIONARY_BYTES, LEVEL = 24_000, 6
#: Lengths of toxic stretches in bytes (the shortest is the compressor's least match), documents that must hold one, its
#: most ordinary share in parts of its toxic one, times a document is covered, and a decoy's least ordinary share.
SHORTEST, LONGEST, HOLDERS, ORDINARY_SHARE, COVERS, DECOY_SHARE = 6, 14, 4, 0.02, 8, 0.001
#: Stems are less rare, at most this share, but toxic documents repeat them; a document is covered by so many.
STEM_SHARE, STEM_COVERS = 0.3, 2
#: Parts the stretches in the dictionary; the zero byte doesn't occur in text.
_APART = b"\0"
FEATURES = 4


def windows(text: str | None) -> list[bytes]:
    """Overlapping stretches of the whole lower-cased text."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    return [data[at : at + WINDOW] for at in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)]


def _parts(word: str, begins: int) -> Iterator[bytes]:
    """The parts of a word between spaces, SHORTEST to LONGEST bytes long, that start at one of its first bytes."""
    data = f" {word} ".encode("utf-8", "surrogatepass")
    for at in range(min(begins, len(data) - SHORTEST + 1)):
        for end in range(at + SHORTEST, min(at + LONGEST, len(data)) + 1):
            yield data[at:end]


def _held(text: str, wanted: set[bytes] | None = None) -> set[bytes]:
    """The beginnings of a text's words; or which of the wanted parts its words have anywhere."""
    words = set(text.lower().split())
    if wanted is None:
        return {p for w in words for p in _parts(w, 1)}
    return {p for w in words for p in _parts(w, len(w) * 4) if p in wanted}


def toxic_stretches(held: list[set[bytes]], counts: dict[bytes, int], common: dict[bytes, int], ordinary: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(stretches, decoys, stems): beginnings of words that part the classes, those of their parts that don't, and
    beginnings that toxic documents have more of.

    ``held`` has the frequent beginnings of each toxic document, ``counts`` the toxic documents of each, ``common`` the
    ordinary documents, of ``ordinary`` in all, that hold a part of them anywhere in a word.

    Stretches, least telling first, are chosen to cover each toxic document COVERS times. Ordinary words share parts
    with them, which the compressor may match; as decoys, these parts go into both dictionaries, so that only what a
    stretch has beyond them tells.
    """
    telling = {s for s in counts if common.get(s, 0) * len(held) <= ORDINARY_SHARE * counts[s] * ordinary}
    chosen = _cover(held, telling, COVERS)
    sure = lambda n: n - 2 * n**0.5
    stems = {s for s in counts if len(s) <= SHORTEST + 2 and common.get(s, 0) * len(held) <= STEM_SHARE * sure(counts[s]) * ordinary}
    shared = {s[i:j] for s in chosen for i in range(len(s) - SHORTEST + 1) for j in range(i + SHORTEST, len(s) + 1) if common.get(s[i:j], 0) > DECOY_SHARE * ordinary}
    return chosen, sorted(p for p in shared if not any(p != q and p in q for q in shared)), _cover(held, stems, STEM_COVERS)


def _cover(held: list[set[bytes]], telling: set[bytes], covers: int) -> list[bytes]:
    """Few of the telling stretches, such that each document that can holds ``covers`` of them; least telling first."""
    holders: dict[bytes, set[int]] = {}
    for k, d in enumerate(held):
        for s in d & telling:
            holders.setdefault(s, set()).add(k)
    covered = [0] * len(held)
    chosen: list[bytes] = []
    while holders:
        best = max(holders, key=lambda s: (len(holders[s]), len(s), s))
        if len(holders[best]) < HOLDERS:
            break
        chosen.append(best)
        for k in holders.pop(best):
            covered[k] += 1
        full = {k for k, n in enumerate(covered) if n >= covers}
        # A part of a chosen stretch tells nothing new.
        holders = {s: left for s, h in holders.items() if s not in best and (left := h - full)}
    return chosen[::-1]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    stemless: bytes
    stems: bytes
    weights: tuple[float, ...]

    def gains(self, texts: list[str | None]) -> np.ndarray:
        """By text: the best window's gain in bytes, the logarithm of all windows' gains, likewise from the stems, and, where there is any, that of the number of windows."""
        plain, marked, bare, stemmed = map(_compressor, (self.ordinary, self.toxic, self.stemless, self.stems))
        out = np.zeros((len(texts), FEATURES))
        for k, text in enumerate(texts):
            parts = windows(text)
            if not self.toxic or not parts[0]:
                continue
            gain = np.maximum(_sizes(plain, parts) - _sizes(marked, parts), 0)
            more = np.maximum(_sizes(bare, parts) - _sizes(stemmed, parts), 0) if self.stems != self.stemless else gain
            if gain.any() or more.any():
                out[k] = gain.max(), np.log1p(gain.sum()), np.log1p(more.sum()), np.log1p(len(parts))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _logistic(self.weights[0] + self.gains(texts) @ np.array(self.weights[1:]))


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), min_match=SHORTEST, hash_log=16, chain_log=16,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


def _sizes(compressor: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    out: list[int] = []
    for at in range(0, len(parts), 4096):
        made = compressor.multi_compress_to_buffer(parts[at : at + 4096])
        out += [len(made[k]) for k in range(len(made))]
    return np.array(out)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrate(gains: np.ndarray, labels: np.ndarray, toxic_share: float, steps: int = 100) -> tuple[float, ...]:
    """Logistic regression of the labels on the gains by Newton steps, with the classes weighted to their true shares."""
    x = np.column_stack([np.ones(len(gains)), gains])
    share = np.where(labels == 1, toxic_share / max(1, (labels == 1).sum()), (1 - toxic_share) / max(1, (labels == 0).sum())) * len(labels)
    w, ridge = np.zeros(1 + FEATURES), np.diag([1e-6] + [0.05] * FEATURES)
    for _ in range(steps):
        p = _logistic(x @ w)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(1 + FEATURES)
        step = np.linalg.solve(curve, x.T @ (share * (labels - p)) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
    return tuple(float(v) for v in w)


def learn(texts: DataFrame, order: list[list[int]], toxic_share: float) -> Model:
    """Dictionaries from the first FOR_DICTIONARY texts of each class, calibration from the rest (or all, if few).

    ``texts`` has (i, t), whole texts by id; ``order`` the ids of toxic and of ordinary ones. Words, windows and gains
    are made on executors; the driver gets frequent beginnings, the trainer's windows and the gains.
    """
    toxic, ordinary = order
    if not toxic or not ordinary:
        share = min(max(toxic_share, 1e-9), 1 - 1e-9)
        return Model(b"", b"", b"", b"", (float(np.log(share / (1 - share))) if toxic or ordinary else -60.0, *[0.0] * FEATURES))
    at = [max(1, len(c) * FOR_DICTIONARY // (FOR_DICTIONARY + FOR_CALIBRATION)) for c in order]
    first = [c[:n] for c, n in zip(order, at)]
    held, counts = _frequent(texts, first[0])
    common = _common(texts, first[1], {s[i:j] for s in counts for i in range(len(s) - SHORTEST + 1) for j in range(i + SHORTEST, len(s) + 1)})
    stretches, decoys, stems = toxic_stretches(held, counts, common, len(first[1]))
    joined = lambda parts: b"".join(p + _APART for p in parts)
    trained = _trained(_windows_of(texts, _within(texts, first[1][:FOR_TRAINER], TRAINER_BYTES)))
    plain, bare = joined(decoys) + trained, _without(trained, stems)
    model = Model(plain, joined(stretches) + plain, bare, joined(stems) + bare, (0.0,) * (1 + FEATURES))
    rest = [(toxic[at[0] :] or toxic, 1), (ordinary[at[1] :] or ordinary, 0)]
    labels = np.concatenate([np.full(len(c), y) for c, y in rest])
    return replace(model, weights=calibrate(_gains(texts, rest[0][0] + rest[1][0], model), labels, toxic_share))


def _of(texts: DataFrame, ids: list[int]) -> DataFrame:
    return texts.filter(F.col("i").isin([int(i) for i in ids]))


def _frequent(texts: DataFrame, ids: list[int]) -> tuple[list[set[bytes]], dict[bytes, int]]:
    """The beginnings of words that at least HOLDERS of these documents have: by document, and their documents' number."""

    def rows(columns: list[list]) -> Iterator[tuple]:
        for i, text in zip(*columns):
            for s in _held(text):
                yield i, s

    found = map_rows(_of(texts, ids), rows, "i long, s binary", batch=16)
    often = found.groupBy("s").agg(F.collect_list("i").alias("ids")).filter(F.size("ids") >= HOLDERS)
    held: dict[int, set[bytes]] = {i: set() for i in ids}
    counts = {}
    for r in often.toLocalIterator():
        s = bytes(r["s"])
        counts[s] = len(r["ids"])
        for i in r["ids"]:
            held[i].add(s)
    return [held[i] for i in ids], counts


def _common(texts: DataFrame, ids: list[int], parts: set[bytes]) -> dict[bytes, int]:
    """How many of these documents hold each of the parts anywhere in a word; parts of none are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(parts)

    def rows(columns: list[list]) -> Iterator[tuple]:
        found = Counter(s for text in columns[1] for s in _held(text, shared.value))
        yield from found.items()

    counted = map_rows(_of(texts, ids), rows, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {bytes(r["s"]): r["n"] for r in counted.toLocalIterator()}


def _within(texts: DataFrame, ids: list[int], most: int) -> list[int]:
    """Of these documents, in turn, those whose texts together have at most ``most`` bytes; one that is too long is passed over."""
    sizes = {r["i"]: r["n"] for r in _of(texts, ids).select("i", F.octet_length("t").alias("n")).collect()}
    kept, total = [], 0
    for i in ids:
        if total + sizes[i] <= most:
            kept.append(i)
            total += sizes[i]
    return kept


def _windows_of(texts: DataFrame, ids: list[int]) -> list[bytes]:
    """All windows of these documents, in this order."""

    def rows(columns: list[list]) -> Iterator[tuple]:
        for i, text in zip(*columns):
            yield i, windows(text) if text else []

    made = {r["i"]: r["w"] for r in map_rows(_of(texts, ids), rows, "i long, w array<binary>", batch=16).collect()}
    return [bytes(w) for i in ids for w in made[i]]


def _gains(texts: DataFrame, ids: list[int], model: Model) -> np.ndarray:
    """The gains of these documents, in this order."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def rows(columns: list[list]) -> Iterator[tuple]:
        for i, gains in zip(columns[0], shared.value.gains(columns[1])):
            yield i, gains.tolist()

    found = {r["i"]: r["g"] for r in map_rows(_of(texts, ids), rows, "i long, g array<double>").collect()}
    return np.array([found[i] for i in ids])


def _without(content: bytes, stretches: list[bytes]) -> bytes:
    """The content with every shortest part of the stretches parted by a zero byte."""
    for s in stretches:
        for at in range(len(s) - SHORTEST + 1):
            part = s[at : at + SHORTEST]
            content = content.replace(part, part[: SHORTEST // 2] + _APART + part[SHORTEST // 2 + 1 :])
    return content


def _trained(samples: list[bytes]) -> bytes:
    """The ordinary dictionary's content; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-DICTIONARY_BYTES:] or b" ").ljust(8)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the whole texts of a bounded number of labelled documents."""
    counts = {r[0]: r[1] for r in labels.dropna(subset=[label_col]).groupBy(label_col).count().collect()}
    picked = sample_ids(labels, id_col, label_col, FOR_DICTIONARY + FOR_CALIBRATION)
    use_checkpoints(docs.sparkSession)
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = rows_of(docs.select(F.col(id_col).alias("i"), whole.alias("t")), "i", list(picked), "t")
    parts = 2 * docs.sparkSession.sparkContext.defaultParallelism
    texts = found.select(F.col("id").cast("long").alias("i"), "t").repartition(parts, "i").checkpoint()
    there = {r["i"] for r in texts.select("i").collect()}
    order = [[i for i in picked if i in there and int(picked[i]) == y] for y in (1, 0)]
    return learn(texts, order, counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(columns: list[list]) -> Iterator[tuple]:
        doc_ids, texts = columns
        for doc_id, value in zip(doc_ids, shared.value.scores(texts)):
            yield doc_id, float(value)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), learning from the labels that are not held out."""
    model = train(docs, labels.filter(F.pmod(crc_of(id_col), F.lit(fold)) != held), id_col, text_col)
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(fold)) == held, F.lit(False))
    return score(docs, model, id_col, text_col).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below 0.5, in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    ordinary = by_text(lambda texts: shared.value.scores(texts) < 0.5, "boolean")
    return docs.filter(ordinary(F.col(text_col).cast("string")))
