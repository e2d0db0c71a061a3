"""Language identification by string kernels (operator 1).

The kernel of two texts is the number of character n-grams, of all lengths up to MAX_GRAM together, that occur in both,
over the geometric mean of their own numbers. Nystrom landmarks span an approximation of its feature space, in which
one-versus-rest kernel ridge regression learns the languages. As the kernel is linear in the presence vector of the
n-grams, landmarks and regression weights multiply out to one matrix, and a block of texts is scored by one product of
its presence matrix with it.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0, as do all texts where nothing can be
learned; a very long text is hashed whole, in chunks; of languages with equal scores the first by name is taken;
repeated rows keep their rows, and of rows that repeat an id only the least is learned from; a null id is never learned
from and not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import crc_of, map_rows, rows_of, sample_ids

MAX_GRAM, DIMENSIONS = 4, 1 << 16
#: Documents of each language to learn from, landmarks of each language, and the ridge of the regression.
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 48, 1e-3
#: Documents and landmarks of all languages together: with more than 25 or 20 languages each has a smaller part.
MOST_DOCUMENTS, MOST_LANDMARKS = 7500, 960
#: Characters of the short stretch of each document that is learned beside the whole.
STRETCH = 80
#: Characters hashed at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Unicode's letters; numbers such as a half or a circled one are none.
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams occur in a text, as bytes of 0 and 1."""
    found = np.zeros(DIMENSIONS, dtype=np.uint8)
    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    for at in range(0, max(1, len(text) - MAX_GRAM + 1), CHUNK):
        part = text[at : at + CHUNK + MAX_GRAM - 1].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, dtype="<u4").astype(np.uint64) + np.uint64(1)
        gram = codes
        for n in range(1, MAX_GRAM + 1):
            if n > 1:
                gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            found[((gram + np.uint64(n)) * _MIX) >> shift] = 1
    return found


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    sharpness: float

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [bool(self.languages) and t is not None and _LETTER.search(t) is not None for t in texts]
        out = [(UNKNOWN, 0.0)] * len(texts)
        rows = [k for k, ok in enumerate(known) if ok]
        for at in range(0, len(rows), 64):
            block = rows[at : at + 64]
            scores = self.scores(np.stack([presence(texts[k]) for k in block]))
            chances = _softmax(scores * self.sharpness)
            for k, best, chance in zip(block, scores.argmax(axis=1), chances.max(axis=1)):
                out[k] = (self.languages[best], float(min(1.0, chance)))
        return out

    def scores(self, found: np.ndarray) -> np.ndarray:
        found = found.astype(np.float32)
        return (found @ self.weights) / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def fit(found: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from presence vectors packed to bits (one row for each text) and the texts' languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((DIMENSIONS, 0), dtype=np.float32), 1.0)
    of = np.array([names.index(x) for x in languages])
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(names))])
    unit = np.unpackbits(found[chosen], axis=1).astype(np.float32)
    unit /= np.sqrt(np.maximum(unit.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((unit @ unit.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    rows = []
    for at in range(0, len(found), 128):
        block = np.unpackbits(found[at : at + 128], axis=1).astype(np.float32)
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
        rows.append((block @ unit.T) @ to_features)
    features = np.concatenate(rows)
    targets = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * len(of) * np.eye(features.shape[1]), features.T @ targets)
    weights = unit.T @ (to_features @ solved).astype(np.float32)
    scores, tried = features @ solved, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    fits = [float(np.log(np.maximum(_softmax(scores * t)[np.arange(len(of)), of], 1e-9)).mean()) for t in tried]
    return Model(names, weights, tried[int(np.argmax(fits))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` rows of each language; executors send packed presence bits only."""
    picked = sample_ids(docs, id_col, lang_col, per_language)
    share = max(1, MOST_DOCUMENTS // max(1, len(set(picked.values()))))
    ids = [i for name in sorted(set(picked.values()), key=str) for i in [k for k, v in picked.items() if v == name][:share]]
    chosen = rows_of(docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), id_col, ids, text_col, lang_col)

    def rows(columns: list[list]) -> Iterator[tuple]:
        for doc_id, text, lang in zip(*columns):
            start = doc_id * 2654435761 % max(1, len(text) - STRETCH)
            for part in (text, text[start : start + STRETCH]):
                yield doc_id, lang, np.packbits(presence(part)).tobytes()

    found = map_rows(chosen.select("id", F.col(text_col).alias("t"), F.col(lang_col).alias("l")), rows, "id long, lang string, bits binary").collect()
    found.sort(key=lambda r: (r["id"], r["bits"]))
    bits = np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in found]).reshape(len(found), DIMENSIONS // 8)
    return fit(bits, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(columns: list[list]) -> Iterator[tuple]:
        doc_ids, texts = columns
        for doc_id, (lang, score) in zip(doc_ids, shared.value.predict(texts)):
            yield doc_id, lang, score

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learning from the documents that are not held out."""
    model = train(docs.filter(F.pmod(crc_of(id_col), F.lit(fold)) != held), id_col, text_col, lang_col)
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(fold)) == held, F.lit(False))
    return predict(docs, model, id_col, text_col).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
