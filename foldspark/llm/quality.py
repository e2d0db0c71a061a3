"""Quality classification by ordinal cumulative-link regression on graded ratings (operator 3).

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text features is shared by all grades, and
ordered thresholds part them. It gives the expected grade and the probability of a grade's tail, by which documents are
selected. The features are hashed words, word shapes and shape pairs of the whole text, and hashed bands of its
repetition, case, length and symbol rates.

Edge cases: a null or empty text has the features of an empty text and is scored like any other; a very long text is
read whole; without ratings, or with a single grade, every tail probability is 1; a probability that equals the limit
keeps its document; repeated rows keep their rows, and of rows that repeat an id the least is learned from; a null id is
never learned from; other columns are kept by the filter and ignored by the scores; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import by_text, map_rows, rows_of, sample_ids

DIMENSIONS = 1 << 12
#: Rated documents of each grade to learn from.
PER_GRADE = 1000
STEPS, RATE, SHRINK = 150, 0.1, 1e-4
#: A document is kept if the probability of at least this grade reaches this chance.
GOOD_GRADE, KEEP_CHANCE = 1, 0.5
_SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[0-9]+"), "9")]


def _band(value: float, cuts: tuple[float, ...]) -> int:
    return sum(value >= c for c in cuts)


def features(text: str | None) -> Counter:
    """Values of hashed features by their number."""
    words = (text or "").split()
    counts = Counter(words)
    total = max(1, len(words))
    shape = " ".join(words)
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    shapes = shape.split(" ")
    made: Counter = Counter()

    def add(kind: str, name: str, weight: float) -> None:
        made[zlib.crc32(f"{kind} {name}".encode("utf-8", "surrogatepass")) % DIMENSIONS] += weight

    for name, n in Counter(shapes).items():
        add("shape", name, (n / total) ** 0.5)
    for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
        add("pair", f"{a} {b}", (n / total) ** 0.5)
    for word, n in counts.items():
        made[zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS] += 0.5 * (n / total) ** 0.5
    size = max(1, len(text or ""))
    upper, lower = (sum(map(len, pattern.findall(text or ""))) for pattern, _ in _SHAPES[:2])
    upper, plain = upper / size, (upper + lower) / size
    tenths = tuple(k / 10 for k in range(1, 10))
    add("distinct", str(_band(len(counts) / total, tenths)), 1.0)
    add("top", str(_band(max(counts.values(), default=0) / total, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7))), 1.0)
    add("upper", str(_band(upper, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7))), 1.0)
    add("plain", str(_band(plain, (0.3, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9))), 1.0)
    add("words", str(_band(total, (2, 5, 10, 20, 50, 100, 1000))), 1.0)
    add("width", str(_band(size / total, (3, 4, 5, 6, 7, 8, 10, 15, 30))), 1.0)
    lines = (text or "").split("\n")
    add("lines", str(_band(1 - len(set(lines)) / len(lines), tenths)), 1.0)
    return made


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) by row, for each grade g but the least."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def score(self, found: Counter) -> float:
        return float(sum(self.weights[k] * v for k, v in found.items()))


def fit(rows: np.ndarray, grades: np.ndarray) -> Model:
    """Maximise the likelihood of the grades, each grade weighing as much as any other, by Adam steps."""
    levels = sorted(set(grades.tolist()))
    steps = len(levels) - 1
    if steps < 1:
        return Model(levels, np.zeros(rows.shape[1] if rows.ndim == 2 else DIMENSIONS), np.zeros(0))
    y = np.searchsorted(levels, grades)
    share = (1 / np.bincount(y))[y] / len(levels)
    # gaps[0] is the first threshold, exp(gaps[k]) the distance to the next, so that they stay in order.
    state = np.zeros(rows.shape[1] + steps)
    mean, spread = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, STEPS + 1):
        w, gaps = state[:-steps], state[-steps:]
        cuts = np.concatenate([[-np.inf], gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))]), [np.inf]])
        z = rows @ w.astype(np.float32)
        high, low = _logistic(cuts[y + 1] - z), _logistic(cuts[y] - z)
        chance = np.maximum(high - low, 1e-12)
        by_high, by_low = high * (1 - high) / chance, low * (1 - low) / chance
        slope = share * (by_high - by_low)
        cut_slope = np.array([(share * by_low)[y == k + 1].sum() - (share * by_high)[y == k].sum() for k in range(steps)])
        gap_slope = np.concatenate([[cut_slope.sum()], [cut_slope[k:].sum() * np.exp(gaps[k]) for k in range(1, steps)]])
        slopes = np.concatenate([rows.T @ slope.astype(np.float32) + SHRINK * w, gap_slope])
        mean, spread = 0.9 * mean + 0.1 * slopes, 0.999 * spread + 0.001 * slopes**2
        state = state - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
    gaps = state[-steps:]
    return Model(levels, state[:-steps], gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", per_grade: int = PER_GRADE) -> Model:
    """Learn from at most ``per_grade`` documents of each grade; executors send their hashed features only."""
    picked = sample_ids(ratings, id_col, grade_col, per_grade)
    chosen = rows_of(docs, id_col, list(picked), text_col)

    def rows(columns: list[list]) -> Iterator[tuple]:
        for doc_id, text in zip(*columns):
            found = features(text)
            yield doc_id, list(found), [float(v) for v in found.values()]

    got = map_rows(chosen.select("id", F.col(text_col).cast("string").alias("t")), rows, "id long, keys array<int>, weights array<float>").collect()
    got.sort(key=lambda r: r["id"])
    dense = np.zeros((len(got), DIMENSIONS), dtype=np.float32)
    for k, r in enumerate(got):
        dense[k, r["keys"]] = r["weights"]
    return fit(dense, np.array([picked[r["id"]] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model, good_grade: int = GOOD_GRADE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with expected_grade and tail_chance, the probability of ``good_grade`` or better."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    step = sum(g < good_grade for g in model.grades)

    def rows(columns: list[list]) -> Iterator[tuple]:
        made = shared.value
        doc_ids, texts = columns
        tails = made.tails(np.array([made.score(features(t)) for t in texts], dtype=np.float64))
        rise = np.diff(np.array(made.grades, dtype=np.float64))
        for k, doc_id in enumerate(doc_ids):
            expected = float(made.grades[0] + tails[k] @ rise) if made.grades else None
            yield doc_id, expected, float(tails[k][step - 1]) if 0 < step <= tails.shape[1] else 1.0

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, expected_grade double, tail_chance double")


def grade(docs: DataFrame, ratings: DataFrame, keep_chance: float = KEEP_CHANCE, **names) -> DataFrame:
    """(doc_id, expected_grade, tail_chance, kept) of each document, learning from its rated ones."""
    return score(docs, train(docs, ratings, **names)).withColumn("kept", F.col("tail_chance") >= keep_chance)


def keep_good(docs: DataFrame, ratings: DataFrame, keep_chance: float = KEEP_CHANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability reaches ``keep_chance``, in one pass over them."""
    model = train(docs, ratings, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    step = sum(g < GOOD_GRADE for g in model.grades)

    def good(texts: list[str | None]) -> np.ndarray:
        made = shared.value
        tails = made.tails(np.array([made.score(features(t)) for t in texts], dtype=np.float64))
        return tails[:, step - 1] >= keep_chance if 0 < step <= tails.shape[1] else np.ones(len(texts), dtype=bool)

    return docs.filter(by_text(good, "boolean")(F.col(text_col).cast("string")))
