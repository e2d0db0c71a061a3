"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldspark.llm import (
    byte_bpe, collocations, embedding_dedup, fill_in_middle, fingerprints, language_id, packing, pii, quality, secrets, simhash_dedup,
    token_counts, toxicity,
)

CLASH = "id score spans base ids piece start length part copy mix sequence_id offset mark node root component_id fingerprint range coarse fine sub guest order held_out predicted kept simhash expected_grade tail_chance lang_pred ids_crc32 decoded _id _mark _row class label".split()
LONG = ("Lorem ipsum dolor sit amet a1b2c3 x@y.zz 12.3.4.5 " * 22_000) + "x" * 100_000
TEXTS = [None, "", " ", "one two three four five six", "one two three four five six", LONG, "password=hunter2222 and mail a@b.cc", "!?"]
IDS = [None, None, 3, 3, 3, 4, 5, 6]


def make(spark, empty=False):
    rows = [(k, t, None if n % 3 == 0 else "en", "s", None, *["clash"] * len(CLASH)) for n, (k, t) in enumerate(zip(IDS, TEXTS))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([] if empty else rows, schema)


def tables(spark, empty=False):
    labels = [(3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (6, 0, 0), (6, 0, 0)]
    return spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int")


def word_bpe():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def byte_ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


OPERATORS = {
    "op1": lambda d, y: language_id.identify(d),
    "op2": lambda d, y: pii.digest(pii.find(d)),
    "op3": lambda d, y: quality.grade(d, y),
    "op4": lambda d, y: pii.digest(secrets.find(d), secrets.KINDS),
    "op5": lambda d, y: packing.pack_documents(d, word_bpe()),
    "op6": lambda d, y: byte_bpe.round_trip(d, byte_ranks(), public_tokenizers.PATTERN),
    "op7": lambda d, y: fingerprints.compare_with_next(d),
    "op8": lambda d, y: toxicity.classify(d, y),
    "op10": lambda d, y: simhash_dedup.near_duplicates(d),
    "op11": lambda d, y: token_counts.count_tokens(d, word_bpe()),
    "op13": lambda d, y: fill_in_middle.digest(fill_in_middle.rearrange(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_keeps_every_row(spark, name):
    rows = OPERATORS[name](make(spark), tables(spark)).collect()
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None and ("piece" not in rows[0] or r["piece"] == 0)), key=int)
    assert ids == sorted(k for k in IDS if k is not None)
    assert sum(r["doc_id"] is None for r in rows) == 2
    same = [tuple(r) for r in rows if r["doc_id"] == 3]
    if name not in ("op5", "op7"):  # a place in a sequence and the next document differ between equal rows
        assert len(same) == 3 and len(set(same)) <= 2
    empty = OPERATORS[name](make(spark, empty=True), tables(spark, empty=True))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](make(spark), tables(spark)).columns


def test_collocations_of_odd_documents(spark):
    rows = [tuple(r) for r in collocations.collocations(make(spark)).select("lang", "phrase", "a", "n").collect()]
    assert {r[0] for r in rows} <= {"en", "und"} and ("en", "lorem ipsum dolor sit", 22_000) in {r[:3] for r in rows}
    assert collocations.collocations(make(spark, empty=True)).count() == 0


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (3, None, "x"), (4, [0.05] * 20_000, "x"), (5, [0.05] * 20_000, "x")]
    names = "k1 k2 node copies vector links root component n c table_no bucket block".split()
    made = spark.createDataFrame([(k, v, *[s] * len(names)) for k, v, s in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in names))
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(made).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 4, False), ("None", 0, None, False)]


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_odd_documents(spark, tmp_path, k):
    for empty in (False, True):
        folder = str(tmp_path / f"{empty}")
        tables(spark, empty).write.parquet(f"{folder}/labels.parquet")
        made = corpus_pipeline.STAGES[k][1](spark, make(spark, empty), folder)
        if k < 4:
            assert made.columns == list(corpus_pipeline.COLUMNS)
        rows = made.collect()
        assert empty == (not rows) or k < 2
        if k == 2 and not empty:
            kept = sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
            # Null and blank texts are one group, whose least id is 3.
            assert [x for x in kept if x[1] is None or not x[1].strip()] == [(3, " ")] and len(kept) == 5
        if k == 3 and not empty:
            texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] == 5}
            assert texts == {5: "[SECRET] and mail a@b.cc"} and len(rows) == len(TEXTS)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    make(spark, empty=True).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, empty=True).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# Plain versions of the models.


def test_language_model_is_dual_kernel_ridge_regression():
    rng = np.random.default_rng(0)
    words = {"a": ["the", "and", "of", "river"], "b": ["der", "und", "von", "fluss"], "c": ["que", "los", "rio", "una"]}
    texts = [(lang, " ".join(rng.choice(w, 12))) for lang, w in words.items() for _ in range(14)]
    bits = np.array([np.packbits(language_id.presence(t)) for _, t in texts])
    model = language_id.fit(bits, [lang for lang, _ in texts], landmarks=14, ridge=1e-2)
    grams = [set(np.flatnonzero(language_id.presence(t)).tolist()) for _, t in texts]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in grams] for x in grams])
    # With every text a landmark the Nystrom features are exact, so the dual solution is the same.
    targets = np.where(np.array([lang for lang, _ in texts])[:, None] == np.array(model.languages), 1.0, -1.0)
    dual = kernel @ np.linalg.solve(kernel + 1e-2 * len(texts) * np.eye(len(texts)), targets)
    got = model.scores(np.array([language_id.presence(t) for _, t in texts]))
    assert np.allclose(got, dual, atol=1e-2)


def test_quality_fit_is_near_the_greatest_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = np.digitize(x @ np.array([1.0, -0.5, 0.0]) + rng.logistic(size=400), [-0.5, 0.8])
    made = quality.fit(x, y)
    share = (1 / np.bincount(y))[y] / 3

    def loss(w, cuts):
        edges = np.concatenate([[-60.0], cuts, [60.0]])
        z = x @ w
        return -(share * np.log(1 / (1 + np.exp(z - edges[y + 1])) - 1 / (1 + np.exp(z - edges[y])))).sum() + 0.5 * quality.SHRINK * w @ w

    best = loss(made.weights, made.thresholds)
    for _ in range(300):  # no step nearby is better by more than a trifle
        w, cuts = made.weights + rng.normal(scale=0.05, size=3), np.sort(made.thresholds + rng.normal(scale=0.05, size=2))
        assert loss(w, cuts) > best - 1e-3


def test_toxicity_scores_equal_compressing_each_window_alone(spark):
    import zstandard

    rng = np.random.default_rng(5)
    words = ["river", "market", "window", "garden", "letter", "number", "silver", "winter"]
    rows = [(k, " ".join(rng.choice(words, 60)) + (" vileinsultish" * 3 if k % 2 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int"))

    def size(content, window):
        settings = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, source_size=toxicity.WINDOW, dict_size=len(content), min_match=toxicity.SHORTEST, hash_log=16, chain_log=16, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress(window))

    for _, text in rows[:6]:
        parts = toxicity.windows(text)
        gain = [max(0, size(model.ordinary, p) - size(model.toxic, p)) for p in parts]
        more = [max(0, size(model.stemless, p) - size(model.stems, p)) for p in parts] if model.stems != model.stemless else gain
        told = [max(gain), np.log1p(sum(gain)), np.log1p(sum(more)), np.log1p(len(parts))] if any(gain) or any(more) else [0.0] * 4
        assert np.allclose(model.gains([text])[0], told)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + np.dot(told, model.weights[1:])))))


# What the random fields add, on generated texts of other seeds than those they learned from.


def judged(found, truth):
    hits = len(found & truth)
    return hits / max(1, len(truth)), hits / max(1, len(found))


def test_added_personal_data_is_right(monkeypatch):
    weights = pii.train()
    monkeypatch.setattr(pii.random, "Random", lambda seed, make=pii.random.Random: make(seed + 100))
    found, truth = set(), set()
    for k, (text, spans) in enumerate(pii._generated(400)):
        base, every = pii.all_spans(text, weights)
        covered = {s for s in spans if any(b < s[2] and s[1] < e for _, b, e in base)}
        truth |= {(k, *s) for s in spans - covered}
        found |= {(k, *s) for s in every if s not in base}
    recall, precision = judged(found, truth)
    print("added personal data", len(truth), recall, precision)
    assert len(truth) > 30 and recall > 0.7 and precision > 0.7


def test_added_secrets_are_right(monkeypatch):
    chain = secrets.train()
    monkeypatch.setattr(secrets.random, "Random", lambda seed, make=secrets.random.Random: make(seed + 100))
    found, truth = set(), set()
    for k, (text, spans) in enumerate([*secrets._generated(300), *secrets._announced_lines(300)]):
        base, every = secrets.all_spans(text, chain)
        truth |= {(k, *s) for s in spans if not any(b < s[1] and s[0] < e for _, b, e in base)}
        found |= {(k, b, e) for kind, b, e in every if kind == secrets.ADDED}
    recall, precision = judged(found, truth)
    print("added secrets", len(truth), recall, precision)
    assert len(truth) > 100 and recall > 0.7 and precision > 0.7
