"""Whole texts and whole groups: what no cut of a text or of rows may change."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import common, fingerprints, language_id, pii, quality, secrets, simhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_learns_what_lies_late_in_a_text(spark):
    rng = np.random.default_rng(5)
    words = ["river", "market", "window", "garden", "letter", "number", "silver", "winter", "people", "travel"]
    plain = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, plain(4000) + (" vileinsultish gruesomeslurry" * 3 if k % 2 else ""), None, None, None) for k in range(60)]
    assert min(len(r[1]) for r in rows) > 20_000
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert b" vilei" in model.toxic or b" grues" in model.toxic
    late, clean = model.scores([plain(9000) + " vileinsultish gruesomeslurry" * 3, plain(9000)])
    assert late > 0.5 > clean


def test_near_dedup_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = np.random.default_rng(3)
    text = [" ".join(rng.choice(["red", "blue", "green", "sun", "moon", "tree", "sea"], 80)) for _ in range(7)]
    a, b, c, d, e, f, g = text
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, e), (None, e), (9, f), (8, f), (8, f), (None, None), (None, ""), (3, g)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (5, c), (5, d), (7, e), (8, f), (None, None), (3, g)], key=str)
    marks = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert marks[None, f"{simhash_dedup.fingerprint(e):016x}"] == 7 and marks[None, f"{simhash_dedup.fingerprint(a):016x}"] is None


def test_a_null_id_links_two_documents_by_its_text(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "with_fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "n_chars AS simhash"))
    docs = spark.createDataFrame([(1, "", None, None, 0b0), (None, "", None, None, 0b11), (2, "", None, None, 0b1111)], DOCS)
    assert {r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()} == {1}


@pytest.mark.parametrize(("text", "secret"), [
    ("pwd: Xk29fj2a", "Xk29fj2a"), ("Authorization: Bearer abcdefghijklmnop", "abcdefghijklmnop"), ("pass = 4829173650 end", "4829173650"), ("pwd=\"P@ssw0rd!x9\"", "P@ssw0rd!x9"), ("the db_pass: qZ7!k2@Lm9 was set", "qZ7!k2@Lm9"),
])
def test_announced_secrets_need_no_length_or_mixture(text, secret):
    assert secrets.redacted(text, secrets.train()) == text.replace(secret, secrets.REDACTED)


@pytest.mark.parametrize("text", ["the key features of the private companies", "A boarding pass through security, the author decided", "They passed another national question in 1999."])
def test_announcing_words_in_prose_hide_nothing(text):
    assert secrets.redacted(text, secrets.train()) == text


@pytest.mark.parametrize("fan", [64, 2])
def test_next_documents_whatever_the_ids(spark, monkeypatch, fan):
    monkeypatch.setattr(fingerprints, "FAN", fan)  # with 2, most ranges have bounds of their own
    rng = np.random.default_rng(4)
    ids = [*map(int, rng.permutation(300) * 7 - 500), *[77] * 120, *[None] * 90, *[5] * 3]
    rows = [(k, " ".join(rng.choice(["red", "blue", "green", "sun"], 6)) + f" {n // 2}") for n, k in enumerate(ids)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)
    made = fingerprints._with_ranges(docs.select("doc_id", "text"), 16).collect()
    by_range = {}
    for r in made:
        by_range.setdefault((-r["coarse"], -r["fine"], r["sub"]), []).append(r)
    key = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["order"], r["text"])
    own = [sorted((r for r in by_range[k] if not r["guest"]), key=key) for k in sorted(by_range)]
    flat = [r for part in own for r in part]
    assert sorted((r["doc_id"], r["text"]) for r in flat if r["doc_id"] is not None) == sorted(r for r in rows if r[0] is not None)
    assert len(flat) == len(rows) and flat == sorted(flat, key=key)
    for k, part in zip(sorted(by_range), range(len(own))):
        guests = sorted((r for r in by_range[k] if r["guest"]), key=key)
        assert (guests[0]["doc_id"], guests[0]["text"]) == (own[(part + 1) % len(own)][0]["doc_id"], own[(part + 1) % len(own)][0]["text"])
    assert max(map(len, own)) <= 64


def test_fingerprint_bits_equal_a_plain_version(spark):
    texts = ["", "one two", "a b c d e f g h", " ".join(f"w{k % 50}" for k in range(900)), "x " * 40, "É y Z q w e r t"]
    made = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    hashed = made.selectExpr("k", "transform(filter(split(lower(text), '\\\\s+'), w -> w <> ''), w -> xxhash64(w)) AS words")
    shingles = hashed.selectExpr("k", "words", "transform(sequence(1, greatest(size(words) - 4, 1)), i -> xxhash64(slice(words, i, 5))) AS h").collect()
    got = {r["k"]: r["f"] for r in made.select("k", fingerprints.fingerprint(made["text"]).alias("f")).collect()}
    order = fingerprints.probe_order(fingerprints.BINS)
    for r in shingles:
        if not r["words"]:
            assert got[r["k"]] == "0" * 256
            continue
        bins = {}
        for h in r["h"]:
            bins.setdefault((h % 2**64) >> 57, []).append(h)
        least = {b: min(hs) for b, hs in bins.items()}
        full = [least[b] if b in least else least[next(int(p) for p in order[b] if int(p) in least)] for b in range(fingerprints.BINS)]
        assert got[r["k"]] == "".join(f"{h % 256:02x}" for h in full)


def whole_decoding(text, chain):
    """The spans of tagging all tokens of the text as one chain."""
    base, added = secrets.base_spans(text), []
    tokens = list(secrets._TOKEN.finditer(text))
    tags = chain.decode(secrets._stretch(tokens, secrets.file_features(text))) if tokens else []
    for k, tag in enumerate(tags):
        if tag == secrets.BEGIN:
            last = k
            while last + 1 < len(tags) and tags[last + 1] == secrets.INSIDE:
                last += 1
            begin, end = tokens[k].start(), tokens[last].end()
            if all(end <= b or e <= begin for _, b, e in base):
                added.append((secrets.ADDED, begin, end))
    return secrets.in_order(base + added)


def test_stretches_give_the_tags_of_the_whole_text():
    chain, rng = secrets.train(), np.random.default_rng(1)
    parts = ["password", "x" * 150, "is", "a1b2c3d4e5f6a7B8zz", "end", "=", ":", "!", "ghp_abcDEF123456789", "key", "Bearer", "é", "日本", "\n", "  ", "foo-bar1", "12345678", "Xk29fj2a", "a", "@", "sk_", '"', "P@ss", "authority", "pwd:", "the"]
    texts = ["password" + "x" * 150 + " is a1b2c3d4e5f6a7B8zz end"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.integers(1, 40))) for _ in range(1500)]
    for text in texts:
        assert secrets.all_spans(text, chain)[1] == whole_decoding(text, chain), text


def test_long_words_and_many_spans_take_linear_time():
    import time

    start = time.process_time()
    chain, weights = secrets.train(), pii.train()
    trained = time.process_time() - start
    mails = " ".join(f"a{k}@b{k}.com" for k in range(100_000))
    for text in ("x" * 5_000_000 + " 1", "x" * 5_000_000 + "1", "key" * 1_000_000):
        assert pii.all_spans(text, weights)[0] == [] and secrets.all_spans(text, chain)[0] == []
    assert len(pii.all_spans(mails, weights)[1]) == 100_000
    assert len(secrets.all_spans("token=" + mails, chain)[0]) == 0
    assert time.process_time() - start - trained < 120


def test_a_card_written_digit_by_digit_is_one_segment():
    text = " ".join("4111111111111111")
    assert ("card", 0, 31) in pii.all_spans(text, pii.train())[1]
    bounds, found = pii.candidates(text)
    assert any(kind == "card" and j - i == 31 for i, j, kind, _ in found)


def test_shapes_are_whole():
    long = "a1" * 20
    assert quality.features(long + "b") != quality.features(long + "2b")


def test_blocks_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["x" * 10, None, "y" * 300, "z" * 50, "z" * 50, "z" * 50, ""]})
    sizes = [b.num_rows for b in common.blocks_of(batch, 3, 110)]
    assert sizes == [2, 1, 2, 2] and sum(sizes) == 7
    assert [b.num_rows for b in common.blocks_of(batch.slice(2), 100, 10**9)] == [5]


def test_sampled_ids_are_those_of_the_least_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).selectExpr("id", "IF(id % 10 = 0, 'a', 'b') AS c")
    got = common.sample_ids(rows, "id", "c", 100)
    for value in "ab":
        want = [r["id"] for r in rows.filter(F.col("c") == value).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(100).collect()]
        assert sorted(k for k, v in got.items() if v == value) == sorted(want)
    assert common.sample_ids(rows.limit(0), "id", "c", 5) == {}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.use_checkpoints(Session())


def test_next_of_equal_ids_does_not_depend_on_unrelated_rows(spark):
    """Rows that share an id are in the order of their texts' hashes at every size of the table."""
    import xxhash

    texts = [f"a text of its own number {k} " * 9 for k in range(5)]
    own = [(7, t) for t in texts]
    lone = {}
    for more in ([], [(None, f"n {k}") for k in range(500)], [(k, f"d {k % 50}") for k in range(8, 900)]):
        docs = spark.createDataFrame([*own, (6, "the row after them"), *more], "doc_id long, text string")
        made = fingerprints.compare_with_next(docs, range_rows=100).filter("doc_id = 7")
        lone[len(more)] = sorted((r["fingerprint"], r["edited_sha256"]) for r in made.collect())
    assert len(set(map(tuple, lone.values()))) == 1
    order = sorted(texts, key=lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 11)
    following = [*order[1:], "the row after them"]
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(order, following)}
    assert {h for _, h in lone[0]} == want


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ² ①", "Ⅷ", "12 _ -", "é", "字"])] + [(10 + k, "the river and the house") for k in range(4)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert [got[k] for k in range(5)] == ["und", "und", "und", "en", "en"]


def test_trainer_takes_documents_up_to_its_bytes(spark):
    texts = spark.createDataFrame([(k, "x" * n) for k, n in enumerate((50, 500, 30, 20, 1))], "i long, t string")
    assert toxicity._within(texts, [0, 1, 2, 3, 4], 100) == [0, 2, 3] and toxicity._within(texts, [4, 1], 501) == [4, 1]
