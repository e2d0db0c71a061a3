"""The corpus pipeline against its stages' plain definitions."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from foldspark.llm import quality, secrets, toxicity

from .test_text import SF, components, simhash


def test_pipeline_equals_its_stages_by_hand(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    graded = quality.train(docs, labels)
    step = sum(g < quality.GOOD_GRADE for g in graded.grades)
    tails = {r["doc_id"]: quality.Model.tails(graded, __import__("numpy").array([graded.score(quality.features(r["text"]))]))[0][step - 1] for r in rows}
    rows = [r for r in rows if tails[r["doc_id"]] >= quality.KEEP_CHANCE]
    after = docs.filter(docs["doc_id"].isin([r["doc_id"] for r in rows]))
    model = toxicity.train(after, labels)
    scores = model.scores([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    marks = {r["doc_id"]: simhash(r["text"]) for r in rows}
    ids = sorted(marks)
    group = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 2])
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    whole, chain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), secrets.train()
    want = {}
    for r in rows:
        ids = len(whole.encode(secrets.redacted(r["text"], chain) or "", add_special_tokens=False).ids) + 1
        want |= {(r["doc_id"], p): min(2048, ids - 2048 * p) for p in range(-(-ids // 2048))}
    assert {(r["doc_id"], r["piece"]): r["length"] for r in got} == want
    assert len(rows) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
