"""Token counts, collocations and fill-in-the-middle against the libraries, plain versions and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldspark.llm import collocations, fill_in_middle, token_counts
from foldspark.llm import queries as llm_queries

from ..compare import difference, duck

SF = "/root/testdata/sf0.001"


def definition() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(definition())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(definition())


POOL = [
    "abcdefghijklmnopqrstuvwxyz", "aab", "'srtlvedm ", "0123½²", "éÉßİΣσς́̀", "日本語", "!?.,<|>'\"", "\x1c\x85\xa0  \t\n", "😀👍",
    ["<|endoftext|>"], ["<|startoftext|>"], ["<|ENDOFTEXT|>"], ["the "], ["ing"], ["AKIA"], ["\U00011382\U000113c9"], ["don't we'll "],
]


def odd_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(POOL)) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_transducer_counts_as_the_library(machine, library):
    for text in [*odd_texts(8000), "a" * 3000, "ab" * 1500, "é" * 700, "x1" * 400, "'" * 500, "'l" * 300, "\n\n \t", ""]:
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:60]


def test_every_character_is_read_as_by_the_library(machine, library):
    for code in [*range(0xD800), *range(0xE000, 0x30000, 7), *range(0xE0000, 0x110000, 997)]:
        text = f"a{chr(code)}b{chr(code)}{chr(code)} {chr(code)}"
        machine.tidy()
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(code)


def test_maps_of_chunks_compose_to_the_count(machine):
    start = machine.start.key
    for text in ["a" * 4000, "ab" * 2000, "the quick don't <|endoftext|> stop " * 90, "é1'" * 900, *odd_texts(60, 5)]:
        whole = machine.prepare(text)
        for size in (7, 100, 1000):
            cuts = range(0, max(1, len(whole)), size)
            maps = [machine.map_of(whole[max(0, at - token_counts.CONTEXT) : at], whole[at : at + size]) for at in cuts]
            ends = {out: (None, machine.ended(out)) for out, _ in maps[-1].values()}
            assert token_counts.total_of([*maps, ends], start) == machine.count(text)
    # Composing is associative, so the order of the scan doesn't matter.
    a, b, c = (machine.map_of("", part) for part in ("we ha", "ven't ", "the"))
    b, c = machine.map_of("we ha", "ven't "), machine.map_of("ven't ", "the")
    join = token_counts.compose
    assert join(join(a, b), c) == join(a, join(b, c))


def test_a_way_outside_of_a_map_is_noticed():
    assert token_counts.total_of([{"s": ("x", 2)}, {"y": ("z", 3)}], "s") is None


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 300])
def test_token_counts_of_the_table(spark, library, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, definition(), chunk=chunk).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)


def test_missed_maps_are_counted_whole(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CONTEXT", 0)
    # Without the characters before a chunk only the start state is mapped, so cuts inside of words miss.
    texts = ["a" * 1000, "the cat sat " * 50, "a" * 1000, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, definition(), chunk=128).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_other_definitions_are_refused():
    with pytest.raises(ValueError):
        token_counts.Transducer(definition().replace('"Lowercase"', '"Strip"', 1))


# Collocations.


def plain_report(rows: list[tuple[str | None, str | None]], least: int, longest: int, reported: int) -> dict:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = tuple(re.findall("[^ \t]+", piece))
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    counts[lang or "und"][words[at : at + k]] += 1
    made = {}
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = [p for p, a in found.items() if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in found.items())]
        scored = []
        for p in kept:
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:reported], 1):
            made[lang, rank] = (phrase.decode(), -a, l, r, n, -score)
    return made


@pytest.mark.parametrize("seed", range(3))
def test_collocations_equal_a_plain_count(spark, seed):
    rng = random.Random(seed)
    words = ["new", "york", "city", "of", "the", "a", "é", " x", "İ", "Big"]
    texts = []
    for _ in range(300):
        texts.append((rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 30)))))
    texts += [("en", None), (None, ""), ("en", " \t "), *[("en", "New York City of")] * 40, ("fr", "le chat " * 5000), ("fr", ". ".join(["le chien"] * 50))]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = collocations.collocations(docs, least=5, reported=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {(r["lang"], r["rank"]): tuple(r)[2:] for r in got.collect()} == plain_report(texts, 5, 4, 40)


def test_buckets_are_counted_out_of_core(monkeypatch):
    monkeypatch.setattr(collocations, "DUCKDB_MEMORY", "20MB")
    names = [f"phrase number {k} with a long tail of words" for k in range(400_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(names)), pa.array(names), pa.array(np.arange(len(names)))], names=["lang", "phrase", "a"])
    parts = [batch.slice(at, 20_000) for at in range(0, len(names), 20_000)]
    got = collocations._count_buckets(iter([*parts, *parts]), 30)
    assert sum(b.num_rows for b in got) == len(names) - 15
    assert list(collocations._count_buckets(iter([]), 30)) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a = 4 * 10**15
    candidates = spark.createDataFrame([("en", "x y", a, 2)], "lang string, phrase string, a long, k int")
    counts = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 2)], "lang string, phrase string, a long")
    assert collocations.scored(candidates, counts).first()["score"] == 2_000_000 * a // (2 * a + 3)


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, collocations.collocations(docs, least=20).collect()))
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    assert sorted(map(tuple, collocations.collocations(docs, least=20).collect())) == want and want


# Fill in the middle.


def plain_middle(doc_id, text) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("run", [1, 3, 512])
def test_fill_in_middle_equals_a_plain_version(spark, run):
    rng = random.Random(run)
    texts = ["".join(rng.choice("ab<PSM>é日😀\n\ŕ") for _ in range(rng.choice([0, 1, 2, 511, 512, 513, 40]))) for _ in range(300)]
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, "no id"), (None, "no id"), (None, None), (7, "<P> here"), (8, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle.rearrange(docs, run=run)
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect())
    assert got == Counter((k, *plain_middle(k, t)) for k, t in rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], r["restored_sha256"]) for r in fill_in_middle.digest(made).collect()) == Counter((k, sha(t)) for k, t in rows)


def test_units_of_words(spark):
    unit = r"\s*\S+\s*"
    texts = ["one two  three four five", "a", "  lead and trail  ", "w " * 700]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in fill_in_middle.rearrange(docs, unit=unit, run=4, rearranged=100, suffix_first=0).collect():
        units = re.findall(unit, r["text"])
        h = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(units) + 1) for k in range(2))
        assert (r["n"], r["form"], r["output"]) == (len(units), "psm", f"<P>{''.join(units[:a])}<S>{''.join(units[b:])}<M>{''.join(units[a:b])}")


@pytest.mark.parametrize("name", ["op12_collocations", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    assert difference(llm_queries.queries()[name](spark, SF), duck(SF), llm_queries.oracle_sql()[name]) is None
