"""Phrase collocations (operator 12): exact counts of frequent phrases, scored by their weakest cut.

Texts are cut into pieces, and identical pieces of a language become one row with a multiplicity. Phrases are counted
level by level, weighted by it: tasks over the pieces add up their phrases block by block, the sums are dealt by hash of
the phrase to buckets, and each bucket is counted in DuckDB under a memory limit, beyond which it spills. A phrase is as
rare as its rarest part, so from the second level on only phrases both of whose parts may be frequent are counted; a
Bloom filter of bounded size tells which, and where it errs the counts of more phrases are made and dropped. So no count
is lost, and one word pair with a third of all rows is one row from each task.

The counts of a candidate's parts are looked up by requests that are shuffled to them. The report of a language is
limited within salted parts first, then over their heads, so no task gets all candidates.

DuckDB spills where Spark itself does, in the local folders of the executor, into a folder that goes with the task; a
lost executor repeats its buckets. Levels are Parquet tables in the folder of spark.checkpoint.dir until the report is
settled there.

Edge cases: a null or empty text has no words; a null language is `und`; words may hold any characters but blanks and the
separators; repeated rows count as often as they stand there; very long texts and pieces are counted whole; other columns
are ignored, whatever their names; an empty table gives an empty report.
"""

from __future__ import annotations

import os
import shutil
import string
import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.lineage import settle
from foldspark.llm.common import remove, use_checkpoints

MIN_COUNT, LONGEST, REPORTED = 30, 4, 2000
#: A candidate goes if a longer one that holds it has at least this share of its count, in hundredths.
COVERED = 80
SCALE = 2_000_000
SEPARATORS = "[.,;:!?\\x0A-\\x0D]"
UNKNOWN = "und"
#: Bytes of pieces whose phrases a task adds up at once, and of pieces for each bucket.
BLOCK, BUCKET = 12_000_000, 16_000_000
#: Memory of DuckDB for a bucket.
DUCKDB_MEMORY = "300MB"
#: Bits of a filter: so many a phrase within these bounds (32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 28
#: Parts in which a language's candidates are limited first.
SALTS = 64

_COUNTS = "lang string, phrase string, a long"
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): the pieces of the lower-cased texts, words joined by single blanks, with multiplicities."""
    lower = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(lower, SEPARATORS)).alias("piece"))
    words = cut.select("lang", F.trim(F.regexp_replace("piece", "[ \\t]+", " ")).alias("piece"))
    return words.filter(F.col("piece") != "").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


# Hashes for the filters: of a word with its language, then of a phrase from those of its words.


def _word_hash(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\n{word}")


def _joined(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    return hashes * _MULTIPLIER + more


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each hash among ``bits``, a power of two."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * _MIXER
    mixed ^= mixed >> np.uint64(32)
    low, high = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return (low + np.arange(3, dtype=np.uint64)[:, None] * high) & np.uint64(bits - 1)


def _filter(spark: SparkSession, frequent: DataFrame, count: int):
    """A broadcast Bloom filter of the phrases (lang, phrase): 64-bit words, at most ``MOST_BITS`` in all.

    Tasks set bits of their own phrases; the words are combined by a shuffle, so the driver gets the filter and no phrase.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.empty(batch.num_rows, dtype=np.uint64)
            for k, (lang, phrase) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                total = 0
                for word in phrase.split(" "):
                    total = (total * int(_MULTIPLIER) + _word_hash(lang, word)) & 0xFFFFFFFFFFFFFFFF
                hashes[k] = total
            places = np.unique(_places(hashes, bits))
            slots, starts = np.unique(places >> np.uint64(6), return_index=True)
            words = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), starts) if len(places) else places
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(words.view(np.int64))], names=["slot", "word"])

    set_ = frequent.select("lang", "phrase").mapInArrow(set_bits, "slot long, word long")
    found = set_.groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[found["slot"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    held = np.ones(len(hashes), dtype=bool)
    for places in _places(hashes, len(table) << 6):
        held &= (table[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
    return held


def _phrases(langs: pa.Array, pieces: pa.Array, m: np.ndarray, k: int, table: np.ndarray | None) -> pa.RecordBatch:
    """The weighted counts of the k-word phrases of a block of pieces whose two parts of k - 1 words the filter holds."""
    lists = pc.split_pattern(pieces, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    spelled = pc.list_flatten(lists).dictionary_encode()
    tongue = langs.dictionary_encode()
    piece = np.repeat(np.arange(len(sizes)), sizes)
    # A word is numbered with its language, so phrases of two languages differ.
    spellings = len(spelled.dictionary)
    codes = tongue.indices.to_numpy()[piece].astype(np.int64) * spellings + spelled.indices.to_numpy()
    kinds, word = np.unique(codes, return_inverse=True)
    texts = spelled.dictionary.take(pa.array(kinds % spellings))
    tongues = tongue.dictionary.take(pa.array(kinds // spellings))
    n = len(word)
    if k == 1:
        counts = np.bincount(word, weights=m[piece], minlength=len(kinds)).astype(np.int64)
        return pa.RecordBatch.from_arrays([tongues, texts, pa.array(counts)], names=["lang", "phrase", "a"])
    names = np.fromiter(map(_word_hash, tongues.to_pylist(), texts.to_pylist()), dtype=np.uint64, count=len(kinds))[word]
    part = names
    for j in range(1, k - 1):
        part = _joined(part[:-1], names[j:])
    begins = np.flatnonzero(piece[: max(0, n - k + 1)] == piece[k - 1 :])
    # Places where a phrase and so both of its parts lie inside one piece.
    held = np.zeros(len(part), dtype=bool)
    asked = np.zeros(len(part), dtype=bool)
    asked[begins] = asked[begins + 1] = True
    held[asked] = _held(table, part[asked])
    begins = begins[held[begins] & held[begins + 1]]
    columns, groups = [word[begins + j] for j in range(k)], None
    for column in columns:
        groups = column if groups is None else np.unique(groups * np.int64(len(kinds)) + column, return_inverse=True)[1]
    if not len(begins):
        return pa.RecordBatch.from_arrays([tongues[:0], texts[:0], pa.array([], pa.int64())], names=["lang", "phrase", "a"])
    _, first, groups = np.unique(groups, return_index=True, return_inverse=True)
    counts = np.bincount(groups, weights=m[piece[begins]]).astype(np.int64)
    parts = [texts.take(pa.array(c[first])) for c in columns]
    return pa.RecordBatch.from_arrays([tongues.take(pa.array(columns[0][first])), pc.binary_join_element_wise(*parts, " "), pa.array(counts)], names=["lang", "phrase", "a"])


def _count_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a bucket with a sum of at least ``least``, counted by DuckDB, which spills beyond its memory."""
    first = next(batches, None)
    if first is None:
        return
    schema = first.schema
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    spill = tempfile.mkdtemp(prefix="bucket-", dir=local if local and os.path.isdir(local) else None)
    try:
        with duckdb.connect() as session:
            session.execute("SET threads = 1")
            session.execute(f"SET memory_limit = '{DUCKDB_MEMORY}'")
            session.execute(f"SET temp_directory = '{spill}'")
            session.execute("SET preserve_insertion_order = false")

            def rows() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            session.register("rows", pa.RecordBatchReader.from_batches(schema, rows()))
            query = f"SELECT lang, phrase, sum(a)::BIGINT AS a FROM rows GROUP BY lang, phrase HAVING sum(a) >= {int(least)}"
            for batch in session.sql(query).to_arrow_reader(65_536):
                yield batch.cast(schema) if batch.schema != schema else batch
    finally:
        shutil.rmtree(spill, ignore_errors=True)


def count_phrases(pieces: DataFrame, k: int, table, buckets: int, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, a): the k-word phrases of pieces (lang, piece, m) with at least ``least`` occurrences.

    ``table`` is a broadcast filter of the frequent phrases of k - 1 words, None for single words.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return _phrases(whole.column(0), whole.column(1), whole.column(2).to_numpy(), k, None if table is None else table.value)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= BLOCK:
                yield block()
                held.clear()
                size = 0
        if held:
            yield block()

    sums = pieces.select("lang", "piece", "m").mapInArrow(add_up, _COUNTS)
    dealt = sums.repartition(buckets, "lang", "phrase")
    return dealt.mapInArrow(lambda batches: _count_buckets(batches, least), _COUNTS)


def _part(begin, length):
    return F.array_join(F.slice("words", begin, length), " ")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates (lang, phrase, a, k), by the counts (lang, phrase, a) of their parts."""
    split = candidates.withColumn("words", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    known = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = known.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates (lang, phrase, a, k) without those that a longer one holds and nearly always brings."""
    longer = candidates.filter(F.col("k") > 2).withColumn("words", F.split("phrase", " "))
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    most = longer.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    exact = "cast({} as decimal(38, 0)) * {}"
    return kept.filter(F.col("most").isNull() | F.expr(f"{exact.format('most', 100)} < {exact.format('a', covered)}")).drop("most")


def report(rows: DataFrame, reported: int = REPORTED) -> DataFrame:
    """The first rows of each language by score, count and phrase, ranked from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    heads = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= reported)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= reported).drop("salt")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, reported: int = REPORTED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations of 2 to ``longest`` words."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/collocations-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    pieces = stored(pieces_of(docs, text_col, lang_col), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    levels = [stored(count_phrases(pieces, 1, None, buckets, least), "1")]
    for k in range(2, longest + 1):
        table = _filter(spark, levels[-1], levels[-1].count())
        levels.append(stored(count_phrases(pieces, k, table, buckets, least), str(k)))
        table.unpersist()
    words = F.col("m") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1)
    totals = pieces.groupBy("lang").agg(F.sum(words).alias("n"))
    numbered = [level.withColumn("k", F.lit(k)) for k, level in enumerate(levels, 1)]
    candidates, counts = numbered[1], levels[0]
    for more in numbered[2:]:
        candidates = candidates.union(more)
    for more in levels[1:-1]:
        counts = counts.union(more)
    best = report(scored(uncovered(candidates), counts), reported)
    made = best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    made = settle(made)
    remove(spark, folder)
    return made
