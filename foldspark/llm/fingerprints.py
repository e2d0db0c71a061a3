"""Document fingerprints by one-permutation MinHash (operator 7), in SQL functions only.

Each word shingle is hashed once. The hash's top bits name a bin, which keeps its least hash; an empty bin copies the
first filled bin of a probing order of its own (optimal densification). The fingerprint packs the low bits of all bins;
the likeness of two fingerprints is their share of equal bins, corrected for chance agreement of the low bits.

Edge cases: a null text counts as empty; a text with fewer words than a shingle is one shingle; a text without words
has the fingerprint of zeros, like another of these (1.0) and unlike any other (0.0); a very long text is hashed whole.
Rows that repeat an id follow each other in an order that depends on their texts alone, and keep their rows; null ids
come last. A single row is its own next document; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import use_checkpoints

BINS, LOW_BITS, WORDS = 128, 8, 5
#: Probes tried at first for an empty bin; the whole order follows where all of these are empty.
FEW_PROBES = 8
#: Rows in a range of ids that one window orders, and the square root of the number of bounds that the driver holds;
#: beyond so many ranges each is cut again by bounds of its own.
RANGE_ROWS, FAN = 2048, 64
#: Ranges whose first rows are broadcast (some 60 bytes each); a table of more is joined by a shuffle.
BROADCAST_RANGES = 1 << 18


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def probe_order(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one: a fixed random permutation."""
    return np.argsort(np.random.default_rng(20170).random((bins, bins)), axis=1)


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, low_bits: int = LOW_BITS) -> Column:
    """The fingerprint of a text column as a hex string. ``bins`` is a power of two, low_bits 4 or 8."""
    shift = 64 - (bins.bit_length() - 1)
    order = probe_order(bins)
    few, whole = F.array(*[_longs(r[:FEW_PROBES]) for r in order]), F.array(*[_longs(r) for r in order])
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")
    digits = low_bits // 4

    def shingle_hashes(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, words)))

    def minima(hashes: Column) -> Column:
        first = lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1)))
        return F.filter(hashes, first)

    def by_bin(least: Column) -> Column:
        """One entry for each bin, null where it is empty."""
        table = F.map_from_arrays(F.transform(least, bin_of), least)
        return _let(table, lambda t: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.element_at(t, j)))

    def dense(own: Column) -> Column:
        def donor(probes: Column) -> Column:
            return F.get(F.filter(F.transform(probes, lambda b: F.get(own, b)), lambda v: v.isNotNull()), F.lit(0))

        return F.transform(own, lambda v, j: F.coalesce(v, donor(F.get(few, j)), donor(F.get(whole, j))))

    def packed(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND((1 << low_bits) - 1))), digits, "0")), "")

    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    made = _let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda t: F.when(F.size(t) == 0, F.lit("0" * (bins * digits))).otherwise(
            _let(
                F.sort_array(shingle_hashes(t)),
                lambda s: _let(minima(s), lambda m: _let(by_bin(m), lambda own: packed(dense(own)))),
            )
        ),
    )
    return made


def likeness(a: Column, b: Column, bins: int = BINS, low_bits: int = LOW_BITS) -> Column:
    """The estimated share of shingles that two texts have in common, from their fingerprints."""
    digits, chance = low_bits // 4, 2.0**-low_bits
    blank = "0" * (bins * digits)

    def same(x: Column, y: Column) -> Column:
        cut = lambda c, i: F.substring(c, i, F.lit(1))
        pairs = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: (cut(x, i) == cut(y, i)).cast("int"))
        return F.aggregate(pairs, F.lit(0), lambda total, v: total + v)

    as_bytes = lambda c: F.unhex(c) if digits == 2 else F.encode(c, "UTF-8")
    shared = _let(as_bytes(a), lambda x: _let(as_bytes(b), lambda y: same(x, y))) / F.lit(float(bins))
    corrected = F.greatest(F.lit(0.0), (shared - chance) / (1.0 - chance))
    return F.when(a == b, 1.0).when((a == blank) | (b == blank), 0.0).otherwise(corrected)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key, found in two steps of at most FAN comparisons."""
    step = max(1, -(-len(bounds) // FAN))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads, fine = _longs(p[0] for p in parts), F.array(*[_longs(p) for p in parts])
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    return _let(at_most(heads), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * step + at_most(F.get(fine, i - 1))))


def _with_ranges(docs: DataFrame, range_rows: int) -> DataFrame:
    """docs dealt to ranges (coarse, fine, sub) of about ``range_rows`` rows, with the order of rows that repeat an id.

    In descending order of ids come coarse ranges, whose bounds the driver holds, then fine ones, whose bounds are rows
    of a table. An id that fills whole ranges (it is the bound of several), or the null ids, are cut by their texts'
    hashes into ``sub`` ranges that follow the others of their range. The first row of each range is also a guest of
    the range before it, that of the first range of the last one.
    """
    use_checkpoints(docs.sparkSession)
    ids = F.col("doc_id")
    shares = [i / FAN**2 for i in range(1, FAN**2)]
    rows, known, cuts = docs.agg(F.count(F.lit(1)), F.count(ids), F.percentile_approx(ids, shares, 10_000)).first()
    wanted = max(1, -(-known // range_rows))
    fine, every = -(-wanted // FAN**2), max(1, FAN**2 // wanted)
    bounds = [int(c) for c in (cuts or [])[every - 1 :: every]] if wanted > 1 else []
    hot = {b: n * fine for b, n in Counter(bounds).items() if n > 1}
    null_parts = max(1, -(-(rows - known) // range_rows))
    # Whatever the table's size, rows with one id are in the order of their texts' hashes.
    ranged = docs.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 11))
    ranged = ranged.withColumn("coarse", F.coalesce(_range_of(ids, bounds) if bounds else F.when(ids.isNotNull(), 0), F.lit(-1)))
    inner = F.array().cast("array<bigint>")
    if fine > 1:
        own = F.percentile_approx(ids, [i / fine for i in range(1, fine)], 10_000).alias("inner")
        table = ranged.groupBy("coarse").agg(own).checkpoint()
        small = FAN**2 * fine <= 4 * BROADCAST_RANGES
        ranged = ranged.join(F.broadcast(table) if small else table, "coarse")
        inner = F.coalesce("inner", inner)
    same = F.size(F.filter(inner, lambda b: b == ids))
    if hot:
        same = F.greatest(same, F.coalesce(F.element_at(F.map_from_arrays(_longs(hot), _longs(hot.values())), ids), F.lit(0)))
    part = lambda parts: 1 + F.floor(F.col("order") * F.lit(2.0**-53) * parts)
    ranged = ranged.withColumn("fine", F.coalesce(F.size(F.filter(inner, lambda b: b <= ids)), F.lit(0)))
    ranged = ranged.withColumn("sub", F.when(ids.isNull(), part(null_parts)).when(same > 1, part(same)).otherwise(0)).drop("inner")
    first = F.min(F.struct(F.bitwise_not(ids).alias("key"), "order"))
    firsts = ranged.groupBy("coarse", "fine", "sub").agg(first.alias("first")).checkpoint()
    last = firsts.groupBy("coarse").agg(F.max(F.struct((-F.col("fine")).alias("fine"), "sub")).alias("last")).collect()
    ends = {r["coarse"]: (r["coarse"], -r["last"]["fine"], r["last"]["sub"]) for r in last}
    order = sorted(ends, reverse=True)
    wraps = docs.sparkSession.createDataFrame([(c, ends[order[k - 1]]) for k, c in enumerate(order)], "coarse int, end struct<coarse: int, fine: int, sub: bigint>")
    before = F.lag(F.struct("coarse", "fine", F.col("sub").cast("long").alias("sub"))).over(Window.partitionBy("coarse").orderBy(F.desc("fine"), "sub"))
    hosts = firsts.withColumn("before", before).join(F.broadcast(wraps), "coarse")  # a row for each coarse range
    hosts = hosts.select(F.col("coarse").alias("_c"), F.col("fine").alias("_f"), F.col("sub").alias("_s"), "first", F.coalesce("before", "end").alias("host"))
    if wanted + null_parts <= BROADCAST_RANGES:
        hosts = F.broadcast(hosts)
    leads = (
        (F.col("coarse") == F.col("_c")) & (F.col("fine") == F.col("_f")) & (F.col("sub") == F.col("_s")) & (F.col("order") == F.col("first.order"))
        & (F.coalesce(F.bitwise_not(ids), F.lit(0)) == F.coalesce("first.key", F.lit(0)))
    )
    place = lambda c, f, s, guest: F.struct(c.alias("coarse"), f.alias("fine"), s.cast("long").alias("sub"), F.lit(guest).alias("guest"))
    own = place(F.col("coarse"), F.col("fine"), F.col("sub"), False)
    guest = place(F.col("host.coarse"), F.col("host.fine"), F.col("host.sub"), True)
    joined = ranged.join(hosts, leads, "left")
    return joined.select(*docs.columns, "order", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at")).select("*", "at.*").drop("at")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likenesses, with the next document by descending id.

    The documents are cut into ranges of ids of about equal size, so no task orders them all; one shuffle carries the
    texts with their fingerprints.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = _with_ranges(plain, range_rows).withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("coarse", "fine", "sub").orderBy("guest", F.col("doc_id").desc_nulls_last(), "order", "text")
    nexts = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    rows = nexts.filter(~F.col("guest")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # In a table of one row, or of null ids alone, the text itself is next.
    following = F.coalesce("next_text", "text")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(following, F.lit(1), half)))
    marked = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
