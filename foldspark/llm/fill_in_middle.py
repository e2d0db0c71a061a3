"""Fill-in-the-middle rearrangement of documents (operator 13), by relational units.

A text is cut into units, matched left to right by a pattern (here one code point). Two cut requests per document, drawn
from a hash of its id, name units by ordinal. Units become a relation: matches of up to ``RUN`` units each are exploded
with their positions, a window sums the lengths before each match, and requests are joined to the match that holds the
unit before their cut. The offsets are aggregated per document and joined to the texts, which substring then cuts. A text
of n units makes n / RUN rows of numbers, not n, and is shuffled once; plain documents aren't shuffled at all.

Edge cases: a null or empty text, one that holds a marker and one that the units don't cover stays plain; a null id
counts as the empty text in the hash; repeated rows give equal results; very long texts are read whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and so many of these with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: One code point.
CODE_POINT = "(?s:.)"
#: Units in a match.
RUN = 512


def _draw(k: int) -> Column:
    """The k-th group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")


def _runs(text: Column, unit: str, run: int) -> Column:
    """The text in matches of ``run`` units, the last of which may have fewer: units are taken greedily."""
    return F.regexp_extract_all(text, F.lit(f"(?:{unit}){{1,{run}}}"), F.lit(0))


def _inside(text: Column, unit: str, run: int, cut: Column) -> Column:
    """The characters, within its match, of the units before a cut."""
    within = F.when(cut == 0, 0).otherwise((cut - 1) % run + 1).cast("int")
    if unit == CODE_POINT:
        return within.cast("long")
    match = F.get(_runs(text, unit, run), _match_of(cut, run).cast("int"))
    units = F.slice(F.regexp_extract_all(match, F.lit(unit), F.lit(0)), F.lit(1), within)
    return F.aggregate(units, F.lit(0).cast("long"), lambda total, u: total + F.length(u))


def _match_of(cut: Column, run: int) -> Column:
    """The match that holds the last unit before a cut."""
    return F.when(cut == 0, F.lit(0).cast("long")).otherwise(F.floor((cut - 1) / run))


def forms(docs: DataFrame, unit: str = CODE_POINT, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key, n, form, first, second): each text's units, its form and the units before either cut.

    ``key`` stands for the id and the text, so rows that share it are alike in everything.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    by_points = unit == CODE_POINT
    rows = rows.withColumns({
        "digest": F.sha2(F.concat(F.lit("1:"), name), 256),
        "key": F.md5(F.concat(name, F.lit(":"), "text")),
        "n": (F.length("text") if by_points else F.regexp_count("text", F.lit(unit))).cast("long"),
    })
    whole = F.lit(True) if by_points else F.regexp_replace("text", F.lit(unit), F.lit("")) == ""
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | ~whole | (_draw(2) % 100 >= rearranged)
    form = F.when(plain, "plain").when(_draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    a, b = (_draw(k) % (F.col("n") + 1) for k in (0, 1))
    return rows.select("doc_id", "text", "key", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def cut_offsets(asked: DataFrame, unit: str = CODE_POINT, run: int = RUN) -> DataFrame:
    """(key, prefix_chars, before_suffix) in characters, for the cuts ``first`` and ``second`` of texts (key, text)."""
    text = F.col("text")
    sizes = F.transform(_runs(text, unit, run), lambda match: F.length(match))
    cuts = F.array(*(
        F.struct(F.lit(which).alias("which"), _match_of(F.col(cut), run).alias("match"), _inside(text, unit, run, F.col(cut)).alias("inside"))
        for which, cut in enumerate(("first", "second"))
    ))
    # Rows of one key are alike; one of them is kept.
    single = asked.select("key", sizes.alias("sizes"), cuts.alias("cuts")).groupBy("key").agg(F.first("sizes").alias("sizes"), F.first("cuts").alias("cuts"))
    matches = single.select("key", F.posexplode("sizes").alias("match", "size")).withColumn("match", F.col("match").cast("long"))
    before = Window.partitionBy("key").orderBy("match").rowsBetween(Window.unboundedPreceding, -1)
    placed = matches.select("key", "match", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    requests = single.select("key", F.inline("cuts"))
    found = requests.join(placed, ["key", "match"]).withColumn("offset", F.col("before") + F.col("inside"))
    least, most = F.min("offset").alias("prefix_chars"), F.max("offset").alias("before_suffix")
    return found.groupBy("key").agg(least, most)


def rearrange(docs: DataFrame, unit: str = CODE_POINT, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", **shares) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output): the rearranged texts; lengths are null where plain."""
    rows = forms(docs, unit, id_col=id_col, text_col=text_col, **shares)
    asked = rows.filter(F.col("form") != "plain")
    none = F.lit(None).cast("long")
    plain = rows.filter(F.col("form") == "plain").select("doc_id", "text", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    # Offsets are a few numbers a text, so they and not the texts are what a task's join holds.
    cut = asked.join(cut_offsets(asked, unit, run).hint("shuffle_hash"), "key")
    part = {
        "prefix": F.expr("substring(text, 1, cast(prefix_chars as int))"),
        "middle": F.expr("substring(text, cast(prefix_chars + 1 as int), cast(before_suffix - prefix_chars as int))"),
        "suffix": F.expr("substring(text, cast(before_suffix + 1 as int))"),
    }
    psm = F.concat(F.lit(PREFIX), part["prefix"], F.lit(SUFFIX), part["suffix"], F.lit(MIDDLE), part["middle"])
    spm = F.concat(F.lit(SUFFIX), part["suffix"], F.lit(PREFIX), part["prefix"], F.lit(MIDDLE), part["middle"])
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    lengths = F.col("prefix_chars"), (F.col("before_suffix") - F.col("prefix_chars")).alias("middle_chars")
    return cut.select("doc_id", "text", "n", "form", *lengths, output.alias("output")).unionByName(plain)


def digest(made: DataFrame) -> DataFrame:
    """The rearranged rows with hashes in place of texts; the second hash is of the text rebuilt from output and form."""
    psm = F.col("form") == "psm"
    first, second = F.when(psm, 1).otherwise(2), F.when(psm, 2).otherwise(1)
    rebuilt = F.concat(F.get("part", first), F.get("part", F.lit(3)), F.get("part", second))
    # A marker begins with a sign that it holds once, so none arises where parts meet.
    split = made.withColumn("part", F.when(F.col("form") != "plain", F.split("output", "<[PSM]>")))
    return split.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(F.coalesce(rebuilt, "output"), 256).alias("restored_sha256"),
    )
