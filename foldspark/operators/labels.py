"""Label policy of the catalog, and counts of its outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.config import LABEL_POLICY
from foldspark.functions import normalise_text
from foldspark.schemas import require

POSITIVE, NEGATIVE = 1, 0
#: The archive's vocabulary and the decision for each documented pair (disposition, pipeline disposition).
ARCHIVE_VALUES = ("CONFIRMED", "CANDIDATE", "FALSE POSITIVE", "NOT DISPOSITIONED")
PIPELINE_VALUES = ("CANDIDATE", "FALSE POSITIVE", "NOT DISPOSITIONED")
DECISIONS = {
    ("CONFIRMED", "CANDIDATE"): "planet",
    ("FALSE POSITIVE", "FALSE POSITIVE"): "false_positive",
    ("CANDIDATE", "CANDIDATE"): "unresolved_candidate",
    ("CONFIRMED", "FALSE POSITIVE"): "disposition_conflict",
    ("FALSE POSITIVE", "CANDIDATE"): "disposition_conflict",
    ("CANDIDATE", "FALSE POSITIVE"): "disposition_conflict",
}
LABELS = {"planet": POSITIVE, "false_positive": NEGATIVE}


def _outcomes() -> dict[str, str]:
    """The outcome of every pair of known values, and that of a missing one, which is an empty text."""
    known = {(a, p): DECISIONS.get((a, p), "not_dispositioned") for a in ARCHIVE_VALUES for p in PIPELINE_VALUES}
    return {"": "missing_disposition"} | {f"{a}/{p}": outcome for (a, p), outcome in known.items()}


def _look_up(known: dict, key: F.Column) -> F.Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for item in known.items() for v in item)), key)


def apply_label_policy(catalog: DataFrame, on_unexpected: str = "raise") -> DataFrame:
    """The catalog with label, label_name, training_status, exclusion_reason and label_policy; no row is dropped.

    A value outside the vocabulary fails the query, or with ``on_unexpected="exclude"`` excludes the row as
    ``unexpected_value``. The dispositions themselves stay as they are.
    """
    if on_unexpected not in ("raise", "exclude"):
        raise ValueError(f"on_unexpected must be raise or exclude, not {on_unexpected}")
    require(catalog, "koi_disposition", "koi_pdisposition")
    archive, pipeline = normalise_text("koi_disposition"), normalise_text("koi_pdisposition")
    unexpected = F.lit("unexpected_value")
    if on_unexpected == "raise":
        said = F.concat_ws("/", F.coalesce(F.col("koi_disposition"), F.lit("")), F.coalesce(F.col("koi_pdisposition"), F.lit("")))
        unexpected = F.raise_error(F.concat(F.lit("unexpected disposition: "), said)).cast("string")
    # One look-up reads either text once, where a chain of conditions would normalise it anew in each.
    pair = F.coalesce(F.concat(archive, F.lit("/"), pipeline), F.lit(""))
    outcome = F.coalesce(_look_up(_outcomes(), pair), unexpected)
    eligible = F.col("_outcome").isin(*LABELS)
    label = _look_up(LABELS, F.col("_outcome"))
    return (
        catalog.withColumn("_outcome", outcome)
        .withColumns({
            "label": label.cast("tinyint"),
            "label_name": F.when(eligible, F.col("_outcome")).otherwise(""),
            "training_status": F.when(eligible, "train_eligible").otherwise("excluded"),
            "exclusion_reason": F.when(eligible, "").otherwise(F.col("_outcome")),
            "label_policy": F.lit(LABEL_POLICY),
        })
        .drop("_outcome")
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each value, the most frequent first; an empty text counts as ``excluded``."""
    shown = df.select(*(F.when(F.col(c).cast("string") == "", "excluded").otherwise(F.col(c).cast("string")).alias(c) for c in columns))
    return shown.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of each row value by column value; ``values`` are known, so that no extra job finds them."""
    named = df.select(F.coalesce(F.col(rows), F.lit("missing")).alias(rows), F.coalesce(F.col(columns), F.lit("missing")).alias(columns))
    return named.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)
