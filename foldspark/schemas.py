"""Column names and types of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed names of the catalog's columns, in the archive's order.
CATALOG_COLUMNS = (
    "kepid", "kepoi_name", "kepler_name", "koi_disposition", "koi_pdisposition", "koi_disp_prov", "koi_vet_stat",
    "koi_score", "koi_fpflag_nt", "koi_fpflag_ss", "koi_fpflag_co", "koi_fpflag_ec", "koi_period", "koi_period_err1",
    "koi_period_err2", "koi_time0bk", "koi_time0bk_err1", "koi_time0bk_err2", "koi_duration", "koi_depth", "koi_ror",
    "koi_impact", "koi_model_snr", "koi_num_transits", "koi_prad", "koi_teq", "koi_steff", "koi_slogg", "koi_srad",
    "koi_kepmag", "koi_quarters", "koi_tce_plnt_num", "koi_count", "ra", "dec",
)
_TEXT = {"kepoi_name", "kepler_name", "koi_disposition", "koi_pdisposition", "koi_disp_prov", "koi_vet_stat", "koi_quarters"}
_COUNT = {"koi_fpflag_nt", "koi_fpflag_ss", "koi_fpflag_co", "koi_fpflag_ec", "koi_num_transits", "koi_tce_plnt_num", "koi_count"}


def _catalog_type(name: str) -> T.DataType:
    if name == "kepid":
        return T.LongType()
    return T.StringType() if name in _TEXT else T.IntegerType() if name in _COUNT else T.DoubleType()


CATALOG = T.StructType([T.StructField(c, _catalog_type(c)) for c in CATALOG_COLUMNS])

#: Fixed names that the label policy adds.
LABEL_COLUMNS = ("label", "label_name", "training_status", "exclusion_reason", "label_policy")

#: Fixed names: columns of the catalog that an example keeps, besides the label's.
EXAMPLE_CATALOG_COLUMNS = (
    "kepid", "kepoi_name", "kepler_name", "koi_disposition", "koi_pdisposition", *LABEL_COLUMNS, "koi_score",
    "koi_fpflag_nt", "koi_fpflag_ss", "koi_fpflag_co", "koi_fpflag_ec", "koi_period", "koi_time0bk", "koi_duration",
    "koi_depth", "koi_ror", "koi_impact", "koi_model_snr", "koi_num_transits", "koi_prad", "koi_teq", "koi_steff",
    "koi_slogg", "koi_srad", "koi_kepmag", "koi_count",
)

#: Fixed names of the split manifest's columns.
MANIFEST_COLUMNS = ("kepid", "kepoi_name", "split", "star_stratum", *LABEL_COLUMNS, "koi_disposition", "koi_pdisposition")

LIGHT_CURVE = "kepid long, time double, flux double, flux_err double, quality long, quarter long"

#: Fixed names of a processed curve's columns.
PROCESSED_COLUMNS = (
    "kepid", "time_bkjd", "quarter", "flux_norm", "flux_err_norm", "trend", "flux_detrended", "flux_err_detrended", "in_known_transit_mask",
)

PRODUCTS = (
    "kepid long, quarter int, filename string, data_uri string, size_bytes long, obs_id string, author string, "
    "exptime_seconds double, local_path string, sha256 string"
)


class SchemaError(ValueError):
    """A table lacks columns that an operator needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself, if it has these columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df
