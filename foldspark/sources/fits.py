"""Light curves from FITS binary tables, decoded where the files are read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from foldspark.config import TIME_OFFSET

_BLOCK, _CARD = 2880, 80
#: Binary types of the standard's table columns, all big-endian.
_TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
#: Header fields that are kept beside the samples.
_KEPT = ("DATA_REL", "PROCVER", "OBSMODE", "KEPMAG", "CHANNEL", "CROWDSAP", "FLFRCSAP", "PDCMETHD")
CURVE = (
    "kepid long, quarter long, row int, time double, flux double, flux_err double, quality long, file string, flux_column string, "
    + ", ".join(f"{k.lower()} string" for k in _KEPT)
    + ", error string"
)


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:].split("'")[0].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def read_header(data: bytes, at: int) -> tuple[dict, int]:
    """The keywords of the header at a position, and where its data begin."""
    found: dict = {}
    while True:
        block = data[at : at + _BLOCK]
        if len(block) < _BLOCK:
            raise ValueError("the file ends inside a header")
        at += _BLOCK
        for k in range(0, _BLOCK, _CARD):
            card = block[k : k + _CARD].decode("ascii", "replace")
            if card.startswith("END") and not card[3:].strip():
                return found, at
            if card[8:10] == "= ":
                found[card[:8].strip()] = _value(card[10:])


def read_table(data: bytes) -> tuple[dict, dict, np.ndarray]:
    """(primary header, table header, rows) of a file whose first extension is a binary table."""
    primary, at = read_header(data, 0)
    header, at = read_header(data, at + _data_size(primary))
    fields = []
    for k in range(1, header["TFIELDS"] + 1):
        form = str(header[f"TFORM{k}"]).strip()
        digits = "".join(c for c in form if c.isdigit())
        letter = form[len(digits)]
        repeat = int(digits or 1)
        kind = f"S{repeat}" if letter == "A" else _TYPES[letter]
        fields.append((str(header.get(f"TTYPE{k}", f"COL{k}")).strip(), kind, (repeat,)) if letter != "A" and repeat != 1 else (str(header.get(f"TTYPE{k}", f"COL{k}")).strip(), kind))
    return primary, header, np.frombuffer(data, dtype=np.dtype(fields), count=header["NAXIS2"], offset=at)


def read_headers(file) -> tuple[dict, dict]:
    """(primary header, table header) of an open file, without what lies between or after them."""

    def header() -> dict:
        blocks = b""
        while True:
            blocks += file.read(_BLOCK)
            try:
                return read_header(blocks, 0)[0]
            except ValueError:
                if len(blocks) % _BLOCK or not blocks or len(blocks) > 1000 * _BLOCK or file.tell() >= file.size():
                    raise

    primary = header()
    file.seek(file.tell() + _data_size(primary))
    return primary, header()


def _data_size(primary: dict) -> int:
    """Bytes of the primary data, in whole blocks."""
    axes = [primary.get(f"NAXIS{k}", 0) for k in range(1, primary.get("NAXIS", 0) + 1)]
    size = math.prod(axes) * abs(primary.get("BITPIX", 8)) // 8 if axes else 0
    return -(-size // _BLOCK) * _BLOCK


def kept_fields(name: str, primary: dict, header: dict, flux_column: str) -> dict:
    """What a file's headers say: star, quarter and the kept fields. Another time reference is an error."""
    offset = float(header.get("BJDREFI", 0)) + float(header.get("BJDREFF", 0.0))
    if abs(offset - TIME_OFFSET) > 1e-8 + 1e-5 * TIME_OFFSET:
        raise ValueError(f"unexpected time reference {offset}")
    both = {**header, **primary}
    kept = {k.lower(): None if both.get(k) is None else str(both[k]) for k in _KEPT}
    return {"kepid": int(primary["KEPLERID"]), "quarter": int(primary["QUARTER"]), "file": name, "flux_column": flux_column, **kept, "error": None}


def decode(name: str, data: bytes, flux_column: str) -> pd.DataFrame:
    """One file's samples, unfiltered."""
    primary, header, rows = read_table(data)
    return pd.DataFrame({
        "row": np.arange(len(rows), dtype=np.int32), "time": rows["TIME"].astype(float), "flux": rows[flux_column].astype(float),
        "flux_err": rows[f"{flux_column}_ERR"].astype(float), "quality": rows["SAP_QUALITY"].astype(np.int64), **kept_fields(name, primary, header, flux_column),
    })


def read_light_curves(spark: SparkSession, path: str, flux_column: str = "PDCSAP_FLUX", strict: bool = True) -> DataFrame:
    """The samples of every ``*.fits`` under a path. A file that can't be read fails the query, or, unless ``strict``,
    gives one row with its name and the ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in CURVE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                short = name.rsplit("/", 1)[-1]
                try:
                    yield decode(short, bytes(data), flux_column)[names]
                except (ValueError, KeyError, IndexError) as problem:
                    if strict:
                        raise ValueError(f"{short}: {problem}") from problem
                    yield pd.DataFrame([{**dict.fromkeys(names), "file": short, "error": str(problem)}])

    return files.mapInPandas(run, CURVE)
