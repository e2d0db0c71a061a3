"""Light curves in FITS files as a data source: ``spark.dataSource.register(FitsSource)``, then ``format("fits")``.

Files are dealt to partitions of about equal size. The schema that is asked for says what is read: a column that isn't in
it isn't made, and with header fields alone only the headers are read, one row a file. Stores are reached through Arrow's
file systems, so a path is an address (``file:///...``, ``hdfs://...``, ``s3://...``) or a local path.

Options: ``flux`` (the flux column, PDCSAP_FLUX), ``mode`` (FAILFAST, or PERMISSIVE for a row with the error in place of a
file that can't be read), ``partitionBytes`` (128 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldspark.sources import fits

#: Columns that need a file's samples.
SAMPLES = ("row", "time", "flux", "flux_err", "quality")


@dataclass
class Files(InputPartition):
    paths: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.flux = options.get("flux", "PDCSAP_FLUX")
        self.strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 128 << 20)))
        unknown = [n for n in schema.names if n not in [c.split()[0] for c in fits.CURVE.split(", ")]]
        if unknown:
            raise ValueError(f"not columns of a light curve: {unknown}")

    def partitions(self) -> list[Files]:
        """Groups of files by size, in the order of their paths."""
        store, base = _store(self.path)
        if store.get_file_info(base).type == fs.FileType.File:
            return [Files([base])]
        found = sorted(store.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda f: f.path)
        groups, size = [], self.most + 1
        for info in found:
            if info.type != fs.FileType.File or not info.path.endswith(".fits"):
                continue
            if size + info.size > self.most:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(info.path)
            size += info.size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        out = to_arrow_schema(self.schema)
        sampled = any(n in SAMPLES for n in out.names)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            try:
                columns = self._samples(store, path, name, out.names) if sampled else self._header(store, path, name)
            except (ValueError, KeyError, IndexError) as problem:
                if self.strict:
                    raise ValueError(f"{name}: {problem}") from problem
                columns = {"file": [name], "error": [str(problem)]}
            rows = len(next(iter(columns.values())))
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * rows), f.type) for f in out], schema=out)

    def _samples(self, store: fs.FileSystem, path: str, name: str, names: list[str]) -> dict:
        with store.open_input_stream(path) as stream:
            made = fits.decode(name, stream.read(), self.flux)
        # Missing readings are nulls, as in every other source.
        return {c: pa.array(made[c], from_pandas=True) for c in names if c in made}

    def _header(self, store: fs.FileSystem, path: str, name: str) -> dict:
        """The fields of a file's headers, read block by block."""
        with store.open_input_file(path) as file:
            primary, table = fits.read_headers(file)
        return {k: [v] for k, v in fits.kept_fields(name, primary, table, self.flux).items()}


class FitsSource(DataSource):
    """One row a sample, or one a file where only header fields are asked for."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return fits.CURVE

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, self.options)
