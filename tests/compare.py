"""Compare registered queries with their SQL on one folder of tables: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_cell(r[k]) for k in order) for r in data)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL text's result; None if nothing does."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want, got = rows(names, cursor.fetchall()), rows(df.columns, df.collect())
    if want == got:
        return None
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    made, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in made if not n.startswith(("op", "pipeline"))]:
        start = time.time()
        try:
            df = made[name](spark, sf_dir)
            said = difference(df, con, sql[name]) if name in sql else f"(rows only: {df.count()})"
        except Exception as problem:
            said = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        fine = said is None or said.startswith("(rows")
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {name} {time.time() - start:.1f}s {said or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
