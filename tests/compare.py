"""Run registered queries beside their DuckDB SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, (np.floating, float)):
        return round(float(value), 9)
    if isinstance(value, (np.integer, int)) and not isinstance(value, (bool, np.bool_)):
        return int(value)
    return str(value) if not isinstance(value, (str, bool)) else value


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(canonical(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def main(sf_dir, names):
    import __spark_entry__ as entry
    from tests.session import session

    spark, con = session(), oracle(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            line = f"{name}: {len(got)} rows, {time.time() - t:.1f} s"
            if name in sql:
                want = con.sql(sql[name]).df()
                a, b = rows(got), rows(want)
                if a != b:
                    bad.append(name)
                    diff = [x for x in zip(a[1], b[1], strict=False) if x[0] != x[1]][:2]
                    line += f" DIFFERS {a[0]} {b[0]} {len(want)} {diff}"
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            line = f"{name}: ERROR {str(e)[:600]}"
        print(line, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
