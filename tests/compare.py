"""Run queries beside their DuckDB forms and compare whole results.

    python tests/compare.py FOLDER [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(v):
    """A value in one form for both engines."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def kind(text: str) -> str:
    text = text.lower()
    if text.startswith(("decimal", "struct", "map", "array")) or text.endswith("[]"):
        return "nested" if not text.startswith("decimal") else "decimal"
    same = {"varchar": "string", "integer": "int", "timestamp": "timestamp_ntz", "real": "float",
            "timestamp with time zone": "timestamp", "blob": "binary"}
    return same.get(text, text)


def compare(spark, con, key: str, root: str, queries, oracles) -> str:
    df = queries[key](spark, root)
    names = df.columns
    got = rows_of(names, df.collect())
    if key not in oracles:
        return f"rows only ({sum(got.values())})"
    rel = con.execute(oracles[key])
    onames = [d[0] for d in rel.description]
    otypes = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {oracles[key]}").fetchall()}
    rel = con.execute(oracles[key])
    want = rows_of(onames, rel.fetchall())
    if sorted(names) != sorted(onames):
        return f"COLUMNS {sorted(names)} / {sorted(onames)}"
    bad = {n: (kind(t), otypes[n]) for n, t in df.dtypes if kind(t) != otypes[n]}
    if got != want:
        a, b = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"VALUES {sum(got.values())} / {sum(want.values())}; ours {str(a)[:500]}; theirs {str(b)[:500]}"
    if bad:
        return f"TYPES {bad}"
    return f"ok ({sum(got.values())})"


def main() -> None:
    from lumenframe.queries import ORACLES, QUERIES
    from lumenframe.session import build_session

    root = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    keys = [k for k in QUERIES if any(k == w or QUERIES[k].__module__.endswith(w) for w in wanted)]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(root)
    faults = 0
    for key in keys:
        start = time.time()
        try:
            said = compare(spark, con, key, root, QUERIES, ORACLES)
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if not said.startswith(("ok", "rows only")):
            faults += 1
        if not said.startswith("ok") or "-v" in sys.argv:
            print(f"{key}: {said} [{time.time() - start:.1f}s]", flush=True)
    print(f"{len(keys)} queries, {faults} faults")
    spark.stop()


if __name__ == "__main__":
    main()
