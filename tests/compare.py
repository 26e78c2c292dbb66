"""Run a registered query and its SQL twin over the same tables and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from lutrin.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, bool | str | int):
        return value
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str) -> dict:
    t0 = time.time()
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    t2 = time.time()
    return {"name": name, "columns": (got_columns, want_columns), "got": got, "want": want,
            "types": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "sql_types": {d[0]: str(d[1]) for d in result.description},
            "same": got_columns == want_columns and got == want, "spark_sec": t1 - t0, "sql_sec": t2 - t1}


def main() -> None:
    from lutrin.session import build_session
    import __spark_entry__ as E

    folder = sys.argv[1]
    names = sys.argv[2:] or list(E.queries())
    spark, con = build_session(), connect(folder)
    queries, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name in names:
        try:
            if name not in sqls:
                t = time.time()
                n = queries[name](spark, folder).count()
                print(f"{name}: rows {n}, no SQL, {time.time() - t:.1f}s", flush=True)
                continue
            r = compare(spark, con, name, queries[name], sqls[name], folder)
            print(f"{'OK ' if r['same'] else 'BAD'} {name}: {len(r['got'])} rows, spark {r['spark_sec']:.1f}s sql {r['sql_sec']:.1f}s", flush=True)
            if not r["same"]:
                bad.append(name)
                print("   columns", r["columns"], "rows", len(r["got"]), len(r["want"]))
                a, b = set(r["got"]), set(r["want"])
                for x in sorted(a - b, key=repr)[:2]:
                    print("   spark:", repr(x)[:600])
                for x in sorted(b - a, key=repr)[:2]:
                    print("   sql:  ", repr(x)[:600])
                print("   only spark", len(a - b), "only sql", len(b - a))
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print("ERR", name, type(e).__name__, str(e)[:900], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
