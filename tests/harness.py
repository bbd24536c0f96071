"""Runs a query in Spark and its SQL in DuckDB and compares schema-free sorted rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if hasattr(x, "to_pydatetime"):
        x = x.to_pydatetime()
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(want[1])} rows differ, e.g. {bad[0]}" if bad else ""


def main(names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from weftspark.session import get_session

    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, con = "/root/testdata/sf0.01", connect("/root/testdata/sf0.01")
    queries, sqls, failed = entry.queries(), entry.oracle_sql(), []
    for name in queries if not names else [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]:
        began = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, queries[name], sqls[name], sf_dir) or "equal"
            else:
                said = f"no SQL, {len(queries[name](spark, sf_dir).collect())} rows"
        except Exception as error:  # noqa: BLE001
            said = f"error {type(error).__name__}: {str(error)[:600]}"
        if not said.startswith(("equal", "no SQL")):
            failed.append(name)
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
