"""Runs registered queries next to their SQL on DuckDB and compares schema, row count and values.

    python tests/compare.py [--sf DIR] [names or prefixes...]
"""
from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAME_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date",
             "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", v + 0.0)
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", *[canon(x) for x in v])
    return (type(v).__name__, v)


def compare(df, con, sql: str) -> list[str]:
    problems = []
    spark_types = dict(df.dtypes)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs_types = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    if sorted(spark_types) != sorted(names):
        return [f"columns {sorted(spark_types)} vs {sorted(names)}"]
    for c in names:
        want = SAME_TYPE.get(theirs_types[c], theirs_types[c])
        if want != spark_types[c] and not spark_types[c].startswith("array"):
            problems.append(f"type of {c}: {spark_types[c]} vs {theirs_types[c]}")
    cols = sorted(names)
    ours = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    pos = [names.index(c) for c in cols]
    theirs = [tuple(canon(r[i]) for i in pos) for r in theirs]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    a, b = sorted(map(repr, ours)), sorted(map(repr, theirs))
    if a != b:
        from collections import Counter
        ca, cb = Counter(a), Counter(b)
        problems.append(f"values differ: {sum((ca - cb).values())} only here, e.g. {list((ca - cb))[:2]} / {list((cb - ca))[:2]}")
    if not ours:
        problems.append("no rows")
    return problems


def main(argv):
    import __spark_entry__ as entry
    from shelfline.session import build_session, clear_scratch
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        k = argv.index("--sf")
        sf = argv[k + 1]
        argv = argv[:k] + argv[k + 2:]
    spark = build_session(master="local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                issues = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                issues = [] if n else ["no rows"]
        except Exception as e:  # report and go on with the next query
            issues = [f"{type(e).__name__}: {str(e)[:600]}"]
        clear_scratch(spark)
        bad += bool(issues)
        print(f"{'FAIL' if issues else 'ok  '} {time.time() - t0:6.1f}s {'' if name in sqls else '(rows only) '}{name}",
              *issues, sep="\n      " if issues else " ", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
