"""Run registered queries beside their SQL on DuckDB and compare the rows."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def oracle_rows(folder, sql):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else value + 0.0
        if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
            return value.replace(tzinfo=None)
        return value

    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def check(spark, folder, query, sql):
    """None when equal, else a short text about the difference."""
    df = query(spark, folder)
    names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    want_names, want = canonical(*oracle_rows(folder, sql))
    if names != want_names:
        return f"columns {names} / {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}: {got[:2]} / {want[:2]}"
    wrong = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}" if wrong else None


def main():
    import __spark_entry__ as entry
    from bench import session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = session(8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, folder, query, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
