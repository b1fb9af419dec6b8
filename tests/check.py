"""python tests/check.py [sf] [name ...]: compare queries with their oracles."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import compare, connect  # noqa: E402

from factloom.session import build_session  # noqa: E402

if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        master=os.environ.get("CHECK_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else ("" if df.count() else "no rows") + " (rows only)"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem.strip()) and "(rows only)" not in problem
        print(f"{name:24s} {time.time() - t:6.1f}s {problem or 'ok'}", flush=True)
    print("bad:", bad)
