"""Run queries against their SQL twins: python tests/check.py [--sf DIR] [name | @area ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402
from tests.session import session  # noqa: E402


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    areas = {a[1:] for a in argv if a.startswith("@")}
    argv = [a for a in argv if not a.startswith("@")]
    argv += [n for n, fn in queries.items() if fn.__module__.rsplit(".", 1)[-1] in areas]
    bad = 0
    for name in argv or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                n, m, diff, sample = compare(df, con, oracles[name])
                ok = n == m and diff == 0 and n > 0
                print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {n:8d} {time.time() - t:6.1f}s", "" if ok else (m, diff, sample), flush=True)
            else:
                n, ok = len(df.collect()), True
                print(f"rows {name:24s} {n:8d} {time.time() - t:6.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            ok = False
            print(f"ERR  {name:24s} {type(e).__name__}: {str(e)[:600]}", flush=True)
        bad += not ok
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
