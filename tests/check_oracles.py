"""Run registered queries against their SQL oracles: python tests/check_oracles.py [sf_dir] [name...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck_connection  # noqa: E402


def main(argv: list[str]) -> int:
    import __spark_entry__ as E
    from riskframe.session import get_spark
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark()
    con = duck_connection(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                n = df.count()
                problems = [] if n >= 0 else ["negative count"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        tag = "" if name in sqls else " (no oracle)"
        print(f"{status} {name}{tag} {time.time() - t:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
