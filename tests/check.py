"""Compare registered queries with their SQL: ``python tests/check.py [folder] [name or prefix ...]``."""

import signal
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from colloquy.session import local_session  # noqa: E402
from tests.oracle import compare  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = oracle_sql(), []

    def late(*_):
        raise TimeoutError("over 90 s")

    signal.signal(signal.SIGALRM, late)
    for name, fn in queries().items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        signal.alarm(90)
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = compare(df, sqls[name], sf)
                n = df.count() if not diff else "?"
            else:
                n, diff = len(df.collect()), []
        except Exception as e:
            diff, n = [f"{type(e).__name__}: {str(e)[:1500]}" if "-v" not in want else traceback.format_exc()], "?"
        signal.alarm(0)
        flag = "FAIL" if diff else ("ok  " if name in sqls else "rows")
        print(f"{flag} {name:28s} rows={n} {time.time() - t:.1f}s", flush=True)
        for d in diff:
            print("     ", d[:1800])
        if diff or n == 0:
            bad.append(name)
    print("failing or empty:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
