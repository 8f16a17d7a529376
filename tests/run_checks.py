"""Command line form of the comparison: ``python tests/run_checks.py [sf] [name-prefix ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, connect  # noqa: E402
from variascope.session import local_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            if name in sql:
                verdict = compare(fn(spark, folder), con, sql[name])
            else:
                n = fn(spark, folder).count()
                verdict = f"rows only: {n}" if n else "EMPTY"
        except Exception as e:
            text = str(e).strip()
            verdict = f"ERROR {type(e).__name__}: {text[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = verdict is None
        bad += not ok
        if not ok or os.environ.get("VERBOSE"):
            print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t0:.1f}s {verdict or ''}", flush=True)
    print("done, not ok:", bad, flush=True)
