"""Run every registered query against its oracle: python tests/run_oracle.py [sf_dir] [names...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from cohortshare.session import local_session  # noqa: E402
from oracle import compare  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
qs, ors = E.queries(), E.oracle_sql()
bad = 0
for n, fn in qs.items():
    if names and n not in names:
        continue
    t = time.time()
    if n not in ors:
        c = fn(spark, sf).count()
        print(f"{n:28s} rows-only {c} rows {time.time()-t:.1f}s", flush=True)
        continue
    try:
        probs, a, b = compare(spark, n, fn, ors[n], sf)
    except Exception as e:  # noqa: BLE001
        probs, a, b = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1, -1
    bad += bool(probs)
    print(f"{n:28s} {'OK ' if not probs else 'BAD'} spark={a} duck={b} {time.time()-t:.1f}s {'; '.join(probs)}", flush=True)
print("mismatches:", bad)
