"""Run every registered query against its oracle: python tests/run_oracle.py [sf_dir] [names...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from critica.plans import catalog  # noqa: E402
from critica.session import build_session  # noqa: E402
from tests.oracle_util import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(catalog.QUERIES)
spark = build_session("local[8]", 8)
con = duck(sf)
bad = 0
for n in names:
    t = time.time()
    try:
        df = catalog.QUERIES[n](spark, sf)
        if n in catalog.ORACLE:
            probs, rows = compare(df, con, catalog.ORACLE[n])
        else:
            rows = df.count(); probs = ["(no oracle)"]
    except Exception as e:  # report and continue
        probs, rows = [f"ERROR {type(e).__name__}: {str(e)[:600]}"], -1
    ok = not probs or probs == ["(no oracle)"]
    bad += 0 if ok else 1
    print(f"{'OK ' if ok else 'BAD'} {n:32s} rows={rows:6d} {time.time()-t:6.2f}s {'; '.join(probs)}", flush=True)
print("mismatches:", bad)
