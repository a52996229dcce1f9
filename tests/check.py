"""python tests/check.py [sf] [name ...]: compares registered queries with their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle

import __spark_entry__ as entry
from laminaflow.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
wanted = sys.argv[2:]
extra = {}
if os.environ.get("HOT"):
    extra["spark__laminaflow__hotRows"] = os.environ["HOT"]
spark = build_session(master=f"local[{os.environ.get('CPUS', '8')}]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                      spark__driver__memory="12g", **extra)
spark.sparkContext.setLogLevel("ERROR")
sf_dir = f"/root/testdata/sf{sf}"
con = oracle.connect(sf_dir)
qs, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in qs.items():
    if wanted and name not in wanted:
        continue
    t = time.time()
    try:
        if name in sqls:
            ok, msg = oracle.compare(spark, con, fn, sqls[name], sf_dir)
        else:
            ok, msg = True, f"{fn(spark, sf_dir).count()} rows (no SQL)"
    except Exception as exc:
        ok, msg = False, "".join(traceback.format_exception_only(exc))[:1500]
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
print(f"{bad} failed of {len(wanted) or len(qs)}")
