"""Run registered queries against their DuckDB oracle: python scripts/check_oracle.py [sf_dir] [key ...]"""
import sys, time, json, os
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
from tidewater.session import build_session
from tidewater.plans import QUERIES, ORACLES
from compare import compare, duck

args = sys.argv[1:]
sf_dir = "/root/testdata/sf0.01"
if args and args[0].startswith("/"):
    sf_dir, args = args[0], args[1:]
keys = args or sorted(QUERIES)
spark = build_session()
con = duck(sf_dir)
bad = 0
for key in keys:
    t = time.time()
    try:
        df = QUERIES[key](spark, sf_dir)
        if key in ORACLES:
            r = compare(df, ORACLES[key], con)
        else:
            r = {"rows_only": df.count(), "ok": True}
    except Exception as e:  # noqa: BLE001
        r = {"ok": False, "error": repr(e)[:1500]}
    r["sec"] = round(time.time() - t, 2)
    bad += not r["ok"]
    print(key, json.dumps(r, default=str)[:3000], flush=True)
print("FAILED", bad, "of", len(keys))
