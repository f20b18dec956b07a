"""Run registered queries against their SQL: ``run_checks.py [folder] [name ...]``."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import differences, duck  # noqa: E402
from turnwise.plans.catalog import RUNS, SQL  # noqa: E402
from turnwise.session import local_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark, con = local_session(), duck(folder)
for name, run in RUNS.items():
    if names and not any(name.startswith(n) for n in names):
        continue
    start = time.time()
    try:
        df = run(spark, folder)
        if name in SQL:
            problem = differences(df, con, SQL[name])
        else:
            problem = f"(rows only: {df.count()})"
    except Exception as e:  # report and go on
        problem = f"{type(e).__name__}: {str(e)[:500]}"
    n = "" if problem else "ok"
    print(f"{name:32s} {time.time() - start:6.1f}s {n}{problem or ''}"[:2200], flush=True)
