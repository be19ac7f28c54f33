"""Run registered queries against their SQL: python tests/check.py SF_DIR [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from casewright.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                verdict = compare(df, con, sql[name]) or f"ok {con.execute(sql[name]).fetchall().__len__()} rows"
            else:
                verdict = f"no SQL, {df.count()} rows"
        except Exception:
            verdict = "FAILED " + traceback.format_exc()[-1500:]
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)
