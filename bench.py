"""Times every query at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and once for its time; the result is read in full through
the ``noop`` sink, so the driver gathers nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from opslens.plans import queries, render
    from opslens.session import build_session
    from opslens.sources import access, dblog

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: q for name, q in queries.QUERIES.items() if not ONLY or name in ONLY}
    times = {}
    for name, query in chosen.items():
        run(query, spark)
        times[name] = round(run(query, spark), 3)

    # The two line parsers dominate, so their rate is reported beside the query times.
    rates = {}
    if not ONLY:
        n = render.table(spark, SF_DIR, "events").count()
        parsers = {
            "db_log_rows_per_sec": lambda s, d: dblog.with_shapes(dblog.with_predicates(dblog.parse_dblog(render.dblog(s, d)))),
            "access_log_rows_per_sec": lambda s, d: access.parse_access(render.access(s, d)),
        }
        for name, parser in parsers.items():
            run(parser, spark)
            rates[name] = round(n / run(parser, spark))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "rates": rates}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
