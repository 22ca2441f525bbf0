"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line.  The figure per query is
the median of three warm runs, each of which builds the plan anew and executes
it in full through the ``noop`` sink: plan construction, and whatever jobs it
starts, count.  ``plan_build_sec`` says how much of that was construction.
``scan_404_rules`` scans the same files with a catalogue of 404 line rules; it is
reported beside the headline queries, not in their total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.plans.queries import QUERIES  # noqa: E402
from strata.session import get_spark  # noqa: E402

HEADLINE = ["scan_line_rules", "dedupe_findings", "attribute_issues", "health_score",
            "commit_timeline", "rate_limit", "executive_summary", "blame_authors", "scan_404_rules"]


def scan_404_rules(spark, sf_dir):
    """A catalogue of the size in use: five fixture rules and word rules over the scanned languages."""
    from strata import fixtures as FX
    from strata import schemas as S
    from strata.functions.languages import scannable_filter
    from strata.operators.scan import scan_line_rules
    kinds = ["secrets", "injection", "best_practice"]
    spec = list(FX.FIXTURE_RULES[:5]) + [
        (f"BENCH-{i}", (["any", *S.SCANNABLE_LANGUAGES])[i % (len(S.SCANNABLE_LANGUAGES) + 1)], kinds[i % 3], "low",
         rf"\bcall_{i}\s*\(\s*[\"'][A-Za-z]+|{'abcdefgh'[i % 8]}{i}\b", "regex_line", True) for i in range(399)]
    return scan_line_rules(scannable_filter(FX.files(spark, sf_dir)), FX.rules(spark, spec))


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # JVM warm-up (class loading, code generation) so the first plan build is not charged for it
    spark.range(100_000).selectExpr("sum(id)", "count(distinct id % 7)").collect()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    timings, builds = {}, {}
    runnable = {name: (lambda s, d, n=name: QUERIES[n](s, d)) for name in names if name in QUERIES}
    if "scan_404_rules" in names:
        runnable["scan_404_rules"] = scan_404_rules
    for name, query in runnable.items():
        _run(query(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = query(spark, sf_dir)
            t1 = time.perf_counter()
            _run(df)  # files are re-read, nothing is cached
            samples.append((time.perf_counter() - t0, t1 - t0))
        samples.sort()
        timings[name], builds[name] = (round(x, 3) for x in samples[len(samples) // 2])
    extra = {}
    if names:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        from strata import fixtures as FX
        from strata.functions.languages import scannable_filter
        from strata.operators.scan import collect_rules
        from pyspark.sql import functions as F
        files = scannable_filter(FX.files(spark, sf_dir))
        n_lines = files.agg(F.sum("lines")).first()[0] or 0
        n_rules = len(collect_rules(FX.rules(spark)))
        if timings.get("scan_404_rules"):
            extra["scan_404_rules_lines_x_rules_per_sec"] = round(n_lines * 404 / timings["scan_404_rules"], 1)
        if "scan_line_rules" in timings and timings["scan_line_rules"] > 0:
            extra["scan_line_rules_lines_x_rules_per_sec"] = round(n_lines * n_rules / timings["scan_line_rules"], 1)
        n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
        if "rate_limit" in timings and timings["rate_limit"] > 0:
            extra["rate_limit_events_per_sec"] = round(n_events / timings["rate_limit"], 1)
        extra["documents"] = docs.count()
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "headline_total_sec", "value": round(sum(t for n, t in timings.items() if n != "scan_404_rules"), 3), "unit": "sec",
           "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "runs": runs, "spark": spark.version,
           "plan_build_sec": builds, **extra}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
