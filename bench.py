"""Times queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Headline queries run once to warm up and then twice (median). Results go to the ``noop`` sink.
``python bench.py all`` times every registered query once instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tr3_lineage_clusters",
    "tr1_pairwise_snp",
    "ca1_major_minor_allele",
    "ca10_site_quality",
    "ca12_candidate_sites",
    "cv3_double_zscore",
    "cv5_histogram_exact",
    "rc1_local_correlation",
    "rc5_depth_segments",
    "an2_site_to_genes",
    "an4_annotate_snv",
    "mg1_runs_above",
    "mg4_merge_regions",
    "tr9_spectrum_per_subtree",
    "tx1_top_k",
    "as5_n50_l50",
    "ev3_expected_pn",
    "ev9_gene_tail_p",
    "af1_allele_freq",
    "pu1_pileup_counts",
    "rd3_dedup_fragments",
    "st1_mann_whitney",
)


def main() -> None:
    from variascope.catalog import load
    from variascope.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    queries = load()[0]
    everything = len(sys.argv) > 1 and sys.argv[1] == "all"
    names = list(queries) if everything else list(HEADLINE)
    if len(sys.argv) > 2:
        names = [n for n in names if any(n.startswith(p) for p in sys.argv[2:])]
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(1 if everything else 3):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs if everything else runs[1:]), 3)
        if everything or os.environ.get("BENCH_VERBOSE"):
            print(f"{seconds[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total median seconds of the timed queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
