"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandcall.catalog.queries import REGISTRY  # noqa: E402
from strandcall.session import build_session  # noqa: E402

HEADLINE = (
    "ternary_labels",
    "label_quality",
    "labelled_samples",
    "exclude_used",
    "load_report",
    "gene_lists",
    "genes_by_pert",
    "accuracy_rollup",
    "class_report",
    "prediction_distribution",
    "report_lines",
    "auroc_dif",
    "auroc_by_cell",
    "auroc_runs",
    "sample_exact",
    "train_val_split",
    "batches",
    "extract_think_answer",
    "accepted_examples",
    "rejection_funnel",
    "critic_prompts",
    "context_prompts",
    "sft_text_cot",
    "stream_results",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["split_filter"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
