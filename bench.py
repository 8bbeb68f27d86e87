"""Time the headline queries and print one JSON line.

Each query runs twice: ``queries`` holds the second time, ``first_run`` the one that also pays
for session start and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from phrasemill.operators import flatten  # noqa: E402
from phrasemill.plans.queries import QUERIES, stored  # noqa: E402
from phrasemill.session import local_session, scratch_dir  # noqa: E402

HEADLINES = [
    "convert_examples", "convert_question", "convert_question_documents", "convert_output",
    "quality_report", "quality_score", "quality_report_converted", "term_counts", "term_counts_documents",
    "question_patterns", "structure_issues", "residual_terms", "flatten_steps", "flatten_measures",
    "combine_questions", "render_prompt", "request_rows", "annotate_batches", "resolve_attempts",
    "annotated_dataset", "complete_fields", "phrase_mismatch", "issue_priorities", "before_after",
    "exact_duplicates", "drop_duplicates", "conflicting_duplicates", "clean_subset",
    "read_examples", "write_examples", "incremental_convert",
    "repair_concat_json", "union_datasets", "write_lines", "typed_output",
]
#: Timed on a stored copy with parsed outputs, which is made beforehand.
STORED = {"stored:flatten_steps": flatten.flatten_steps, "stored:flatten_measures": flatten.flatten_measures}


#: Tables of the timed queries that the given folder keeps in a single row group each.
TABLES = ["events", "documents", "conversations", "customer", "part", "nation"]


def split_tables(spark, sf_dir: str, cores: int) -> str:
    """Copies of the tables with as many files as cores, as any large table has; not timed."""
    path = scratch_dir(spark, "bench-tables")
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(cores).write.parquet(f"{path}/{name}.parquet")
    return path


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "phrasemill-bench")
    sf_dir = split_tables(spark, source, int(cores))
    copy = stored(spark, sf_dir)
    timed = {name: QUERIES[name] for name in HEADLINES}
    timed |= {name: lambda spark, sf_dir, fn=fn: fn(copy) for name, fn in STORED.items()}
    first, seconds = {}, {}
    for name, query in timed.items():
        for times in (first, seconds):
            begin = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": Path(source).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
