"""Headline queries at one scale factor; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "books_newest_first",
    "stage_board",
    "voice_resolution",
    "text_chapters",
    "html_chapters",
    "language_detection",
    "layout_chapters",
    "normalize_en",
    "normalize_de",
    "chunk_plan",
    "segment_keys",
    "work_list",
    "timeline",
    "chapter_markers",
    "part_split",
    "srt_documents",
    "descriptions",
    "merged_results",
    "job_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from lectern.queries import all_queries
    from lectern.session import build_session

    spark = build_session(
        "lectern-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up, not measured
    seconds = {}
    for name in wanted:
        begun = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
