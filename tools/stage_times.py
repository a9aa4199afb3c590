"""Per-job and per-stage wall times from a Spark event log.

    BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) BENCH_QUERIES=monthly_growth python bench.py
    python tools/stage_times.py <that folder> [--top 20]

Reads rolling (``eventlog_v2_*``) or single-file logs, zstd-compressed or
plain, and prints the slowest stages with their task counts and names.
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) or \
        [p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p)]
    for f in files:
        with open(f, "rb") as fh:
            head = fh.read(4)
            fh.seek(0)
            if head == b"\x28\xb5\x2f\xfd":  # zstd frame
                import zstandard
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            yield from stream


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("log_dir")
    ap.add_argument("--top", type=int, default=20)
    args = ap.parse_args()
    stages, jobs = {}, {}
    for line in _lines(args.log_dir):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Completion Time", 0) - si.get("Submission Time", 0),
                                      si["Number of Tasks"], si["Stage Name"][:70])
        elif ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    total = sum((c or s) - s for s, c in jobs.values())
    print(f"{len(jobs)} jobs, {sum(1 for _ in stages)} stages, job wall time {total / 1000:.2f}s")
    for sid, (ms, tasks, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:args.top]:
        print(f"stage {sid:5d} {ms / 1000:7.2f}s {tasks:6d} tasks  {name}")


if __name__ == "__main__":
    main()
