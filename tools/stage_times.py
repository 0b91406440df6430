"""Summarise stage times from a Spark event log (JSON lines).

    python tools/stage_times.py <event log file or eventlog_v2 folder> [top]

Prints the slowest stages with their duration, task count and name, and
the total per job description (the bench's noop writes name their query
plan in the job description)."""

from __future__ import annotations

import json
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of a plain or zstd event log file, or of every events_* file of
    a rolling event-log folder, in order."""
    import io
    import os

    files = [path]
    if os.path.isdir(path):
        files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(os.path.basename(f).split("_")[1]))
    for f in files:
        if f.endswith(".zstd"):
            import zstandard

            with open(f, "rb") as fh:
                reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            yield from open(f, encoding="utf-8")


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    job_desc = {}
    stage_job = {}
    for line in _lines(path):
        if not line.strip():
            continue
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description", "")
            job_desc[ev["Job ID"]] = desc
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            if info.get("Submission Time") and info.get("Completion Time"):
                stages.append((info["Completion Time"] - info["Submission Time"], info["Stage ID"],
                               info.get("Number of Tasks"), info.get("Stage Name", "")[:80]))
    stages.sort(reverse=True)
    print(f"{'ms':>8} {'stage':>6} {'tasks':>6}  name")
    for ms, sid, n, name in stages[:top]:
        print(f"{ms:8d} {sid:6d} {n:6d}  {name}")
    per_job = defaultdict(int)
    per_desc = defaultdict(int)
    for ms, sid, _, _ in stages:
        job = stage_job.get(sid, -1)
        per_job[job] += ms
        per_desc[job_desc.get(job) or "(no description)"] += ms
    print(f"\n{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.1f} s of stage time in {len(per_job)} jobs")
    print("\nstage time per job description (ms):")
    for desc, ms in sorted(per_desc.items(), key=lambda kv: -kv[1])[:top]:
        print(f"{ms:8d}  {desc}")


if __name__ == "__main__":
    main()
