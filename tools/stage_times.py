"""Summarise stage times from a Spark event log written by
``BENCH_EVENT_LOG=<dir> python bench.py``.

    python tools/stage_times.py <event-log-dir> [top]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def events(root: str):
    files = sorted(p for p in glob.glob(os.path.join(root, "**", "events_*"), recursive=True)
                   if os.path.isfile(p) and not p.endswith(".crc"))
    for f in files:
        for line in _lines(f):
            if '"SparkListenerStageCompleted"' in line:
                yield json.loads(line)["Stage Info"]


def main():
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    stages = []
    for info in events(root):
        ms = info.get("Completion Time", 0) - info.get("Submission Time", 0)
        acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
        stages.append((ms, info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:70],
                       acc.get("internal.metrics.shuffle.write.bytesWritten", 0)))
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.1f} s of stage time")
    print(f"{'ms':>8} {'stage':>6} {'tasks':>6} {'shuffle_w':>10}  name")
    for ms, sid, n, name, sw in stages[:top]:
        print(f"{ms:8d} {sid:6d} {n:6d} {int(sw or 0):10d}  {name}")


if __name__ == "__main__":
    main()
