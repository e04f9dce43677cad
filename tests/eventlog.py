"""What a job read, from the event log of a session of its own."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HEAD = """
import sys
sys.path.insert(0, {root!r})
from emberbasin import build_session
from pyspark.sql import functions as F
spark = build_session("logged", "local[2]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
    spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir={warehouse!r}, spark__checkpoint__dir={shared!r},
    spark__eventLog__enabled="true", spark__eventLog__dir={log!r}, spark__eventLog__compress="false",
    spark__eventLog__rolling__enabled="false", spark__sql__maxMetadataStringLength="2000")
spark.sparkContext.setLogLevel("ERROR")
def step(name):
    spark.sparkContext.setLocalProperty("spark.job.description", name)
"""


def run(script: str, folder: Path) -> tuple[list[str], list[dict]]:
    """Runs a script with a session named ``spark`` and ``step(name)``; its printed lines, and for every file scan that ran
    the step, the scanned table's place, files and rows."""
    log = folder / "events"
    log.mkdir()
    head = HEAD.format(root=str(ROOT), warehouse=str(folder / "warehouse"), shared=str(folder / "shared"), log=str(log))
    done = subprocess.run(
        [sys.executable, "-c", head + script + "\nspark.stop()\n"], capture_output=True, text=True, cwd=folder, timeout=600, env=dict(os.environ)
    )
    assert not done.returncode, done.stderr[-3000:]
    return done.stdout.splitlines(), scans(log)


def scans(log: Path) -> list[dict]:
    nodes: dict[int, dict] = {}
    values: defaultdict[int, int] = defaultdict(int)
    steps: dict[int, str] = {}

    def walk(plan: dict, execution: int) -> None:
        if plan["nodeName"].startswith("Scan "):
            ids = {m["name"]: m["accumulatorId"] for m in plan["metrics"]}
            key = ids["number of output rows"]
            nodes[key] = {"execution": execution, "place": plan.get("metadata", {}).get("Location", ""), "ids": ids}
        for child in plan["children"]:
            walk(child, execution)

    for line in (line for file in log.iterdir() for line in file.open()):
        event = json.loads(line)
        if "sparkPlanInfo" in event:
            walk(event["sparkPlanInfo"], event["executionId"])
        if event["Event"].endswith("SparkListenerSQLExecutionStart"):
            steps[event["executionId"]] = event["description"]
        for update in event.get("accumUpdates", []):
            values[update[0]] += update[1]
        for update in event.get("Task Info", {}).get("Accumulables", []) if event["Event"] == "SparkListenerTaskEnd" else []:
            if str(update.get("Update", "")).isdigit():
                values[update["ID"]] += int(update["Update"])
    found = []
    for node in nodes.values():
        read = {k: values[i] for k, i in node["ids"].items()}
        found.append({"step": steps.get(node["execution"], ""), "place": node["place"], "rows": read["number of output rows"], "files": read.get("number of files read", 0)})
    return found
