"""Execute catalog queries and summarise their final (AQE) physical plans.

Usage: python tools/plan_summary.py [sf_dir] [name ...] [--full]
"""

from __future__ import annotations

import collections
import re
import sys

sys.path.insert(0, ".")

from seatwise.plans.catalog import queries  # noqa: E402
from seatwise.session import local_session  # noqa: E402

OPS = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "Window", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Sort ", "ReusedExchange", "Generate",
       "ArrowEvalPython", "BatchEvalPython", "AQEShuffleRead", "Subquery")


def summarise(df, full: bool = False) -> str:
    df._jdf.queryExecution().toRdd().count()  # runs this very plan, so that it is the final one
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    counts = collections.Counter()
    for op in OPS:
        counts[op.strip()] = plan.count(op)
    scans = sorted(set(re.findall(r"ReadSchema: struct<[^>]*>", formatted)))
    pushed = sorted(set(re.findall(r"PushedFilters: \[[^\n]*\]", formatted)))
    out = [" ".join(f"{k}={v}" for k, v in counts.items() if v)]
    out += ["  " + s for s in scans] + ["  " + p for p in pushed if p != "PushedFilters: []"]
    if full:
        out.append(plan)
    return "\n".join(out)


def scans(df) -> collections.Counter:
    """How often the final plan of ``df`` reads each file; exchanges and subqueries that are reused count once."""
    return _walked(df)[0]


def files_read(df) -> collections.Counter:
    """How many files the final plan of ``df`` opens in each folder."""
    return _walked(df)[1]


def _walked(df) -> tuple[collections.Counter, collections.Counter]:
    df._jdf.queryExecution().toRdd().count()
    out: collections.Counter = collections.Counter()
    files: collections.Counter = collections.Counter()

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind in ("ReusedExchangeExec", "ReusedSubqueryExec"):
            return
        if kind == "FileSourceScanExec":
            place = node.metadata().get("Location").get()
            out.update(re.findall(r"([^/\],]+)\.parquet", place))
            files[re.sub(r".*/([^/\]]+)\].*", r"\1", place)] += node.metrics().get("numFiles").get().value()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        inner = [node.plan()] if kind.endswith("QueryStageExec") else []
        for more in (node.children(), node.subqueries()):
            inner += [more.apply(i) for i in range(more.size())]
        for child in inner:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return out, files


def markdown(spark, sf: str, names: list[str]) -> str:
    qs = queries()
    cols = ["Exchange hashpartitioning", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
            "Window", "HashAggregate", "ReusedExchange"]
    lines = ["| query | hash shuffles | broadcasts | sort-merge joins | broadcast joins | windows | hash aggs "
             "| reused exchanges | pushed scan filters |",
             "| --- | " + " | ".join("---" for _ in cols) + " | --- |"]
    for n in names:
        df = qs[n](spark, sf)
        df._jdf.queryExecution().toRdd().count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\n]*)\]", formatted) if p})
        pushed += sorted({"partition: " + re.sub(r"#\d+", "", p)
                          for p in re.findall(r"PartitionFilters: \[([^\n]*)\]", formatted) if p})
        lines.append(f"| `{n}` | " + " | ".join(str(plan.count(c)) for c in cols)
                     + " | " + ("; ".join(pushed) or "—").replace("|", "/") + " |")
    return "\n".join(lines)


if __name__ == "__main__":
    if "--markdown" in sys.argv:
        rest = [a for a in sys.argv[1:] if a != "--markdown"]
        sf = rest[0] if rest else "/root/testdata/sf0.1"
        spark = local_session(8)
        print(markdown(spark, sf, rest[1:] or list(queries())))
        sys.exit(0)
    args = [a for a in sys.argv[1:] if a != "--full"]
    sf = args[0] if args else "/root/testdata/sf0.1"
    names = args[1:] or list(queries())
    spark = local_session(8)
    qs = queries()
    for n in names:
        print(f"== {n}\n{summarise(qs[n](spark, sf), '--full' in sys.argv)}", flush=True)
