"""Shuffle / join report of each registered query's executed plan (cached subtrees skipped).

usage: python tools/plan_report.py [sf_dir] [name-substring ...]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fanlens.plans.registry import load_all  # noqa: E402
from fanlens.session import build_session  # noqa: E402


def walk(node, acc):
    """Count physical operators of a query's own plan (cached relations are leaves)."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return walk(node.executedPlan(), acc)
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
        if name == "TableCacheQueryStageExec":
            acc["cache"] = acc.get("cache", 0) + 1
            return acc
        return walk(node.plan(), acc)
    if name == "InMemoryTableScanExec":
        acc["cache"] = acc.get("cache", 0) + 1
        return acc
    if name == "ShuffleExchangeExec":
        acc.setdefault("exchanges", []).append(str(node.outputPartitioning())[:70])
    acc[name] = acc.get(name, 0) + 1
    kids = node.children()
    for i in range(kids.size()):
        walk(kids.apply(i), acc)
    return acc


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    pats = sys.argv[2:]
    spark = build_session(8, 8)
    reg = load_all()
    for name, q in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        df = q.build(spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # run this QueryExecution itself so the adaptive plan is final
        acc = walk(qe.executedPlan(), {})
        ex = acc.get("exchanges", [])
        print(f"{name:40s} exchanges={len(ex):2d} smj={acc.get('SortMergeJoinExec', 0)} "
              f"bhj={acc.get('BroadcastHashJoinExec', 0)} win={acc.get('WindowExec', 0)} "
              f"sort={acc.get('SortExec', 0)} cached-inputs={acc.get('cache', 0)} | {'; '.join(ex)}", flush=True)


if __name__ == "__main__":
    main()
