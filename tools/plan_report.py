"""Summarise the physical plan of every registered query (operator counts) as markdown.

python tools/plan_report.py [sf_dir] > PLANS.md
"""

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit", "Window",
         "HashAggregate", "SortAggregate", "TakeOrderedAndProject", "BatchEvalPython",
         "ArrowEvalPython", "FlatMapGroupsInPandas"]
# Iterative, stored and streaming queries run actions while they are built.
SKIP = ("payout_admission", "rate_limit_", "progress_stream", "progress_upsert_stored", "user_purge_", "chain_", "sales_page_indexed",
        "user_search_indexed")
# Queries whose formatted plan tree is printed in full.
SHOWN = ["sales_daily_range", "session_retention", "promo_code_usage"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from acadia.plans import QUERIES
    from acadia.session import build_session
    spark = build_session()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="acadia-plans-"))
    print("# PLANS\n")
    print(f"Physical-plan node counts per registered query (initial AQE plan, `{sf_dir}`),")
    print("from `tools/plan_report.py`. `Exchange` counts shuffles, `BroadcastExchange` broadcasts; partial and")
    print("final aggregation each count as one `HashAggregate`/`SortAggregate`;")
    print("`WindowGroupLimit` appears twice when the rank limit runs before and after the shuffle.\n")
    print("| query | " + " | ".join(n for n in NODES if "Python" not in n and "Pandas" not in n)
          + " | Python nodes |")
    print("|---" * (len(NODES) - 1) + "|---|")
    for name in sorted(QUERIES):
        if name.startswith(SKIP):
            continue
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        c = {n: len(re.findall(r"\b" + n + r"\b", plan)) for n in NODES}
        py = c["BatchEvalPython"] + c["ArrowEvalPython"] + c["FlatMapGroupsInPandas"]
        cells = [str(c[n] or "") for n in NODES if "Python" not in n and "Pandas" not in n]
        print(f"| {name} | " + " | ".join(cells) + f" | {py or ''} |")
    print("\nNot listed, as they run actions while they are built (rounds, streams, stored tables; see README.md): "
          + ", ".join(f"`{n}`" for n in sorted(QUERIES) if n.startswith(SKIP)) + ".")
    for name in SHOWN:
        tree = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().treeString()
        print(f"\n## {name}\n\n```\n{tree.rstrip()}\n```")


if __name__ == "__main__":
    main()
