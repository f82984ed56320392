"""Plan audit: the physical plan of every registered query as it would be chosen at scale.

Automatic broadcast is switched off (large tables are never broadcast by size
estimate); the only broadcasts left are the ones the code makes after a size
check. Writes PLANS.md:  python tests/plan_audit.py /root/testdata/sf0.01
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from fundscope.plans.workload import driver_tables  # noqa: E402
from fundscope.session import local_session  # noqa: E402


def summarize(plan: str) -> dict:
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    return {
        "hash": ex.count("hashpartitioning"),
        "range": ex.count("rangepartitioning"),
        "single": ex.count("SinglePartition"),
        "bcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "bnlj_or_cartesian": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "window": len(re.findall(r"\bWindow \[", plan)),
        "wgl": plan.count("WindowGroupLimit"),
        "bucketed_scans": plan.count("Bucketed: true"),
        "pruned_scans": len(re.findall(r"PartitionFilters: \[[^\]]", plan)),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]", plan)),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out = argv[2] if len(argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                                     "PLANS.md")
    spark = local_session(8)
    driver_tables(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    rows = []
    for name, f in E.queries().items():
        if name == "pipeline" or name.startswith("op"):  # these run jobs while they are built
            continue
        df = f(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((name, summarize(plan)))
    cols = list(rows[0][1])
    lines = ["# Plan audit", "",
             "Physical plans of the registered queries with automatic broadcast switched off, i.e. the",
             "strategy Spark picks when every table is large. Counts per query: shuffles by kind (`hash`,",
             "`range` for final sorts, `single` = a final exchange of partial-aggregate rows or other bounded",
             "data into one partition), `bcast` = broadcasts of bounded data asked for by the code (the",
             "per-partition offsets of the row numbering), join strategies, windows",
             "(`wgl` = WindowGroupLimit), scans of the bucketed project/pledge tables, scans with partition",
             "pruning and with pushed filters. `bnlj_or_cartesian` must be 0.",
             "Regenerate: `python tests/plan_audit.py /root/testdata/sf0.01`.", "",
             "| query | " + " | ".join(cols) + " |", "| --- | " + " | ".join("---" for _ in cols) + " |"]
    for name, s in rows:
        lines.append(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    from fundscope.operators import analysis as A
    from fundscope.operators import cleaning as CL
    from fundscope.operators import views as V
    t = driver_tables(spark, sf_dir)
    shown = [("enrichment (project x pledge x lookup)", CL.enrich(t.project_info, t.pledge, t.country)),
             ("top_categories_per_country", A.top_categories_per_country(t.enriched)),
             ("success_rate_full", V.success_rate_full(t.enriched))]
    for title, df in shown:
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: <store>", plan)
        plan = re.sub(r"#\d+L?", "", plan)
        lines += ["", f"## Physical plan: {title}", "", "```", plan.rstrip(), "```"]
    open(out, "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main(sys.argv)
