"""Connected components of links: each task roots the trees of its links; what does not fit one task goes
on by rounds of large and small stars on stored tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fundscope.llm.common import store

#: Links that meet in a task at most.
AT_ONCE = 1 << 16


def _rooted(names: tuple[str, str], roots: bool):
    """Each node of a task's links with the smallest node of its component there; ``roots``: these too."""
    def run(batches):
        above: dict = {}
        kind = None

        def root(x):
            top = x
            while above[top] != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for b in batches:
            kind = b.column(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                above.setdefault(x, x), above.setdefault(y, y)
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        nodes = [x for x, y in above.items() if roots or x != y]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(list(map(root, nodes)), kind)], names=list(names))
    return run


def _in_tasks(links: DataFrame, names: tuple[str, str], roots: bool, tasks: int) -> DataFrame:
    out = StructType([StructField(n, f.dataType) for n, f in zip(names, links.schema.fields)])
    return links.repartition(tasks).mapInArrow(_rooted(names, roots), out)


def thin(links: DataFrame, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """Links with the same components: of about ``at_once`` that meet in a task, one is left for each node
    but the smallest of its component, to that one. So paths don't outlive a task."""
    links = store(links.select("a", "b"), f"{name}-found")
    return _in_tasks(links, ("a", "b"), False, max(1, -(-links.count() // at_once)))


def _with_least(ends: DataFrame) -> DataFrame:
    """``ends`` (a, b) with the smallest b of each a."""
    least = ends.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("least"))
    return ends.join(least, F.col("a") == F.col("__a")).drop("__a")


def components(links: DataFrame, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """``links``: a, b (any ordered type, not null). Returns node, comp: the smallest node of each
    node's component. Nodes without links are left out; no links give no rows.

    Tasks root the links they get, about ``at_once`` each, as long as that halves them. If they fit one
    task, its roots are the result. Else rounds follow: all larger neighbours of a node are linked to the smallest
    around it, then it and its smaller neighbours are (large and small stars), which shortens a path of any
    numbering by a factor. Nothing is collected but two counts a round.
    """
    links, left = links.select("a", "b"), links.count()
    while True:
        tasks, before = max(1, -(-left // at_once)), left
        rooted = store(_in_tasks(links, ("node", "comp"), True, tasks), f"{name}-rooted")
        if tasks == 1:
            return rooted
        links, left = rooted.select(F.col("node").alias("a"), F.col("comp").alias("b")), rooted.count()
        if left > max(at_once, before // 2):
            break
    links, nodes = links.where("a <> b"), store(rooted.select("node").distinct(), f"{name}-nodes")
    while True:
        ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = store(_with_least(ends).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), f"{name}-large")
        small = _with_least(large)
        links = store(small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            small.where("b = least").select("a", "b")).distinct(), f"{name}-small")
        # done: one link for each node, and none leads on
        twice = links.groupBy("a").agg(F.count("b").alias("n")).where("n > 1")
        on = links.join(links.select(F.col("b").alias("x")), F.col("a") == F.col("x"), "left_semi")
        if not twice.limit(1).count() and not on.limit(1).count():
            return store(nodes.join(links, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("comp")), f"{name}-labels")
