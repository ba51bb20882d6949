"""Connected components of a link table by hooking, pointer jumping and contraction.

Every step is a join or a grouped minimum over tables written to the shared folder, so
no component, however large, meets in one task and nothing but counts reaches the
driver. Grouped minima are combined before the shuffle; the joins read written tables on
both sides, so adaptive execution can split a hot root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import keep


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``: the smallest node reachable, per linked node.

    Nodes without a link are not listed. Loops and repeated links are allowed; null ends
    are dropped.
    """
    edges = keep(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.df.limit(1).count():
        both = edges.df.select("a", "b").union(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                     .select("node", F.least("node", "low").alias("root")), "roots")
        moving = True
        while moving:
            up = roots.df.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = keep(roots.df.join(up, "root").select("node", "root", "above"), "jumped")
            moving = jumped.df.where("above < root").limit(1).count() > 0
            roots.drop()
            if moving:
                roots = keep(jumped.df.select("node", F.col("above").alias("root")), "roots")
                jumped.drop()
            else:
                roots = jumped
        flat = roots.df.select("node", "root")
        if labels is None:
            fresh = keep(flat.select("node", F.col("root").alias("component")), "labels")
        else:
            up = flat.select(F.col("node").alias("component"), F.col("root").alias("above"))
            fresh = keep(labels.df.join(up, "component", "left")
                         .select("node", F.coalesce("above", "component").alias("component")), "labels")
            labels.drop()
        labels = fresh
        to_a = flat.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = flat.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = keep(edges.df.join(to_a, "a").join(to_b, "b").where("ra <> rb")
                    .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        edges.drop()
        roots.drop()
        edges = rest
    out = labels.df if labels else edges.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out
