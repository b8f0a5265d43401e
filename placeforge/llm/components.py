"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    A round passes the smallest label over all links and then follows labels twice; it reads
    tables of the round before from the shared folder.  Only one count a round comes to the
    driver.  Self links and repeated links do no harm; an empty table gives an empty table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("l").alias("m"))
        passed = labels.join(heard, labels.node == heard.a, "left").select("node", "l", F.least("l", F.coalesce("m", "l")).alias("p"))
        to = labels.select(F.col("node").alias("via"), F.col("l").alias("onward"))
        jumped = passed.join(to, passed.p == to.via, "left").select("node", F.least("p", F.coalesce("onward", "p")).alias("n"), "l")
        step = materialize(jumped.select("node", F.col("n").alias("l"), (F.col("n") != F.col("l")).alias("moved")))
        moved = step.filter("moved").limit(1).count()
        discard(labels)
        labels = step
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    discard(both)
    return labels.select("node", F.col("l").alias("component"))
