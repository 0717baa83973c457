"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, staged

SALTS = 8


def components(links: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(node, comp) of every node in links; comp is the least node reachable. No links give no rows.

    Each round takes the least label among neighbours and then the label's own label, so a chain of n nodes takes about
    log n rounds. Joins on labels are broadcast or salted, since a component's label may be a third of all rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = staged(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), folder)
    labels = staged(both.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("node"), F.least("x", "least").alias("comp")), folder)
    while True:
        heard = sized_join(both, labels.select(F.col("node").alias("y"), F.col("comp").alias("c")), ["y"], salts=SALTS).groupBy("x").agg(F.min("c").alias("c"))
        now = labels.join(heard.withColumnRenamed("x", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("mid"))
        now = staged(now, folder)
        up = now.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        jumped = staged(sized_join(now, up, ["mid"], "left", salts=SALTS).select("node", "was", F.least("mid", "top").alias("comp")), folder)
        changed = jumped.where("was <> comp").limit(1).count()
        labels = jumped.select("node", "comp")
        if not changed:
            return labels
