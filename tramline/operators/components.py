"""Connected components of an edge table, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root for every node of an edge; root is the component's smallest node.

    Each round, a node takes the smallest label around it (edges joined with labels, pre-aggregated before the
    shuffle), gives it to its own old label too, so that whole trees join, then takes its label's label: the rounds
    grow with the logarithm of a chain's length (17 for 100,000 nodes), and they end as labels only fall. Both sides of
    every join are written tables, so that adaptive execution can split the rows of a hub. Edges with a null end are
    ignored; repeated edges count once; no edges give no rows.
    """
    ends = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    both = cut(edges.select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u is not null and v is not null").distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    none = F.lit(None).cast(labels.schema["root"].dataType)
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "root"), "u").select(F.col("v").alias("node"), "root", none.alias("own"))
        near = near.unionByName(labels.withColumn("own", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("own"))
        near = cut(near)
        hooks = near.select(F.col("own").alias("node"), "root", none.alias("own"))
        near = cut(near.unionByName(hooks).groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("own")))
        far = near.join(near.select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
        far = cut(far.select("node", F.least("root", "up").alias("root"), "own"))
        labels = far.drop("own")
        if far.filter("root <> own").isEmpty():
            return labels
