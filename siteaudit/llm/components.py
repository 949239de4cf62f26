"""Connected components of a link table by hooking and pointer jumping.

Each round hooks every root to its smallest neighbour, shortens the hooks by doubling and
rewrites the links between roots, so links shrink from round to round. Tables are cut in the
shared folder; nothing but one-row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.plans.session import cut


def _flat(parents: DataFrame) -> DataFrame:
    """Parents that are roots themselves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = cut(
            parents.join(up, "parent", "left").select(
                "node",
                F.coalesce("above", "parent").alias("parent"),
                F.coalesce(F.col("above") != F.col("parent"), F.lit(False)).alias("moved"),
            )
        )
        moved = parents.where("moved").limit(1).count()
        parents = parents.drop("moved")
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest of its component.

    Nodes without links have no row. Null ends, loops and repeated links are harmless.
    """
    links = cut(
        links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    roots = None
    while links.limit(1).count():
        hooks = (
            links.select(F.col("v").alias("node"), F.col("u").alias("other"))
            .unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("other")))
            .groupBy("node")
            .agg(F.min("other").alias("parent"))
        )
        parents = _flat(cut(hooks))
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            up = parents.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            roots = cut(
                roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            )
        a = parents.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        b = parents.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        links = cut(
            links.join(a, "u").join(b, "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
    if roots is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
