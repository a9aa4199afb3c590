"""Revenue concentration: Pareto over an entity, n-tile shares.

Ranking runs per entity (categories, sellers — unbounded in general), so it
uses the distributed exact rank of :mod:`tidemark.operators.primitives`;
only the final per-tile rows (≤ n) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money, pct, ratio, revenue, round_half
from tidemark.operators.primitives import RUNNING, ntile_desc, rank_desc, share_over_all


def entity_revenue(items: DataFrame, entity: str, products: DataFrame | None = None,
                   alias: str | None = None) -> DataFrame:
    """Revenue per entity (item grain); the entity may live on ``products``."""
    name = alias or entity
    if products is None:
        return items.groupBy(F.col(entity).alias(name)).agg(F.sum(revenue()).alias("revenue"))
    # one row a product before the join: partial sums, no item row is exchanged as such
    per = items.groupBy("product_id").agg(F.sum(revenue()).alias("_rev"))
    return (per.join(products.select("product_id", entity), "product_id")
            .groupBy(F.col(entity).alias(name)).agg(F.sum("_rev").alias("revenue")))


def _pareto_ranked(items, products, entity, alias, **kw):
    per = entity_revenue(items, entity, products, alias)
    return rank_desc(per, "revenue", alias, **kw)


def pareto(items: DataFrame, products: DataFrame, entity: str = "product_category_name",
           alias: str = "product_category", **kw) -> DataFrame:
    """entity, revenue, running total (revenue desc, entity asc), cumulative %.

    A NULL entity is a group of its own, as in the source query."""
    ranked, _ = _pareto_ranked(items, products, entity, alias, **kw)
    return ranked.select(
        alias, money("revenue").alias("revenue"), money(RUNNING).alias("running_total"),
        round_half(ratio(RUNNING, "_total") * 100, 2).alias("cumulative_pct"),
    ).orderBy(F.col("revenue").desc_nulls_last(), F.col(alias).asc_nulls_last())


def pareto_threshold(items: DataFrame, products: DataFrame, p: float = 80,
                     entity: str = "product_category_name", **kw) -> DataFrame:
    """How many entities (largest first) it takes to reach p% of revenue:
    count of rows whose cumulative share *before* the row is below p
    (exact decimal comparison)."""
    ranked, _ = _pareto_ranked(items, products, entity, "_entity", **kw)
    before = (F.col(RUNNING) - F.col("revenue")) * 100 < F.lit(p) * F.col("_total")
    return ranked.agg(F.sum(before.cast("bigint")).alias("entities_needed"),
                      F.count(F.lit(1)).alias("entities_total")).withColumn(
        "pct_of_entities", pct("entities_needed", "entities_total"))


def ntile_share(items: DataFrame, entity: str = "seller_id", n: int = 10,
                tile: str = "decile", count_name: str = "sellers_in_decile",
                revenue_name: str = "decile_revenue", **kw) -> DataFrame:
    """n-tiles of entities by revenue desc: entities, revenue, % of total per tile."""
    per = entity_revenue(items, entity)
    tiled = ntile_desc(per, "revenue", entity, n, alias=tile, **kw)
    agg = tiled.groupBy(tile).agg(F.count(F.lit(1)).alias(count_name),
                                  F.sum("revenue").alias("_rev"))
    return agg.select(tile, count_name, money("_rev").alias(revenue_name),
                      round_half(ratio("_rev", share_over_all("_rev")) * 100, 2).alias("pct_of_total")
                      ).orderBy(tile)


def top_tile_share(tiles: DataFrame, tile: str = "decile",
                   revenue_name: str = "decile_revenue") -> DataFrame:
    """Cumulative revenue share from the top tile down (≤ n rows)."""
    w = Window.orderBy(tile).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tiles.select(tile, round_half(
        ratio(F.sum(revenue_name).over(w), share_over_all(revenue_name)) * 100, 2).alias("cumulative_pct")
    ).orderBy(tile)
