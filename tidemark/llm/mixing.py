"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``MOST`` times
its own size; what is over is shared out again by weight.  The ratio of target
and size says how many whole copies every document of the source gets for
certain; the words still missing come from a sample without replacement whose
size is fixed in words.  Each document draws ``u`` from a digest of its
identifier, and documents are ranked by their random odds over their inclusion
odds, (u / (1 - u)) / (p / (1 - p)); the first of the ranking that fit are
taken.  ``p`` is the source's missing share, or, with ``inclusion``, that
share scaled by the column (unequal probabilities inside a source).

No source is ranked in one task: ``q / (1 + q)`` of the ranking key falls into
strips of about sqrt(documents) rows (``STRIP`` at least), of which all before
the one that holds the missing share's edge are taken whole, and only that
strip's rows are sorted.
Inside it, documents that would exceed the target are passed over in favour of
smaller ones further on (``PASSES`` times).  Where documents that fit are left
by then, in this strip or after it, strips are summed and an edge is searched
again over those alone, until none fits.  The smallest document that is left in
the first edge's strip is taken at the end if that comes nearer.

Defined results: NULL text has no words and is never sampled; a NULL source is
a source of its own, after all others; a source without words has target 0;
rows that share an identifier are ranked by size; ties in size and identifier
are equal rows, of which any may be taken; an empty table gives an empty
result; other columns can be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import clear_name, word_array
from tidemark.session import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
PASSES = 4
STRIP = 256  # documents in a strip, at least; sqrt(documents) in sources of over 65,536
SEED = 41


def source_targets(docs: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS,
                   most: int = MOST) -> DataFrame:
    """``source, n_docs, source_size, target``; one row a source.

    ``min(level * weight, most * size)`` with the level at which the targets
    sum up to all words: sources fill up in the order of their room per
    weight, so running sums over that order find it."""
    per = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).cast("long").alias("source_size"))
    # windows over one row a source
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
                         / F.sum("weight").over(after))
    # the first source that its level doesn't fill sets the level of all after it
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(
        (F.col("room") / F.col("weight")).alias("order"), F.col("level")))).over(every)
    level = held["level"]
    target = F.when(level.isNull(), F.col("room")).otherwise(F.least(F.col("room"), level * F.col("weight")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """In (0, 1), from 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _edges(ranked: DataFrame, missing: str) -> DataFrame:
    """``of, edge, before``: the strip of each source where its missing words
    end, and the words before it; no row if all of them fit."""
    strips = ranked.groupBy("source", "strip").agg(F.sum("size").alias("words"), F.first(missing).alias("missing"))
    upto = Window.partitionBy("source").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    return (strips.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("words") > F.col("missing")))
            .groupBy(F.col("source").alias("of")).agg(F.min(F.struct("strip", "before")).alias("e"))
            .select("of", F.col("e.strip").alias("edge"), F.col("e.before").alias("before")))


def _fitted(strip: DataFrame) -> DataFrame:
    """One strip a source, with ``picked`` and the words ``left`` of its ``room``."""
    near = strip.withColumn("picked", F.lit(0).cast("long")).withColumn("left", F.col("room"))
    for _ in range(PASSES):
        order = Window.partitionBy("source").orderBy("q", "doc_id", "size")
        open_ = (F.col("picked") == 0) & (F.col("size") <= F.col("left"))
        need = F.sum(F.when(open_, F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        near = near.withColumn("picked", F.when(open_ & (need <= F.col("left")), 1).otherwise(F.col("picked")))
        used = F.sum(F.when(F.col("picked") == 1, F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
        near = near.withColumn("left", F.col("room") - used)
    return near


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", carry: tuple[str, ...] = (),
        weights=WEIGHTS, most: int = MOST, inclusion: str | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size,
    target, copies, taken``, and the ``carry`` columns in a struct ``row``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.size(word_array(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("size"),
        (F.col(inclusion).cast("double") if inclusion else F.lit(1.0)).alias("inclusion"),
        F.monotonically_increasing_id().alias("at"), *([F.struct(*carry).alias("row")] if carry else []))
    rows = materialize(rows)
    weighted = rows.withColumn("mass", F.col("inclusion") * F.col("size"))
    mass = weighted.groupBy(F.col("source").alias("with_mass")).agg(F.sum("mass").alias("mass"))
    targets = source_targets(rows, weights=weights, most=most)
    plan = (targets.join(mass, F.col("source").eqNullSafe(F.col("with_mass"))).drop("with_mass")
            .withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("long"))
            .withColumn("missing", F.col("target") - F.col("certain") * F.col("source_size"))
            .withColumn("strips", F.ceil(F.col("n_docs") / F.greatest(F.sqrt("n_docs"), F.lit(float(STRIP)))).cast("long"))
            .withColumn("scale", F.when(F.col("mass") > 0, F.col("missing") / F.col("mass")).otherwise(0.0)))
    plan = materialize(plan.withColumnRenamed("source", "of"))

    u = uniform(F.col("doc_id"), seed)
    p = F.least(F.greatest(F.col("scale") * F.col("inclusion"), F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = (rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
              .withColumn("u", u).withColumn("q", (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p))
              .withColumn("strip", F.floor(F.col("q") / (1 + F.col("q")) * F.col("strips"))).drop("of", "mass", "scale"))

    edge = materialize(_edges(ranked.where("size > 0"), "missing"))
    placed = ranked.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # without an edge, every strip fits: all documents are taken
    sure = F.col("edge").isNull() | (F.col("strip") < F.col("edge"))
    at_edge = F.coalesce((F.col("strip") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    rest = placed.where(~at_edge).withColumn("picked", (sure & (F.col("missing") > 0) & (F.col("size") > 0)).cast("long"))
    near = materialize(_fitted(placed.where(at_edge).withColumn("room", F.col("missing") - F.col("before"))))
    left = materialize(near.groupBy(F.col("source").alias("of")).agg(F.first("left").alias("left")))

    # documents after the edge, or passed over too often in its strip, that fit what is left
    further = None
    held = placed.where((F.col("strip") >= F.col("edge")) & (F.col("size") > 0)).select(
        "at", "source", "strip", "q", "doc_id", "size")
    taken = near.where("picked = 1").select("at")
    while True:
        held = materialize(held.join(left, F.col("source").eqNullSafe(F.col("of"))).where("size <= left").drop("of", "left")
                           .join(taken, "at", "left_anti"))
        if not held.take(1):
            break
        open_ = held.join(left.withColumnRenamed("left", "missing"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        edge = materialize(_edges(open_, "missing"))
        located = open_.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        strip = _fitted(located.where("strip = edge").withColumn("room", F.col("missing") - F.col("before")))
        taken = materialize(strip.where("picked = 1").select("at", "source", "size").unionByName(
            located.where("edge is null or strip < edge").select("at", "source", "size")))
        used = taken.groupBy(F.col("source").alias("by")).agg(F.sum("size").alias("used"))
        left = materialize(left.join(used, F.col("of").eqNullSafe(F.col("by")), "left").select(
            "of", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
        taken = taken.select("at")
        further = taken if further is None else further.unionByName(taken)

    near = near.drop("left", "room")
    if further is not None:
        further = materialize(further.withColumn("fits", F.lit(1)))
        near, rest = (x.join(further, "at", "left").withColumn("picked", F.coalesce("fits", "picked").cast("long")).drop("fits")
                      for x in (near, rest))
    # one more document, the smallest, if that comes nearer than none
    near = near.join(left, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    smallest = F.row_number().over(Window.partitionBy("source").orderBy("picked", "size", "q", "doc_id")) == 1
    nearer = smallest & (F.col("picked") == 0) & (2 * F.col("left") > F.col("size"))
    near = near.withColumn("picked", F.when(nearer, 1).otherwise(F.col("picked")))
    out = rest.unionByName(near.drop("left"))
    copies = F.col("certain") + F.col("picked")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept."""
    out = mix(docs, text, doc_id, source, carry=tuple(docs.columns), **options).where("copies > 0")
    turn = clear_name("_copy", docs.columns)
    return (out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
