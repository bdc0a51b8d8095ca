"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates that give every source its target of words, those closest to 1 in relative entropy are
exponential tilts exp(dual of the source).  Newton steps on the convex dual find the duals; each step
sums the tilted words per source over the table of size classes.  Rates are then rounded into whole copies so
that every source comes close to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import WORD, query, stored, table
from parlance.sizing import number_rows

EXACT_SIZES = 1024
CLASSES_PER_DOUBLING = 64


def size_class(size: Column) -> Column:
    """Sizes to EXACT_SIZES stand alone; above, classes span about one percent, so their number stays bounded."""
    return F.when(size <= EXACT_SIZES, size).otherwise(EXACT_SIZES + F.ceil(CLASSES_PER_DOUBLING * F.log2(size / F.lit(EXACT_SIZES)))).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, NULL last, have the weights in turn and share the total size by them.  No target
    exceeds ``limit`` times its source; the excess is shared again by weight.  That level is the largest
    of (total - limits of the sources capped first) / (weights of the others).  The windows see a row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1))
    weighed = weighed.withColumn("most", limit * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    taken = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(everything)
    return weighed.withColumn("level", (F.sum("source_size").over(everything) - taken) / others).withColumn(
        "target", F.least(F.col("most"), level * F.col("weight"))).select("source", "source_size", "target")


def newton_duals(classes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, most_steps: int = 100) -> DataFrame:
    """(source, source_size, target, dual): exp(dual) times the words of the source equals its target.

    Gradient and curvature of the dual are both made of the tilted words of a source, summed anew in each step.
    The curvature has no terms between sources, as a document belongs to one.
    """
    duals = stored(targets.withColumn("dual", F.lit(0.0)), "duals")
    for _ in range(most_steps):
        same = F.col("c.source").eqNullSafe(F.col("d.source"))
        tilted = classes.alias("c").join(duals.where("target > 0").alias("d"), same).groupBy(F.col("d.source").alias("source")).agg(
            F.sum(F.col("words") * F.exp("dual")).alias("tilted"))
        step = duals.alias("d").join(tilted.alias("c"), same, "left").select(
            "d.source", "source_size", "target", (F.col("dual") - F.coalesce((F.col("tilted") - F.col("target")) / F.col("tilted"), F.lit(0.0))).alias("dual"),
            F.coalesce(F.abs(F.col("tilted") - F.col("target")) / F.col("target"), F.lit(0.0)).alias("gap"))
        step = stored(step, "duals")
        duals = step.drop("gap")
        if step.where(F.col("gap") > tolerance).isEmpty():
            break
    return duals


def extra_copies(classes: DataFrame, duals: DataFrame) -> DataFrame:
    """(source, class, whole, extra): every document has ``whole`` copies, and ``extra`` documents of the class one more.

    Classes are taken from the largest down.  Each gets the number of extra copies that brings the words of the
    source closest to what its rate asks for so far, so what a large class misses the smaller ones make up.
    A source has at most EXACT_SIZES classes and CLASSES_PER_DOUBLING for each doubling above.
    """
    same = F.col("c.source").eqNullSafe(F.col("d.source"))
    rated = classes.alias("c").join(duals.alias("d"), same).select(
        "c.source", "class", "n", "words", F.when(F.col("target") > 0, F.exp("dual")).otherwise(F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    lists = rated.groupBy("source").agg(F.max("whole").alias("whole"), F.max("part").alias("part"), F.reverse(F.sort_array(F.collect_list(
        F.struct("class", F.col("n").cast("double").alias("n"), F.col("words").cast("double").alias("words"))))).alias("cells"))
    empty = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<struct<class:bigint,extra:bigint>>").alias("out"))

    def place(done: Column, cell: Column) -> Column:
        due = done["due"] + F.col("part") * cell["words"]
        mean = cell["words"] / cell["n"]
        extra = F.when(mean > 0, F.least(cell["n"], F.greatest(F.lit(0.0), F.floor(due / mean + 0.5).cast("double")))).otherwise(F.lit(0.0))
        return F.struct((due - extra * mean).alias("due"), F.concat(done["out"], F.array(F.struct(
            cell["class"].alias("class"), extra.cast("long").alias("extra")))).alias("out"))

    return lists.select("source", "whole", F.explode(F.aggregate("cells", empty, place)["out"]).alias("x")).select(
        "source", F.col("x.class").alias("class"), "whole", F.col("x.extra").alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    A NULL text has size 0, and NULL is a source of its own.  Documents of size 0 get whole copies only.  Which
    documents of a class get an extra copy is decided by a hash of id and text, so reruns agree, and rows that
    repeat both are told apart only by the copies they get.  The ranks inside a class come from a
    range-partitioned sort: a source or class with a third of all rows is spread over many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text).alias("draw")).withColumn("class", size_class(F.col("size"))), "mix-sizes")
    classes = stored(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    duals = newton_duals(classes, source_targets(sources, weights, limit))
    copies = stored(extra_copies(classes, duals), "mix-copies")
    ranked = number_rows(sized, [F.col("draw"), F.col("id")], ["source", "class"], "rank")
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.class") == F.col("c.class"))
    out = ranked.alias("r").join(copies.alias("c"), same).select(
        "r.*", (F.col("whole") + (F.col("rank") < F.col("extra")).cast("long")).alias("copies"))
    known = F.col("o.source").eqNullSafe(F.col("d.source"))
    return out.alias("o").join(duals.alias("d"), known).select(
        F.col("id").alias(id_col), F.col("o.source").alias(source_col), "size", "draw", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_entropy_mix")
def op8_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
