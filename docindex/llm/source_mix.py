"""Mixing sources to target weights, with DataFrame operations only.

Low-discrepancy source schedule: golden-ratio points are mapped through the cumulative target weights to a source, slots
are ranked per source, and slot ranks join the equal-token blocks of that source's shuffled documents.

Sizes are words. Targets share 100 % of all words by weight; no source gets more than LIMIT times its own words, and the
excess is shared again by weight. A source that needs more than its own words repeats its blocks; its last slot is cut, so
that what it gives equals its target to the word.

Nothing is ordered in one task: documents of a source are dealt into hash cells, slots into runs, and prefix sums of cells
and runs give the places, so a source with a third of all rows is spread like the others. The tables with one row per source,
per source and cell, and per source and run are small beside the documents; Spark picks their joins by size.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source, last in order; a source
without words has target 0; an empty table gives no rows; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, cut, own_columns, unused

#: Words of a block, and so of a slot.
BLOCK = 1024
#: A source is taken this many times at most.
LIMIT = 3
#: Documents that a hash cell of a source holds on average, and slots of a run.
CELL, RUN = 1024, 65536
#: Golden-ratio steps modulo 2**31 keep products inside 64 bits.
CIRCLE, STEP = 1 << 31, 1327217885
#: The circle is cut into arcs, so that slots find their source by an equi-join.
ARCS = 4096
SEED = 20_177


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"))


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last. One row per source passes the window."""
    rank = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, weight) with `target` and whole words `quota`.

    Filling by weight reaches the limit of sources in the order of limit / weight. Those before the first source that the
    level leaves below its limit get their limit, the others level times weight."""
    fill = sources.withColumn("room", LIMIT * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    fill = fill.withColumn("all_words", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    left = F.col("all_words") - F.coalesce(F.sum("room").over(before), F.lit(0))
    weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    fill = fill.withColumn("level", left / weight)
    fill = fill.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    target = F.least(F.col("room").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("room").cast("double")))
    fill = fill.withColumn("target", target).withColumn("quota", F.least(F.round("target").cast("long"), F.col("room")))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    full, rest = F.expr("quota div greatest(source_size, 1)"), F.col("quota") % F.greatest("source_size", F.lit(1))
    return fill.select("source", "source_size", "weight", "target", "quota", blocks.alias("blocks"), (full * blocks + F.ceil(rest / BLOCK)).alias("slots"), (rest % BLOCK).alias("cut_words"))


def schedule(plan: DataFrame) -> DataFrame:
    """slot, source, rank (from 0): as many slots of each source as `slots` says, in the order of the golden-ratio points.

    Sources that the points give too few slots (by a few, such is their discrepancy) get the rest at the end."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).head()[0] or 0
    order = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    ends = F.round(F.sum("slots").over(order) / F.lit(max(total, 1)) * CIRCLE).cast("long")
    arcs = plan.filter("slots > 0").withColumn("hi", ends)
    arcs = arcs.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
    width = CIRCLE // ARCS
    arcs = arcs.filter("hi > lo").select("source", "slots", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("arc"))
    points = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * STEP % CIRCLE).alias("point"))
    points = points.withColumn("arc", F.expr(f"point div {width}"))
    dealt = points.join(arcs, "arc").filter("point >= lo and point < hi").select("slot", "source", "slots", F.expr(f"slot div {RUN}").alias("run"))
    dealt = cut(dealt)
    runs = dealt.groupBy("source", "run").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("base", base)
    inside = F.row_number().over(W.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("i", inside).alias("d").join(runs.select(F.col("source").alias("s2"), F.col("run").alias("r2"), "base"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("run") == F.col("r2")))
    ranked = ranked.select("slot", "source", (F.col("i") + F.col("base")).alias("rank"), "slots").filter("rank < slots").drop("slots")
    have = dealt.groupBy(F.col("source").alias("s2")).agg(F.count("*").alias("have"))
    short = plan.filter("slots > 0").join(have, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < slots")
    rest = short.select("source", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank")).select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank")
    return ranked.unionByName(rest)


def shuffled_pieces(sizes: DataFrame, cells: int) -> DataFrame:
    """doc_id, size, source and the piece [from, to) that each document has in a block of its source's shuffled words."""
    h = F.xxhash64("doc_id", F.lit(SEED))
    docs = sizes.filter("size > 0").withColumn("h", h).withColumn("cell", F.pmod("h", F.lit(cells)))
    per = docs.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    per = per.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("size").over(W.partitionBy("source", "cell").orderBy("h", "doc_id", "size", "row_no").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = docs.withColumn("within", within).join(per.select(F.col("source").alias("s2"), F.col("cell").alias("c2"), "base"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
    placed = placed.select("row_no", "doc_id", "source", "size", (F.col("within") + F.col("base")).alias("at"))
    placed = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}"))))
    start = F.col("block") * BLOCK
    return placed.select("row_no", "source", "block", (F.greatest("at", start) - start).alias("lo"), (F.least(F.col("at") + F.col("size"), start + BLOCK) - start).alias("hi"))


def mix(docs: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule): doc_id, size, source_size, target, taken, source of every row, and slot, source, rank, block, epoch.

    weights: source, weight; one row per source, positive. None: default_weights()."""
    sizes = cut(sized(docs).withColumn("row_no", F.monotonically_increasing_id()))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    if weights is None:
        sources = default_weights(sources)
    else:
        w = weights.select(F.col("source").alias("s2"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = cut(targets(sources))
    largest = sources.agg(F.max("docs")).head()[0] or 1
    cells = 1 << max(0, (largest // CELL).bit_length())
    blocks = plan.select(F.col("source").alias("s3"), "blocks", F.col("slots").alias("all_slots"), "cut_words")
    slots = schedule(plan).join(blocks, F.col("source").eqNullSafe(F.col("s3")))
    slots = slots.select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("epoch"), F.when((F.col("rank") == F.col("all_slots") - 1) & (F.col("cut_words") > 0), F.col("cut_words")).alias("words_cut"))
    slots = cut(slots)
    uses = slots.groupBy(F.col("source").alias("s2"), F.col("block").alias("b2")).agg(F.count_if(F.col("words_cut").isNull()).alias("whole"), F.coalesce(F.max("words_cut"), F.lit(0)).alias("part"))
    pieces = shuffled_pieces(sizes, cells).join(uses, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    taken = pieces.groupBy("row_no").agg(F.sum(F.col("whole") * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo"))).alias("taken"))
    out = sizes.join(taken, "row_no", "left")
    by = plan.select(F.col("source").alias("s2"), "source_size", "target")
    out = out.join(by, F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"), slots


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it (the one that a source's last slot cuts counts as whole)."""
    of, source, words, times, n, own, copy = unused(docs, "_id", "_source", "_size", "_times", "_rows", "_own", "_copy")
    taken = mix(docs)[0].filter("taken > 0").groupBy(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("size").alias(words))
    taken = taken.agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias(times), F.count("*").alias(n))
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    rows = docs.withColumn(own, size).join(taken, F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(words)))
    rows = rows.withColumn(times, F.ceil(F.col(times) / F.col(n)).cast("int"))
    return rows.select(*own_columns(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
