"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and 2 that meet every source's token target, the ones
closest to 1 in relative entropy are exponential in a document's size, cut at 2:
``min(2, exp(l * size / mean))`` with one multiplier ``l`` per source.  Newton steps on the
convex dual find the multipliers of all sources at once over counts of (source, size), which
hold the whole corpus.  Rates become whole copies with the rounding error of large documents
passed on to smaller ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skysieve.llm.text import boxed, field, n_words, unboxed, whole
from skysieve.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
_CELLS = 4096  # sizes of a source rounded in one piece
_BUCKETS = 4096  # parts that documents of one source and size are ranked in


def ranks(keys: DataFrame, key: str, name: str) -> DataFrame:
    """0-based rank of each row by ``key``, without bringing all rows together."""
    placed = cut(keys.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn(
        "_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "ranks")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")  # a row per partition
    return placed.join(before, "_part").withColumn(
        name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def targets(sources: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """``sources(_source, source_size)`` with ``target``: shares by weight, none above ``cap`` times its size.

    Weights repeat over the sources in order.  What a cap leaves over is shared again among the
    others until none is above; each round reads two sums of the source table.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = cut(ranks(sources, "_source", "_rank").withColumn("_w", w), "sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, most = 0.0, F.lit(float(cap)) * F.col("source_size")
    while True:
        free = F.col("_w") * level < most
        fixed, open_ = s.agg(F.sum(F.when(~free, most)), F.sum(F.when(free, F.col("_w")))).first()
        new = (total - (fixed or 0.0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(most, F.col("_w") * level)).drop("_w", "_rank")


def _multipliers(cells: DataFrame, sources: DataFrame, cap: float, rounds: int = 80) -> DataFrame:
    """``(_source, _scale)``: the rate of a document is ``min(cap, exp(_scale * size))``."""
    top = F.log(F.lit(float(cap)))
    about = cells.where("size > 0").groupBy("_source").agg(
        F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = sources.where("source_size > 0").join(about, "_source").select(
        "_source", "target", (F.col("source_size") / F.col("docs")).alias("mean"),
        (top * F.col("source_size") / F.col("docs") / F.col("least")).alias("hi"), F.lit(None).cast("double").alias("lo"),
        (F.col("target") >= cap * F.col("source_size")).alias("done"))
    state = cut(state.withColumn("lam", F.when(F.col("done"), F.col("hi")).otherwise(F.lit(0.0))), "dual")
    for _ in range(rounds):
        if state.where("NOT done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        power = F.col("lam") * x
        inside = power < top
        rate = F.when(inside, F.exp(power)).otherwise(F.lit(float(cap)))
        sums = cells.where("size > 0").join(state.where("NOT done").select("_source", "lam", "mean"), "_source").groupBy(
            "_source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                           F.sum(F.when(inside, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "_source", "left").withColumn("g", F.col("got") - F.col("target"))
        lo = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))
        s = s.withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("lam") - F.col("g") / F.nullif(F.col("slope"), F.lit(0.0))
        good = newton.isNotNull() & (newton <= F.col("hi")) & (F.col("lo").isNull() | (newton >= F.col("lo")))
        back = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs("g") <= 1e-7 * F.col("target")
        step = F.when(good, newton).otherwise(back)
        state = cut(s.select(
            "_source", "target", "mean", "hi", "lo", (F.col("done") | near | (step == F.col("lam"))).alias("done"),
            F.when(F.col("done") | near, F.col("lam")).otherwise(step).alias("lam")), "dual")
    return state.select("_source", (F.col("lam") / F.col("mean")).alias("_scale"))


def _fold(cells: Column, carry: Column, cap: float) -> Column:
    """Whole copies of each (size, count, rate), the rounding error handed on; and the error left."""
    start = F.struct(carry.cast("double").alias("carry"), F.array().cast("array<struct<size:bigint,copies:bigint>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        want = c["n"] * c["rate"] * c["size"] + acc["carry"]
        copies = F.when(c["size"] > 0, F.greatest(F.lit(0), F.least(
            cap * c["n"], F.round(want / c["size"])))).otherwise(c["n"]).cast("bigint")
        return F.struct((want - copies * c["size"]).alias("carry"), F.array_append(
            acc["out"], F.struct(c["size"].alias("size"), copies.alias("copies"))).alias("out"))

    return F.aggregate(cells, start, step)


def _copies(cells: DataFrame, cap: float) -> DataFrame:
    """``(_source, size, n, copies)`` from ``cells(_source, size, n, rate)``.

    A source's sizes, largest first, are rounded in blocks; the last block, with the smallest
    documents, also takes what the others leave.
    """
    order = Window.partitionBy("_source").orderBy(F.desc("size"))
    blocks = cut(cells.withColumn("_block", F.floor((F.row_number().over(order) - 1) / _CELLS)).groupBy(
        "_source", "_block").agg(F.array_sort(F.collect_list(F.struct(
            (-F.col("size")).alias("_o"), "size", "n", "rate"))).alias("cells")), "blocks")
    last = blocks.groupBy("_source").agg(F.max("_block").alias("_last"))
    ends = blocks.join(last, "_source")
    left = ends.where("_block < _last").withColumn("_left", _fold(F.col("cells"), F.lit(0.0), cap)["carry"]).groupBy(
        "_source").agg(F.sum("_left").alias("_left"))
    carry = F.when(F.col("_block") == F.col("_last"), F.coalesce("_left", F.lit(0.0))).otherwise(F.lit(0.0))
    out = ends.join(left, "_source", "left").withColumn("_out", _fold(F.col("cells"), carry, cap)["out"])
    return out.select("_source", F.explode("_out").alias("o")).select("_source", "o.size", "o.copies")


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, cap: int = 2) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; columns of these names are replaced.

    ``docs`` needs ``doc_id``, ``source`` and ``text``.  A null text has size 0, a null source is a
    source of its own, the last one; documents of size 0 keep one copy.  Of documents alike in
    source and size the ones with the lowest hash get the copies that are left over, so reruns
    agree; equal rows are interchangeable.
    """
    return unboxed(_mixed(_sized(boxed(docs)), share, weights, cap), docs.columns, {
        n: F.col(n) for n in ("size", "source_size", "target", "copies")})


def _sized(base: DataFrame) -> DataFrame:
    """What mixing needs of a boxed document: size, hash and id, and the source as a key in order, null last."""
    source = field("source").cast("string")
    return base.select("__row__", n_words(whole(field("text"))).alias("size"), F.xxhash64(field("doc_id"), whole(field("text"))).alias("_hash"),
                       field("doc_id").alias("_id"),
                       F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source)).alias("_source"))


def _mixed(base: DataFrame, share: float, weights: Sequence[float], cap: int) -> DataFrame:
    """Sized documents with their copies."""
    bucket = F.pmod("_hash", F.lit(_BUCKETS)).alias("_bucket")
    parts = cut(base.select("_source", "size", bucket).groupBy("_source", "size", "_bucket").count(), "mix-parts")
    cells = cut(parts.groupBy("_source", "size").agg(F.sum("count").alias("n")), "mix-cells")
    sources = cells.groupBy("_source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = cut(targets(sources, share, weights, cap), "mix-targets")
    scale = _multipliers(cells, sources, cap)
    power = F.coalesce("_scale", F.lit(0.0)) * F.col("size")
    rate = F.when(power < F.log(F.lit(float(cap))), F.exp(power)).otherwise(F.lit(float(cap)))
    rated = cells.join(scale, "_source", "left").select("_source", "size", "n", rate.alias("rate"))
    decided = _copies(rated, cap).join(cells, ["_source", "size"]).join(sources, "_source")
    within = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = cut(parts.withColumn("_before", F.coalesce(F.sum("count").over(within), F.lit(0))).join(
        decided, ["_source", "size"]).select(
        "_source", "size", "_bucket", "source_size", "target", F.expr("copies div n").alias("_each"),
        (F.col("copies") - F.expr("copies div n") * F.col("n") - F.col("_before")).alias("_more")), "mix-quota")
    order = Window.partitionBy("_source", "size", "_bucket").orderBy("_hash", "_id")
    placed = base.withColumn("_bucket", bucket).withColumn("_at", F.row_number().over(order))
    return placed.join(quota, ["_source", "size", "_bucket"]).select(
        "__row__", "size", "source_size", "target", (F.col("_each") + F.when(F.col("_at") <= F.col("_more"), 1).otherwise(0)).alias("copies"))


def repeated(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, cap: int = 2) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its copies say."""
    mixed = _mixed(_sized(boxed(docs)), share, weights, cap)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return unboxed(mixed.select("__row__", copies.alias("_copy")), docs.columns, {})


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    thin = cut(_sized(boxed(docs.select("doc_id", "source", "text"))).drop("__row__"), "sizes")
    return _mixed(thin.withColumn("__row__", F.struct("_id")), 1.5, WEIGHTS, 2).select(
        F.col("__row__._id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target",
                            (F.col("copies") * F.col("size")).cast("long").alias("taken"))
