"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._names import Named
from ._scratch import materialize, small

#: Weights of the sources in order, repeating, and the most repetitions.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: Seeds tried for each source: slices of eight hex digits of the document's SHA-256.
SEEDS = 57


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (source, source_size).

    Sources by code point, null last, get the weights in turn.  All sizes together are
    shared by weight; a target stops at ``cap`` times its source's size and the excess
    is shared again.  That ends where ``target = min(cap * size, level * weight)``: in
    the order of ``size / weight`` the capped sources come first, and the level is what
    they leave divided by the weights that follow.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    turn = F.array(*[F.lit(w) for w in weights])
    out = sizes.withColumn("weight", F.element_at(
        turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    all_ = Window.partitionBy()
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumns({"_left": left, "_rest": rest})
    capped = F.col("_left") * F.col("weight") > cap * F.col("source_size") * F.col("_rest")
    level = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), "_left", "_rest"))).over(all_)
    out = out.withColumn("_level", level)
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * F.col("_level._left") / F.col("_level._rest"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], cap: int,
             carry: Sequence[str] | None) -> tuple[Named, DataFrame]:
    """Documents under plain names, with ``_size`` (if they are given whole, null), the
    numbers of their source and ``_copies``.

    Sizes and hashes are written once, without texts.  What follows needs one row a
    source: a table that is broadcast, so no text is shuffled.
    """
    named = Named(docs, ["size", "source_size", "target", "copies", "taken"], carry)
    i, text, source = (named.plain(c) for c in (id_col, text_col, source_col))
    hashed = F.sha2(F.coalesce(F.col(i).cast("string"), F.lit("")), 256).alias("_hex")
    brief = named.kept if carry is not None else []
    sized = materialize(named.df.select(*brief, F.col(source).alias("_src"), document_size(F.col(text)).alias("_size"), hashed))
    sizes = sized.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = source_targets(sizes, weights, cap).withColumn("_rate", rate).withColumn("_whole", F.floor("_rate"))
    edge = F.lower(F.lpad(F.hex(F.floor((F.col("_rate") - F.col("_whole")) * F.lit(2.0**32))), 8, "0"))
    rates = small(rates.select(F.col("source").alias("_src2"), "source_size", "target", "_whole", edge.alias("_edge")))
    tries = sized.join(rates, F.col("_src").eqNullSafe(F.col("_src2")))
    sums = tries.groupBy("_src").agg(
        F.first("target").alias("t"),
        F.array(*[F.sum(F.col("_size") * (F.col("_whole") + F.when(F.substring("_hex", k, 8) < F.col("_edge"), 1)
                                          .otherwise(0))) for k in range(1, SEEDS + 1)]).alias("sums"))
    best = F.array_min(F.transform("sums", lambda s, k: F.struct(F.abs(s - F.col("t")).alias("d"), (k + 1).alias("k"))))
    seeds = sums.select(F.col("_src").alias("_src3"), best["k"].alias("_seed"))
    rates = small(rates.join(seeds, F.col("_src2").eqNullSafe(F.col("_src3"))).drop("_src3"))
    if carry is None:
        sized = named.df.withColumns({"_src": F.col(source), "_size": document_size(F.col(text))}).withColumn("_hex", hashed)
    out = sized.join(rates, F.col("_src").eqNullSafe(F.col("_src2")), "left")
    extra = F.when(F.expr("substring(_hex, _seed, 8)") < F.col("_edge"), 1).otherwise(0)
    return named, out.withColumn("_copies", F.coalesce(F.col("_whole") + extra, F.lit(0)).cast("long"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS, carry: Sequence[str] | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken to ``docs`` (or to its columns
    ``carry`` only, which saves a second look at the texts).

    The repetition rate of a source is target / size.  A document is taken
    ``floor(rate)`` times, and once more if the number in a slice of its id's SHA-256
    is below the rate's fraction.  Which slice is the seed of its source: the one whose
    sum over the source comes nearest to the target, the first of equals, so that
    sources with few documents meet their targets too.  Nothing depends on partitions
    or order, so reruns agree.

    Null text has size 0 and is taken as its source's rate says, with no words.  Null
    sources are one source, the last.  A source without words has target 0 and no
    copies.  Repeated rows are taken alike; a null id counts as an empty string.  An
    empty table stays empty.  Columns may have any names; those with the names of added
    ones are replaced.
    """
    named, out = _planned(docs, id_col, text_col, source_col, weights, cap, carry)
    return named.back(out, F.col("_size").alias("size"), "source_size", "target",
                      F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: every document as often as ``plan_mix`` says, with its number of
    the copy (``copy``, from 0; it replaces a column of that name)."""
    named, out = _planned(docs, id_col, text_col, source_col, weights, cap, None)
    named.kept = [f"c{i}" for i, name in enumerate(named.names) if name.lower() != "copy"]
    return named.back(out.where("_copies > 0").select(*named.kept, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy")), "copy")
