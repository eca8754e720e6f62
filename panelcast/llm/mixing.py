"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the word budget in proportion to its weight, but
at most ``max_epochs`` times its own size; what it cannot use is reshared by
weight among the others until no source is above its cap.  A document is then
taken ``floor(target / source size)`` times, and once more if it falls into
the fractional part: documents of a source are laid end to end in the order
of a seeded hash, and those whose middle lies within the fractional length
are taken.  A source so misses its target by at most half a document.

Everything per document is a comparison with one row per source; that row is
found from sums per (source, 1/4096 of the hash range) and a window inside
the one range that holds the cut, so a source with most of the documents is
never gathered in one task.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; a null id is hashed as empty text; rows equal in id and text
are taken alike; an empty table gives an empty mix; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import text_or_empty, word_count, written

RANGE_DIGITS = 3  # hex digits of the hash that name one of the 4096 ranges


def _hash(seed: str, id_col: str, text_col: str):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                          F.lit("|"), text_or_empty(text_col)).cast("binary"))


def _measured(docs: DataFrame, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"), _hash(seed, id_col, text_col).alias("h"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Water-filled targets for a table (source, source_size), one row per source.

    Sorted by cap per weight, the capped sources are a prefix: a source is
    capped when its cap is at most its share of what the ones before leave.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(int(max_epochs)) * F.col("source_size"))
    before = (W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
              .rowsBetween(W.unboundedPreceding, -1))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_before"))
                    <= F.col("w") * (F.col("total") - F.col("cap_before")))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("w_sum", F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything))
    )
    share = F.col("w").cast("double") * (F.col("total") - F.col("cap_sum")) / (F.col("all_w") - F.col("w_sum"))
    return s.select("source", "source_size",
                    F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _cuts(rows: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source: target, whole repetitions, and where in hash order the extra one ends."""
    ranged = rows.withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    per_range = written(ranged.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges")
    goal = targets(per_range.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    goal = (
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("long"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    goal = written(goal, "mix-goals")
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        per_range.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("r")
        .join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .where((F.col("r.before") <= F.col("g.extra")) & (F.col("g.extra") < F.col("r.before") + F.col("r.n")))
        .select(F.col("r.source").alias("source"), "range", "before", "extra")
    )
    cut = written(cut, "mix-cuts")
    inside = (
        ranged.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))
                               & (F.col("d.range") == F.col("c.range")))
        .groupBy(F.col("d.source").alias("source"), F.col("d.range").alias("range"), "h", "before", "extra")
        .agg(F.sum("size").alias("n"))
    )
    w = W.partitionBy("source", "range").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    last = (
        inside.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2)
        .where(F.col("at") <= F.col("extra"))
        .groupBy("source").agg(F.max("h").alias("last_h"))
    )
    c, x = cut.alias("c"), last.alias("x")
    ends = (
        c.join(x, F.col("c.source").eqNullSafe(F.col("x.source")), "left")
        # every hash of an earlier range sorts before the range's own prefix
        .select(F.col("c.source").alias("source"), F.coalesce(F.col("last_h"), F.col("range")).alias("upto_h"))
    ).alias("e")
    g = goal.alias("g")
    return written(
        g.join(ends, F.col("g.source").eqNullSafe(F.col("e.source")), "left")
        .select(F.col("g.source").alias("source"), "source_size", "target", "whole",
                F.coalesce(F.col("upto_h"), F.lit("")).alias("upto_h")),
        "mix-sources")


def plan_mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: id, source, size, source_size, target, reps (times taken), taken (words)."""
    rows = written(_measured(docs, seed, id_col, source_col, text_col), "mix-sizes")
    cuts = _cuts(rows, weights, max_epochs)
    d, c = rows.alias("d"), cuts.alias("c")
    reps = F.col("c.whole") + F.when(F.col("d.h") <= F.col("c.upto_h"), 1).otherwise(0)
    return (
        d.join(c, F.col("d.source").eqNullSafe(F.col("c.source")))
        .select(F.col("d.id").alias("id"), F.col("d.source").alias("source"), "size", "source_size", "target",
                reps.alias("reps"))
        .withColumn("taken", F.col("size") * F.col("reps"))
    )


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it."""
    cuts = _cuts(written(_measured(docs, seed, id_col, source_col, text_col), "mix-sizes"), weights, max_epochs)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                    F.col(source_col).alias("src"), _hash(seed, id_col, text_col).alias("h")).alias("d")
    c = cuts.alias("c")
    reps = F.col("c.whole") + F.when(F.col("d.h") <= F.col("c.upto_h"), 1).otherwise(0)
    out = (
        d.join(c, F.col("d.src").eqNullSafe(F.col("c.source")))
        .withColumn("reps", reps.cast("int")).where("reps > 0")
        .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("reps"))))
    )
    return out.select(*[F.col("doc").getField(x).alias(x) for x in docs.columns])
