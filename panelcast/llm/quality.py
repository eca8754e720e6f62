"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` bytes.  It
is trained on every trusted document (labelled good and not toxic) but a fifth,
picked by a hash of their id, which is held out for the thresholds; nothing is
sampled.  Its count tables, continuation counts,
discounts and back-off weights are DataFrames sharded by n-gram.  Every
document is scored over its whole text: chunks ask for their distinct n-grams,
which are joined level by level with the count tables (see ``chunks``).

A document is kept when its perplexity per byte is at most its language's
threshold, which trusted documents that were not trained on give and nothing
else: rejected documents have no say in it.  With ``min_calibration`` of them
or more it is their ``quantile``, exact on a grid of 0.001 bits.  With fewer
(n), whose far quantile would be an outlier's, it is a prediction limit, median
+ z * s * sqrt(1 + 1/n), that moves to the quantile with the square of n /
min_calibration.  The spread s (from the median to the 0.9 quantile, as a normal
deviation) is shrunk towards that of all languages as if 20 documents told it;
z is the quantile of all languages' distances from their medians in spreads, at
least that of a normal distribution.  A language (null too) without any such
document is not judged: its documents stay, and ``reason`` says so.

Defined cases: a document without text (null or empty) is rejected; a null
language is a language of its own; null ids are scored but never trusted; an
id with several labels is trusted when all of them say so; rows equal in id
and text get one result; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm import chunks
from panelcast.llm.common import text_or_empty, written

ORDER = 5  # bytes of an n-gram
GRID = 1000  # steps of one bit in the quantiles
TAIL = 0.9  # quantile that tells a language's spread
BROADCAST_IDS = 4_000_000  # of trusted documents; more are joined by a shuffle
PRIOR = 20  # documents' worth of the spread within all languages in that of one


def trusted_ids(labels: DataFrame) -> DataFrame:
    return (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
            .where("good = 1 and toxic = 0").select("id"))


def _left_out() -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(5)) == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks.chunks_of(batches):
        found: list = []
        for piece in chunks.pieces_of(chunk):
            found.append(np.unique(chunks.byte_grams(piece.column("text").to_pylist(), ORDER)[0], return_counts=True))
        grams, n = chunks._merged(found)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "c"])


def _tail(k: int) -> Column:
    """The gram's last k bytes."""
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))


class KneserNey:
    """Count tables of the orders ORDER..1 and their discounts."""

    def __init__(self, texts: DataFrame):
        counts = written(texts.mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "kn-counts")
        self.levels: dict[int, tuple[DataFrame, DataFrame]] = {}
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # in how many one byte longer grams it ends
                counts = written(counts.select(_tail(k).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "kn-continued")
            n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            discounts = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            discounts = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(discounts, 1)]
            d = F.when(F.col("c") == 1, discounts[0]).when(F.col("c") == 2, discounts[1]).otherwise(discounts[2])
            table = counts.select("gram", F.shiftright("gram", 8).alias("context"), F.col("c").cast("double").alias("c"), d.alias("d"))
            contexts = table.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back_off"))
            self.levels[k] = (table.select("gram", (F.col("c") - F.col("d")).alias("left")), contexts)

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, p) for a table of distinct grams of ORDER bytes."""
        wanted = {ORDER: grams.select("gram")}
        for k in range(ORDER - 1, 0, -1):
            wanted[k] = written(wanted[k + 1].select(_tail(k).alias("gram")).distinct(), "kn-wanted")
        shorter = None
        for k in range(1, ORDER + 1):
            table, contexts = self.levels[k]
            w = wanted[k].withColumn("context", F.shiftright("gram", 8)).withColumn("tail", _tail(k - 1))
            w = w.withColumn("shorter", F.lit(1 / 256)) if k == 1 else w.join(
                shorter.select(F.col("gram").alias("tail"), F.col("p").alias("shorter")), "tail")
            p = F.coalesce(F.coalesce("left", F.lit(0.0)) / F.col("total") + F.col("back_off") * F.col("shorter"), F.col("shorter"))
            shorter = w.join(contexts, "context", "left").join(table, "gram", "left").select("gram", p.alias("p"))
            shorter = written(shorter, "kn-p")
        return shorter


def _ask(piece):
    grams = np.unique(chunks.byte_grams(piece.column("text").to_pylist(), ORDER)[0])
    yield grams, np.zeros(len(grams), np.int64)


def _score(piece: pa.Table, tables) -> pa.Table:
    texts = piece.column("text").to_pylist()
    codes, sizes = chunks.byte_grams(texts, ORDER)
    bits = chunks.per_text(tables["bits"][codes], sizes) / (chunks.FIXED * sizes)
    return pa.table({"id": piece.column("id"), "key": piece.column("key"), "lang": piece.column("lang"),
                     "n_bytes": pa.array(sizes - 1), "bits": pa.array(bits)})


def thresholds(scores: DataFrame, quantile: float, min_calibration: int) -> DataFrame:
    """(lang, threshold) from the (lang, bits) of trusted documents that were not trained on."""
    # one row per language and step of the grid, however many documents
    steps = written(scores.groupBy("lang", F.ceil(F.col("bits") * GRID).alias("step")).agg(F.count(F.lit(1)).alias("n")), "quality-steps")
    x = F.col("step") / GRID
    every = W.partitionBy("lang")
    steps = steps.withColumns({"all": F.sum("n").over(every),
                               "upto": F.sum("n").over(every.orderBy("step").rowsBetween(W.unboundedPreceding, 0))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("all")), x))
    tail = NormalDist().inv_cdf(TAIL)
    own = steps.groupBy("lang", "all").agg(at(0.5).alias("median"), at(TAIL).alias("high"), at(quantile).alias("own"))
    own = written(own.withColumn("apart", (F.col("high") - F.col("median")) / tail), "quality-languages")
    common = own.agg(F.sum(F.col("all") * F.col("apart")) / F.sum("all")).first()[0] or 0.0
    spread = F.greatest((F.col("all") * F.col("apart") + F.lit(PRIOR * common)) / (F.col("all") + PRIOR), F.lit(1 / GRID))
    own = own.withColumn("spread", spread)
    # distances from the medians, in hundredths of a spread
    s, o = steps.alias("s"), own.alias("o")
    far = s.join(o, F.col("s.lang").eqNullSafe(F.col("o.lang"))).select("n", F.ceil((x - F.col("median")) / F.col("spread") * 100).alias("z"))
    far = far.groupBy("z").agg(F.sum("n").alias("n"))
    far = far.withColumns({"upto": F.sum("n").over(W.orderBy("z").rowsBetween(W.unboundedPreceding, 0)),  # some hundred rows
                           "all": F.sum("n").over(W.partitionBy(F.lit(1)))})
    z = far.where(F.col("upto") >= F.ceil(F.lit(quantile) * F.col("all"))).agg(F.min("z")).first()[0]
    z = max(NormalDist().inv_cdf(quantile), (z or 0) / 100)
    share = F.pow(F.least(F.col("all") / min_calibration, F.lit(1.0)), F.lit(2.0))
    limit = F.col("median") + z * F.col("spread") * F.sqrt(1 + 1 / F.col("all"))
    return own.select("lang", (share * F.col("own") + (1 - share) * limit).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, min_calibration: int = 200,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, key (hash of the text), lang, n_bytes, bits_per_byte, perplexity, threshold, kept, reason for every row.

    ``reason`` is "no text" or "perplexity" where the row is rejected, "not
    judged" where its language has no threshold, else null.
    """
    trusted = written(trusted_ids(labels), "quality-trusted")
    trained = trusted.where(~_left_out())
    if trained.count() <= BROADCAST_IDS:  # the texts then stay where they are
        trained = F.broadcast(trained)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"),
                       F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    model = KneserNey(rows.join(trained, "id", "left_semi").select("text"))
    asked = written(chunks.ask(rows, _ask).select("chunk", "gram"), "quality-grams")
    p = model.probabilities(written(asked.select("gram").distinct(), "quality-distinct"))
    bits = asked.join(p.select("gram", chunks.fixed(-F.log2("p")).alias("value")), "gram")
    scores = written(chunks.score(rows, {"bits": bits}, _score, "id long, key long, lang string, n_bytes long, bits double"), "quality-scores")
    known = scores.join(trusted.where(_left_out()), "id", "left_semi").where("n_bytes > 0")
    limits = thresholds(known, quantile, min_calibration)
    s, t = scores.alias("s"), limits.alias("t")
    limit = F.col("t.threshold")
    reason = (F.when(F.col("n_bytes") == 0, "no text").when(limit.isNull(), "not judged").when(F.col("bits") > limit, "perplexity"))
    return s.join(t, F.col("s.lang").eqNullSafe(F.col("t.lang")), "left").select(
        "id", "key", F.col("s.lang").alias("lang"), "n_bytes", F.col("bits").alias("bits_per_byte"),
        F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"),
        ((F.col("n_bytes") > 0) & F.coalesce(F.col("bits") <= limit, F.lit(True))).alias("kept"),
        reason.alias("reason"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, unchanged."""
    kept = classify(docs, labels, id_col=id_col, text_col=text_col, **options).where("kept").select("id", "key").distinct().alias("k")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"),
                    F.xxhash64(F.col(text_col)).alias("key")).alias("d")
    return (d.join(kept, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.key") == F.col("k.key")), "left_semi")
            .select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]))
