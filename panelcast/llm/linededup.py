"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped when an earlier line equals it or differs from it by one
edit (one character inserted, deleted or replaced).  Lines are compared
without the white space around them; "earlier" is by (doc_id, line number).
Only lines of at least ``min_chars`` characters are compared by edits: one
edit in a short line ("page 1", "page 2") is a different line.

Emitting every one-character deletion of every line would multiply the text
by its line length.  Three lossless steps keep it small:

1. Two lines one edit apart agree before or after their middle.  Each line
   emits hashes of its first and last half (for its own length and for one
   character less); lines whose halves nobody else has are out.
2. The same with segments of about 64 characters: a pair agrees on all but one
   segment.  What is left knows the segment the edit must be in.
3. Inside that segment all one-character deletions are emitted as hashed keys.
   Two lines that differ by a replacement share (position, rest); a line and
   one with a character more share (rest).  Each key's earliest line is joined
   with the others of the key, the edit distance of the two full lines is
   verified, and the later line goes.

No step pairs the members of a group with one another: members meet the
earliest of their key, so a line that occurs in most documents costs one row
per occurrence.

Defined cases: a null text stays null and has no lines; blank lines always
stay; a null doc_id sorts first; rows with the same doc_id and different text
are ordered by a hash of the text; rows equal in both count as one document
and get the same result; a text whose lines all go becomes empty; an empty
table stays empty; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import written

BLANK = " \t\r\x0b\x0c"
SEGMENT = 64


def _hash2(c: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def _left(s: str, n: str) -> Column:
    return F.expr(f"left({s}, {n})")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"),
                F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "raw"))
        .select("id", "key", "no", F.btrim("raw", F.lit(BLANK)).alias("line"))
        .where("line <> ''")
    )


def _halves(min_chars: int) -> Column:
    """Hashes of the first and last half, cut for base lengths n and n - 1."""
    def pair(n: str):
        cut = f"cast(({n}) / 2 as int)"
        return [f"xxhash64(0, {n}, left(line, {cut}))", f"xxhash64(1, {n}, right(line, {n} - {cut}))"]

    both = ", ".join(pair("n") + pair("n - 1"))
    return F.expr(f"case when n > {min_chars} then array({both}) when n = {min_chars} then array({', '.join(pair('n'))}) end")


def _more_than_one(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (keys.., h1) whose key occurs with more than one h1."""
    several = (rows.groupBy(*keys).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select(*keys))
    return rows.join(written(several, name), keys, "left_semi")


def near_lines(lines: DataFrame, docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of distinct lines that are one edit from an earlier line."""
    halves = (lines.where(F.col("halves").isNotNull()).select("h1", F.explode("halves").alias("half")))
    alike = _more_than_one(halves, ["half"], "lines-halves").select("h1").distinct()
    # the first place of each line that is left, then its text
    # (written between join and grouping, so that a hot line's rows may be joined in several tasks)
    first = (
        written(lines.select("id", "key", "no", "h1", "h2").join(written(alike, "lines-alike-keys"), "h1", "left_semi"), "lines-alike-places")
        .groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "no")).alias("pos"))
    )
    wanted = first.groupBy(F.col("pos.id").alias("id"), F.col("pos.key").alias("key")).agg(
        F.collect_list(F.struct("pos.no", "h1", "h2", "pos")).alias("wanted")).alias("w")
    d = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).alias("d")
    found = (
        d.join(wanted, F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.key") == F.col("w.key")))
        .select(F.split("text", "\n").alias("raw"), F.explode("wanted").alias("x"))
        .select("x.h1", "x.h2", "x.pos", F.btrim(F.element_at("raw", F.col("x.no") + 1), F.lit(BLANK)).alias("line"))
        .dropDuplicates(["h1", "h2"])  # rows equal in id and text
    )
    found = written(found.withColumn("n", F.length("line")), "lines-alike")

    # segments: base length b is the shorter of the two lines' lengths
    based = found.select("h1", "line", "n", F.explode(F.expr(
        f"case when n > {min_chars} then array(n, n - 1) else array(n) end")).alias("b"))
    cut = based.withColumn("m", F.ceil(F.col("b") / SEGMENT).cast("int"))
    cut = cut.select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("j"))
    cut = cut.withColumn("from", F.expr("cast(floor(b * j / m) as int)")).withColumn("upto", F.expr("cast(floor(b * (j + 1) / m) as int)"))
    around = F.expr("xxhash64(b, j, left(line, from), right(line, b - upto))")
    segments = cut.select("h1", "n", "b", around.alias("around"), F.expr("substring(line, from + 1, n - from - (b - upto))").alias("inside"))
    shared = _more_than_one(segments, ["around"], "lines-segments")

    # one-character deletions inside the segment; kind 0: the line itself, 1: with a character less, 2: replaced
    rest = "concat(left(inside, i - 1), substring(inside, i + 1))"
    same = f"transform(sequence(1, length(inside)), i -> struct(2 as kind, xxhash64(around, i, {rest}) as v))"
    less = f"transform(sequence(1, length(inside)), i -> struct(1 as kind, xxhash64(around, -1, {rest}) as v))"
    itself = "array(struct(0 as kind, xxhash64(around, -1, inside) as v))"
    variants = shared.select("h1", F.explode(F.expr(
        f"case when n > b then {less} when length(inside) = 0 then {itself} else concat({itself}, {same}) end")).alias("x"))
    variants = variants.select("h1", "x.kind", "x.v").distinct()
    placed = found.select("h1", "pos")
    v = written(variants.join(placed, "h1"), "lines-variants")
    earliest = (
        v.groupBy("v").agg(
            F.min(F.when(F.col("kind") == 1, F.struct("pos", "h1"))).alias("less"),
            F.min(F.when(F.col("kind") != 1, F.struct("pos", "h1"))).alias("even"))
    )
    # a replaced line meets the earliest replaced one; a line itself meets those with a character more, and back
    met = (
        v.join(earliest, "v")
        .select("h1", "pos", F.when(F.col("kind") == 0, F.col("less")).otherwise(F.col("even")).alias("other"))
        .where("other is not null and other.pos < pos")
        .select("h1", F.col("other.h1").alias("other")).distinct()
    )
    text = found.select("h1", "h2", "line")
    verified = (
        met.join(text, "h1").join(text.select(F.col("h1").alias("other"), F.col("line").alias("earlier")), "other")
        .where(F.levenshtein("line", "earlier", 1) >= 0)
    )
    return verified.select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, *, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop per document: id, key (hash of the text), nos (line numbers from 0), equal, near (counts)."""
    lines = _lines(docs, id_col, text_col).withColumn("n", F.length("line"))
    lines = written(lines.select("id", "key", "no", *_hash2(F.col("line")), _halves(min_chars).alias("halves")), "lines")
    near = written(near_lines(lines, docs, min_chars, id_col, text_col), "lines-near")
    # only lines that occur again, or are near an earlier one, are looked at closer
    marked = (lines.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
              .unionByName(near.select("h1")).distinct())
    pos = F.struct(F.col("id").isNotNull().alias("known"), "id", "key", "no")
    marked = written(lines.select("id", "key", "no", "h1", "h2").join(written(marked, "lines-marked-keys"), "h1", "left_semi")
                     .withColumn("pos", pos), "lines-marked")
    groups = (
        marked.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        .join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near or first < last")
        .select("h1", "h2", F.col("near").isNotNull().alias("near"), "first")
    )
    gone = marked.join(written(groups, "lines-groups"), ["h1", "h2"]).where("near or first < pos")
    return gone.groupBy("id", "key").agg(
        F.collect_set("no").alias("nos"),
        F.count_distinct(F.when(~F.col("near"), F.col("no"))).alias("equal"),
        F.count_distinct(F.when(F.col("near"), F.col("no"))).alias("near"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                counts: bool = False) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; with ``counts`` also lines, equal_dropped and near_dropped."""
    gone = written(dropped_lines(docs, min_chars=min_chars, id_col=id_col, text_col=text_col), "lines-gone").alias("g")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"),
                    F.xxhash64(F.col(text_col)).alias("key")).alias("d")
    joined = d.join(gone, F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.key") == F.col("g.key")), "left")
    joined = joined.withColumn("text", F.col("doc").getField(text_col))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("nos"), i))
    text = F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    if counts:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("lines"),
                F.coalesce("equal", F.lit(0)).alias("equal_dropped"), F.coalesce("near", F.lit(0)).alias("near_dropped")]
    return joined.select(*out)
