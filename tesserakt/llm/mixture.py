"""Mixing sources to target weights by capped water-filling.

Sources share the wanted number of words by their weights; a source stops at so many epochs of its own words, and
what it can't take goes to the others by their weights, until none is above (``shares``). A source that is to be read
1.4 times gives every document once whole, and of a second repetition as many documents as fill the target, in an order
that a seed fixes; the last of those gives its first words only, so the words taken meet the target to the word.

Nulls and odd input: a null text has no words; a null source is a source of its own, after all others; documents
without words take nothing but keep their row; a null id is an id of its own; equal rows share alike what the last of a repetition
gives (to less than a word each). An empty table gives no rows. Columns that the operator doesn't name stay out of its way.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.llm.common import materialise

#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a document's place in the seeded order, and those that one pass over the open cells looks at.
KEY_BITS, PASS_BITS = 60, 12
#: Rows of one source that a task puts in order; more are cut into finer cells before.
ORDERED = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(column: Column, seed: int) -> Column:
    """A document's place in the seeded order: the first 60 bits of an MD5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, keep_text: bool = False) -> DataFrame:
    """id, source, s (the source, never null), size, key, and the text if it's to be kept."""
    named = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(""))
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), named.alias("s"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col), seed).alias("key")]
    return docs.select(*columns, *([F.col(text_col).alias("text")] if keep_text else []))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with `position`, from 0, in the whole order; each range of the order is numbered by itself."""
    parts = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(counts.select("part", before.alias("before")), "part").select(*rows.columns, (F.col("before") + within).alias(name))


def shares(sources: DataFrame, weights: tuple[int, ...], share: Fraction, epochs: Fraction) -> DataFrame:
    """Of sources (source, s, total): with `target`, the words that each is to give.

    Each round takes one sum over the sources, so as many as there are can be mixed; rounds end when no more sources are full.
    """
    order = [F.col("source").asc_nulls_last()]
    at = numbered(sources, order, "position")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = at.withColumn("weight", weight.cast("long"))
    level, full = Fraction(0), F.lit(False)
    wanted = Fraction(share) * int(weighed.agg(F.sum("total")).first()[0] or 0)
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    while True:
        used, free = weighed.agg(F.sum(F.when(full, F.col("total"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:  # all are full
            target = F.col("total") * float(epochs)
            break
        risen = (wanted - epochs * int(used or 0)) / int(free)
        over = F.col("weight").cast("decimal(19,0)") * whole(risen.numerator * epochs.denominator) > F.col("total").cast("decimal(19,0)") * whole(risen.denominator * epochs.numerator)
        if risen == level:
            shared = (F.col("weight") * F.lit(risen.numerator)).cast("double") / F.lit(float(risen.denominator))
            target = F.when(over, F.col("total") * float(epochs)).otherwise(shared)
            break
        level, full = risen, over
    return weighed.withColumn("target", target.cast("double"))


def _limits(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source with a part of a repetition to give: `limit`, the last row in the seeded order that gives words, and the words that it gives.

    The order is never sorted whole: cells of places are summed, and only the cell in which a source's words run out is looked into.
    """
    state = sources.filter("extra > 0").select("s", "extra", F.lit(0).cast("long").alias("used"))
    rows, bits = sized.filter("size > 0").join(state, "s"), 0
    ordered = Window.partitionBy("s").orderBy("cell")
    while True:
        bits += PASS_BITS
        rows = rows.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
        cells = rows.groupBy("s", "cell", "extra", "used").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = cells.withColumn("upto", F.col("used") + F.sum("words").over(ordered))
        crossed = upto.withColumn("before", F.col("upto") - F.col("words")).filter("upto >= extra AND before < extra")
        rows = rows.drop("used").join(crossed.select("s", "cell", F.col("before").alias("used"), "n"), ["s", "cell"])
        rows = materialise(rows.drop("cell"), "open")
        if bits >= KEY_BITS or (rows.agg(F.max("n")).first()[0] or 0) <= ORDERED:
            break
        rows = rows.drop("n")
    alike = rows.groupBy("s", "extra", "used", "key", "id", "size").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("used") + F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("s").orderBy("key", "id", "size"))
    last = alike.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("m") * F.col("size")).filter("upto >= extra AND before < extra")
    return last.select("s", F.struct("key", "id", "size").alias("limit"), F.expr("(extra - before) div m").alias("rest"))


def _planned(docs: DataFrame, weights: tuple[int, ...], share: Fraction, epochs: Fraction, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents, and each source's total, target, whole repetitions, limit and rest."""
    sized = materialise(_sized(docs, seed, id_col, text_col, source_col), "sizes")
    sources = shares(sized.groupBy("source", "s").agg(F.sum("size").alias("total")), weights, Fraction(share), Fraction(epochs))
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("total"))
    plan = sources.join(_limits(sized, sources), "s", "left").select("s", F.col("total").alias("source_size"), "target", "whole", "limit", "rest")
    return sized, plan


def _taken() -> Column:
    point = F.struct("key", "id", "size")
    part = F.when(point < F.col("limit"), F.col("size")).when(point == F.col("limit"), F.col("rest"))
    return F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), epochs: Fraction = Fraction(2), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken: what the mix takes of each document, one row for each of docs."""
    sized, plan = _planned(docs, weights, share, epochs, seed, id_col, text_col, source_col)
    return sized.join(plan, "s").select(F.col("id").alias(id_col), "size", "source_size", "target", _taken().alias("taken"))


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), epochs: Fraction = Fraction(2), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: id, source, repetition (from 0) and the text that is taken; a part of a repetition has the text's first words, one space between them."""
    _, plan = _planned(docs, weights, share, epochs, seed, id_col, text_col, source_col)
    sized = _sized(docs, seed, id_col, text_col, source_col, True)  # the text stays beside the sizes, without a join by id
    rows = sized.join(plan, "s").withColumn("taken", _taken()).filter("taken > 0")
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
    words = F.least(F.col("taken") - F.col("repetition") * F.col("size"), F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words == F.col("size"), F.col("text")).otherwise(first)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "repetition", text.alias(text_col))
