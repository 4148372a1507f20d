"""Row algebra of batches: positions are a column, as rows of a DataFrame have no order of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_columns(a: DataFrame, b: DataFrame, pos: str) -> DataFrame:
    """Columns of both by position. Columns that both have must agree (null and NaN equal themselves), and positions too."""
    shared = [c for c in a.columns if c in b.columns and c != pos]
    right = b.select(F.col(pos).alias("_p"), *(F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != pos))
    both = a.join(right, F.col(pos) == F.col("_p"), "full")
    clash = F.col(pos).isNull() | F.col("_p").isNull()
    for c in shared:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    checked = F.when(clash, F.raise_error(F.lit("batches differ in rows or in a column that both have"))).otherwise(F.col(pos))
    return both.withColumn(pos, checked).drop("_p", *(f"_b_{c}" for c in shared))


def repeat(df: DataFrame, pos: str, times: int | str, interleave: bool = True, rows: int | None = None) -> DataFrame:
    """Each row `times` times (a number or a column): AABB, or ABAB with `rows` positions in all. New positions from 0."""
    count = F.lit(times) if isinstance(times, int) else F.col(times)
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1))) if isinstance(times, int) else df.filter(count > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))
    if not isinstance(times, int):
        return out.withColumnRenamed("_i", "copy")
    n = df.count() if rows is None and not interleave else rows
    new = F.col(pos) * times + F.col("_i") if interleave else F.col("_i") * n + F.col(pos)
    return out.withColumn(pos, new.cast("long")).drop("_i")


def take(df: DataFrame, pos: str, start: int | None = None, end: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step ... below end; positions stay."""
    s = start or 0
    kept = (F.col(pos) >= s) & ((F.col(pos) - s) % step == 0)
    return df.filter(kept if end is None else kept & (F.col(pos) < end))


def reorder(df: DataFrame, order: DataFrame, pos: str, index: str, new: str) -> DataFrame:
    """Row `index` at position `new`; an index may occur often or never."""
    return order.select(F.col(index).alias("_i"), F.col(new).alias("_new")).join(df, F.col("_i") == F.col(pos)).drop(pos, "_i").withColumnRenamed("_new", pos)


def inverse(order: DataFrame, index: str, new: str) -> DataFrame:
    return order.select(F.col(new).alias(index), F.col(index).alias(new))


def chunks(df: DataFrame, pos: str, n: int, rows: int) -> DataFrame:
    """Chunk of each row when `rows` positions are cut into n contiguous parts; they must divide."""
    if rows % n:
        raise ValueError(f"{rows} rows don't divide into {n}")
    return df.withColumn("chunk", F.floor(F.col(pos) / (rows // n)).cast("int"))


def concat(parts: list[DataFrame], pos: str) -> DataFrame:
    """One after another; a part's positions follow those before it."""
    whole = reduce(DataFrame.unionByName, (p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)))
    sizes = whole.groupBy("_part").agg((F.max(pos) + 1).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a part
    return whole.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(pos, F.col(pos) + F.col("_start")).drop("_part", "_start")


def unfold(df: DataFrame, pos: str, n: int, columns: list[str]) -> DataFrame:
    """Cut array columns into n equal stretches, a row each; other columns repeat."""
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        size = (F.size(c) / n).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("_i") * size + 1, size))
    return out.withColumn(pos, (F.col(pos) * n + F.col("_i")).cast("long")).drop("_i")


def pad_to_multiple(df: DataFrame, pos: str, rows: int, divisor: int) -> DataFrame:
    """Rows from the start once more until the number divides."""
    missing = -rows % divisor
    if not missing or not rows:
        return df
    copies = [df.filter(F.col(pos) < missing - k * rows).withColumn(pos, F.col(pos) + (k + 1) * rows) for k in range(-(-missing // rows))]
    return reduce(DataFrame.unionByName, copies, df)


def pad_array(values: Column, length: int, fill: int = 0, left: bool = False, truncation: str = "right") -> Column:
    """An array of exactly `length`: padded, or cut left, right or in the middle; truncation error raises."""
    n = F.size(values)
    missing = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - n, F.lit(0)))
    padded = F.concat(missing, values) if left else F.concat(values, missing)
    half = length // 2
    cut = {
        "left": F.slice(values, n - length + 1, F.lit(length)),
        "right": F.slice(values, 1, length),
        "middle": F.concat(F.slice(values, 1, half), F.slice(values, n - (length - half) + 1, F.lit(length - half))),
        "error": F.raise_error(F.lit("longer than allowed")).cast("array<int>"),
    }
    if truncation not in cut:
        raise ValueError(f"truncation is one of {sorted(cut)}")
    return F.when(n <= length, padded).otherwise(cut[truncation])


def response_mask(ids: Column, end: int) -> Column:
    """1 up to and with the first end token."""
    at = F.array_position(ids, end)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running number of kept tokens from 0, 0 where masked: kept tokens are sorted before masked ones, numbered, and sorted back."""
    kept_first = F.sort_array(F.transform(mask, lambda m, i: F.struct((1 - m).alias("masked"), i.alias("at"))))
    ranked = F.transform(kept_first, lambda x, i: F.struct(x["at"].alias("at"), F.when(x["masked"] == 0, i).otherwise(0).alias("n")))
    return F.transform(F.sort_array(ranked), lambda x: x["n"])


def without_pads(ids: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["i"])


def missing_numbers(df: DataFrame, number: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Numbers of first..last that no row has; by default between the least and the greatest that some row has."""
    if first is None or last is None:
        low, high = df.agg(F.min(number), F.max(number)).first()
        first, last = (low if first is None else first) or 0, (high if last is None else last) or -1
    return df.sparkSession.range(first, last + 1).select(F.col("id").alias(number)).join(df.select(number), number, "left_anti")


def run_positions(df: DataFrame, pos: str, index: str, batch: list[str]) -> DataFrame:
    """Position within the run of consecutive equal values, batch by batch, by the difference of two numberings."""
    w = Window.partitionBy(*batch).orderBy(pos)
    change = F.when(F.col(index).eqNullSafe(F.lag(index).over(w)), 0).otherwise(1)
    df = df.withColumn("_c", change)
    df = df.withColumn("_run", F.sum("_c").over(w))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*batch, "_run").orderBy(pos)) - 1).drop("_c", "_run")


def renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Columns under new names; both lists have to be of one length, and all old names have to be there."""
    if len(old) != len(new) or not set(old) <= set(df.columns):
        raise ValueError(f"can't rename {old} to {new}")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def chosen(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The named columns, or all of them; a name that isn't there is an error."""
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no columns {missing}")
    return df.select(*columns)


def popped(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the others."""
    return chosen(df, columns), df.drop(*columns)


def folded(df: DataFrame, pos: str, k: int, columns: list[str]) -> DataFrame:
    """k rows in one: arrays in the order of `pos`, which counts the groups."""
    at = F.array_sort(F.collect_list(F.struct(pos, *columns)))
    rows = df.groupBy(F.floor(F.col(pos) / k).alias("_g")).agg(at.alias("_x"))
    return rows.select(F.col("_g").alias(pos), *(F.col("_x")[c].alias(c) for c in columns))


def unfolded(df: DataFrame, pos: str, k: int, columns: list[str]) -> DataFrame:
    """The inverse of folded."""
    rows = df.select(pos, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_x"))
    return rows.select((F.col(pos) * k + F.col("_i")).alias(pos), *(F.col("_x")[c].alias(c) for c in columns))


def last_columns(mask: Column, n: Column | int) -> Column:
    """The part of an attention mask that belongs to the response: its last n entries."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.slice(mask, -n, n)).otherwise(F.slice(mask, 1, 0))


def loss_mask(response: Column, own: Column) -> Column:
    """The response mask without what was retrieved and not generated."""
    return F.zip_with(response, own, lambda a, b: a * b)


def gathered(prompts: DataFrame, rollouts: DataFrame, uid: str) -> DataFrame:
    """The columns of each rollout's prompt beside it, however many rollouts a prompt has."""
    return rollouts.join(prompts, uid)


def as_lists(df: DataFrame, pos: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns as one array each, in the order of `pos`, of all rows or of each batch."""
    rows = df.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("_x"))
    return rows.select(*(by or []), *(F.col("_x")[c].alias(c) for c in columns))


def uneven(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose array columns aren't all of one length: none in a consistent batch."""
    first, *rest = (F.size(c) for c in columns)
    test = F.lit(False)
    for n in rest:
        test = test | (n != first)
    return df.filter(test)
