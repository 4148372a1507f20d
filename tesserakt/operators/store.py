"""The store of programs: archives, elites, islands, and what their upkeep asks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_archive_flag(programs: DataFrame, archive: DataFrame, key: str, flag: str = "in_archive") -> DataFrame:
    """All programs, each with whether the archive names it."""
    named = archive.select(F.col(key).alias("_k")).distinct()
    return programs.join(named, F.col(key) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def archived(programs: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    return programs.join(archive.select(key).distinct(), key, "left_semi")


def elites(programs: DataFrame, archive: DataFrame, key: str, group: list[str], correct: str, score: str, n: int) -> DataFrame:
    """The n best archived and correct programs of each island, `place` from 1; ties to the smaller key."""
    rows = archived(programs, archive, key).filter(F.col(correct))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key))).filter(F.col("place") <= n)


def best_without(programs: DataFrame, excluded: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The n best programs that aren't excluded."""
    return programs.join(excluded.select(key), key, "left_anti").orderBy(F.desc(score), key).limit(n)


def correct_children(programs: DataFrame, key: str, parent: str, correct: str, score: str, n: int) -> DataFrame:
    """Of every parent, its n best correct children."""
    w = Window.partitionBy(parent).orderBy(F.desc(score), key)
    return programs.filter(F.col(parent).isNotNull() & F.col(correct)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def satisfied_goals(programs: DataFrame, scores: str, correct: str, threshold: float) -> DataFrame:
    """How many correct programs reach the threshold at each goal of a JSON object; true counts as 1, other text as nothing."""
    each = programs.filter(F.col(correct)).select(F.explode(F.from_json(scores, "map<string,string>")).alias("goal", "value"))
    value = F.when(F.col("value") == "true", 1.0).otherwise(F.col("value").try_cast("double"))
    return each.filter(value >= threshold).groupBy("goal").agg(F.count(F.lit(1)).alias("n"))


def greatest_generation(programs: DataFrame, generation: str, correct: str) -> DataFrame:
    """One row; null if no program is correct."""
    return programs.agg(F.max(F.when(F.col(correct), F.col(generation))).alias("generation"))


def prompt_fitness(programs: DataFrame, prompt: str, percentile: str, correct: str) -> DataFrame:
    """Mean percentile of each prompt's correct programs, and how many there are; null without any."""
    on = F.when(F.col(correct), F.col(percentile))
    return programs.groupBy(prompt).agg(F.avg(on).alias("fitness"), F.count(on).alias("n"))


def fitness_of_listed(prompts: DataFrame, prompt: str, ids: str, programs: DataFrame, key: str, score: str) -> DataFrame:
    """Mean score of the programs that each prompt lists; listed ones that aren't there count for nothing."""
    each = prompts.select(prompt, F.explode(ids).alias(key))
    return each.join(programs.select(key, score), key).groupBy(prompt).agg(F.avg(score).alias("fitness"), F.count(F.lit(1)).alias("n"))


def total_cost(rows: DataFrame, metadata: str, path: str) -> DataFrame:
    """Sum of a number in JSON metadata over all rows; rows without it are passed over."""
    return rows.agg(F.sum(F.get_json_object(metadata, path).try_cast("double")).alias("cost"))


def better_first(correct: Column, score: Column, public: Column, added: Column) -> list[Column]:
    """Order of an archive: correct ones, score, mean public metric, the newest."""
    return [F.desc(correct), F.desc_nulls_last(score), F.desc_nulls_last(public), F.desc(added)]


def kept_archive(archive: DataFrame, arrivals: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The best `size` of archive and arrivals: what replacing the worst by a better arrival comes to, in whatever order they arrive."""
    return archive.unionByName(arrivals, allowMissingColumns=True).orderBy(*order).limit(size)


def kept_prompts(prompts: DataFrame, programs: str, least: int, fitness: str, key: str, size: int) -> DataFrame:
    """The same for prompts; those tried by fewer than `least` programs come last."""
    return prompts.orderBy(F.desc(F.col(programs) >= least), F.desc_nulls_last(fitness), key).limit(size)


def crowding_archive(programs: DataFrame, group: list[str], key: str, added: str, score: str, embedding: str, size: int) -> DataFrame:
    """The archive of each group after its programs arrived in the order of `added`.

    While there is room, a program goes in. Then it competes with the archived
    program of the most similar embedding (cosine), without an embedding with the
    worst one, and takes its place if it scores more. The arrivals of one group are
    replayed in one task: groups are islands, whose programs one evolution run makes.
    """
    names = [*group, key]
    kinds = dict(programs.dtypes)

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held: list[tuple] = []  # key, score, unit vector
        frame = frame.sort_values([added, key])
        for k, s, e in zip(frame[key], frame[score], frame[embedding], strict=True):
            v = None if e is None else np.asarray(e, float)
            v = None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v)
            if len(held) < size:
                held.append((k, s, v))
                continue
            near = [-2.0 if v is None or h[2] is None else float(v @ h[2]) for h in held]
            at = int(np.argmax(near)) if max(near) > -2 else min(range(size), key=lambda i: (held[i][1], held[i][0]))
            if s > held[at][1]:
                held[at] = (k, s, v)
        return pd.DataFrame([(*keys, h[0]) for h in held], columns=names)

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return programs.select(*dict.fromkeys([*names, added, score, embedding])).groupBy(*group).applyInPandas(run, schema)


def first_and_last(programs: DataFrame, group: list[str], generation: str, key: str) -> DataFrame:
    """Of each island the program of the first generation (and least id) and the one of the last."""
    at = F.struct(generation, key)
    return programs.groupBy(*group).agg(F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"))


def beam_parent(programs: DataFrame, group: list[str], key: str, parent: str, score: str, beams: int) -> DataFrame:
    """Of each island the best program that has fewer than `beams` children: the one that goes on being the parent."""
    children = programs.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.count(F.lit(1)).alias("children"))
    rows = programs.join(children, key, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    best = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return rows.filter(F.col("children") < beams).withColumn("_i", F.row_number().over(best)).filter("_i = 1").drop("_i")


def emptiest_islands(programs: DataFrame, island: str) -> DataFrame:
    """The islands with the fewest programs; a seeded draw among them is the caller's."""
    n = programs.groupBy(island).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.min("n").alias("_least"))), F.col("n") == F.col("_least")).drop("_least")  # one row is broadcast


def empty_island(programs: DataFrame, island: str, correct: str, islands: int) -> DataFrame:
    """One row: the lowest of `islands` numbers that no correct program has; null if all have one."""
    all_ = programs.sparkSession.range(islands).select(F.col("id").cast("int").alias(island))
    return all_.join(programs.filter(F.col(correct)).select(island), island, "left_anti").agg(F.min(island).alias(island))


def assigned_island(programs: DataFrame, key: str, parent: str, island: str, empty: Column, chance: Column, parent_first: bool = False) -> DataFrame:
    """The island of each program: an empty one, else its parent's, else one by chance; `parent_first` turns the first two round."""
    up = programs.select(F.col(key).alias("_k"), F.col(island).alias("_up"))
    rows = programs.join(up, F.col(parent) == F.col("_k"), "left").drop("_k")
    order = (F.col("_up"), empty) if parent_first else (empty, F.col("_up"))
    return rows.withColumn("assigned", F.coalesce(*order, chance)).drop("_up")


def copied_to_islands(programs: DataFrame, key: str, island: str, islands: int) -> DataFrame:
    """Each program on every other island, under a new id made of the old one and the island."""
    others = F.filter(F.sequence(F.lit(0), F.lit(islands - 1)), lambda i: i != F.col(island))
    copy = programs.withColumn("_to", F.explode(others))
    return copy.withColumn("copied_from", F.col(key)).withColumn(key, F.concat_ws("@", F.col(key).cast("string"), F.col("_to").cast("string"))).withColumn(island, F.col("_to")).drop("_to")


def spawned_island(programs: DataFrame, subtree: DataFrame, key: str, parent: str, island: str, islands: int) -> DataFrame:
    """Copies of a subtree (its keys) on a new island: new ids, parents within the subtree, none for its root.

    The new island's number is one more than the greatest, `islands` at least.
    """
    number = programs.agg(F.greatest(F.max(island) + 1, F.lit(islands)).alias("_new"))  # one row
    inside = subtree.select(F.col(key).alias("_k")).distinct()
    new = lambda c: F.concat_ws("#", c.cast("string"), F.col("_new").cast("string"))
    rows = programs.join(inside, F.col(key) == F.col("_k"), "left_semi").join(F.broadcast(number))
    rows = rows.join(inside, F.col(parent) == F.col("_k"), "left")
    return rows.withColumn(parent, F.when(F.col("_k").isNotNull(), new(F.col(parent)))).withColumn(key, new(F.col(key))).withColumn(island, F.col("_new")).drop("_k", "_new")


def migrated(programs: DataFrame, moves: DataFrame, key: str, island: str, history: str, step: Column) -> DataFrame:
    """Programs after moves (key, to): on the new island, the move written down in their history."""
    rows = programs.join(moves.select(F.col(key).alias("_k"), F.col("to").alias("_to")), F.col(key) == F.col("_k"), "left")
    note = F.struct(step.alias("generation"), F.col(island).alias("from"), F.col("_to").alias("to"))
    rows = rows.withColumn(history, F.when(F.col("_to").isNotNull(), F.array_append(F.col(history), note)).otherwise(F.col(history)))
    return rows.withColumn(island, F.coalesce("_to", island)).drop("_k", "_to")


def migration_due(generation: Column, interval: int) -> Column:
    return (generation > 0) & (generation % interval == 0)


def running_best(programs: DataFrame, group: list[str], order: list[str], correct: str, score: str) -> DataFrame:
    """Every program with the best correct score up to it, and whether it is what raised it."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(correct), F.col(score))
    earlier = F.max(own).over(before)
    return programs.withColumn("best", F.greatest(earlier, own)).withColumn("raised", F.coalesce(own > earlier, own.isNotNull()))


def criterion(metadata: Column, score: Column, name: str) -> Column:
    """A number that programs are compared by: the score, or one of the code metrics with its default; another name gives 0."""
    defaults = {"loc": 1.0, "lloc": 1.0, "complexity": 1.0, "maintainability": 100.0, "nesting": 1.0}
    if name == "score":
        return F.coalesce(score, F.lit(0.0))
    if name not in defaults:
        return F.lit(0.0)
    return F.coalesce(F.get_json_object(metadata, f"$.{name}").try_cast("double"), F.lit(defaults[name]))


def metrics_of(json: Column) -> Column:
    """Parsed metrics; an empty map where there are none or the JSON is bad."""
    return F.coalesce(F.from_json(json, "map<string,double>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
