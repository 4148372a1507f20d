"""Scans and sinks of training rows, corpora, metrics and program stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
CORPUS = "id string, contents string"


def read_files(spark: SparkSession, files: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet and JSON-lines files by their suffix, in one table; any other suffix is an error."""
    parts = []
    for f in files:
        kind = "parquet" if f.endswith(".parquet") else "json" if f.endswith((".json", ".jsonl")) else None
        if kind is None:
            raise ValueError(f"neither parquet nor json: {f}")
        reader = spark.read if schema is None else spark.read.schema(schema)
        parts.append(reader.format(kind).load(f))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sample_rows(df: DataFrame, most: int, order: str, seed: int | None = None) -> DataFrame:
    """The first rows by `order`, or, with a seed, rows of the least seeded hash: repeatable wherever it runs."""
    return df.orderBy(order).limit(most) if seed is None else df.orderBy(F.xxhash64(F.lit(seed), order), order).limit(most)


def without_long_prompts(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows whose prompt has `most` tokens at most; those that can't be counted (null) count as too long."""
    return df.filter(F.coalesce(tokens <= most, F.lit(False)))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, title (first line, without quotes) and text of a JSON-lines corpus."""
    rows = spark.read.schema(CORPUS).json(path)
    parts = F.split("contents", "\n", 2)
    return rows.select("id", F.regexp_replace(F.get(parts, F.lit(0)), '"', "").alias("title"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def training_row(source: Column, question: Column, truth: Column, split: str, index: Column, ability: str = "fact-reasoning") -> list[Column]:
    """The nested columns of a training row."""
    return [
        source.alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info"),
    ]


def hops(metadata: Column) -> Column:
    """Number of parts of a question; null metadata has none."""
    return F.coalesce(F.size(metadata["question_decomposition"]), F.lit(0))


def extra_info(text: Column, schema: str = "map<string,string>") -> Column:
    """Extra information kept as JSON text; what can't be read is empty."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def write_steps(df: DataFrame, path: str, step: str) -> None:
    """JSON lines, a folder a step; a step written again replaces itself alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def price(models: DataFrame, calls: DataFrame, model: str, tokens: str, threshold: str, low: str, high: str) -> DataFrame:
    """Cost of each call from a table of prices a million tokens, with a second price beyond a threshold. The table is small by nature and checked by the optimiser."""
    rate = F.when(F.col(threshold).isNotNull() & (F.col(tokens) > F.col(threshold)), F.col(high)).otherwise(F.col(low))
    return calls.join(models, model, "left").withColumn("cost", F.col(tokens) * rate / 1e6)


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs to columns named by their path."""

    def walk(fields: list[T.StructField], path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return df.select(*walk(df.schema.fields, ()))


def action_spans(ids: Column, assistant: Column) -> Column:
    """Loss mask of a conversation: 1 on tokens of the assistant's turns."""
    return F.flatten(F.zip_with(ids, assistant, lambda x, a: F.transform(x, lambda _t: F.when(a, 1).otherwise(0))))


def preference_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows for each preference: the prompt with the chosen and with the rejected answer, told apart by `kind`."""
    pair = F.array(F.struct(F.lit("chosen").alias("kind"), F.col(chosen).alias("answer")), F.struct(F.lit("rejected").alias("kind"), F.col(rejected).alias("answer")))
    return df.select(F.col(prompt).alias("prompt"), F.explode(pair).alias("_x")).select("prompt", "_x.kind", F.concat("prompt", F.lit(" "), F.col("_x.answer")).alias("text"))


def preference_variants(df: DataFrame, prompt: str, chosen: str, rejected: str, source: str, split: str, index: str) -> dict[str, DataFrame]:
    """The same preferences as rows of three trainings: rm (prompt, chosen, rejected), sft (prompt, answer) and rl (training rows)."""
    return {
        "rm": df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")),
        "sft": df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("response")),
        "rl": df.select(*training_row(F.lit(source), F.col(prompt), F.col(chosen), split, F.col(index), "alignment")),
    }


def by_ordinal(hits: DataFrame, corpus: DataFrame, ordinal: str) -> DataFrame:
    """The corpus rows that hits name by their number, as often as they name them."""
    return hits.join(corpus, ordinal)


def metric_rows(df: DataFrame, step: str, names: list[str]) -> DataFrame:
    """Wide metrics as rows of step, key and value, the keys as metric stores take them; nulls are left out."""
    from tesserakt.functions.text import metric_key

    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("double").alias("value")) for n in names))
    return df.select(step, F.explode(pairs).alias("_x")).select(step, metric_key(F.col("_x.key")).alias("key"), "_x.value").filter("value IS NOT NULL")


def message_parts(text: Column) -> Column:
    """Parts of a message in order: text, or the image or video that a placeholder stands for."""
    marks = F.regexp_extract_all(text, F.lit("<(image|video)>"), F.lit(1))
    texts = F.split(text, "<(?:image|video)>")
    of = lambda kind, body: F.struct(kind.alias("type"), body.alias("text"))
    both = F.transform(texts, lambda t, i: F.array(of(F.lit("text"), t), of(F.coalesce(F.get(marks, i), F.lit("none")), F.lit(""))))
    return F.filter(F.flatten(both), lambda x: (x["type"] != "none") & ((x["type"] != "text") | (x["text"] != "")))
