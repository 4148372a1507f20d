"""Scalar functions on answers, tags and templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Fixed value: the wording of a retrieval question for base models.
BASE_PROMPT = (
    "Answer the given question. "
    "You must conduct reasoning inside <think> and </think> first every time you get new information. "
    "After reasoning, if you find you lack some knowledge, you can call a search engine by <search> query </search> and it will return the top searched results between <information> and </information>. "
    "You can search as many times as your want. "
    "If you find no further external knowledge needed, you can directly provide the answer inside <answer> and </answer>, without detailed illustrations. For example, <answer> Beijing </answer>. "
    "Question: "
)


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces, in this order."""
    x = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def exact_match(pred: Column, golds: Column) -> Column:
    """1 if any gold answer equals the prediction, both normalised."""
    return F.when(F.exists(golds, lambda g: normalise_answer(g) == normalise_answer(pred)), 1).otherwise(0)


def contains_match(pred: Column, golds: Column) -> Column:
    return F.when(F.exists(golds, lambda g: F.contains(normalise_answer(pred), normalise_answer(g))), 1).otherwise(0)


def _let(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it: bodies of lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common, as often as they occur in both: one sort of all, then lengths of runs."""
    every = F.sort_array(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(0).alias("of"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(1).alias("of")))))

    def counted(z: Column) -> Column:
        begins = F.filter(F.transform(z, lambda x, i: F.when(~x.eqNullSafe(F.get(z, i - 1)), i)), lambda i: i.isNotNull())
        return _let(F.concat(begins, F.array(F.size(z), F.size(z))), lambda at: F.aggregate(F.transform(at, lambda i, k: _common(z, at, i, k)), F.lit(0), lambda n, x: n + x))

    def _common(z: Column, at: Column, i: Column, k: Column) -> Column:
        """Of a run of the first array's element, what the next run, if it is the same of the second array, shares."""
        then = F.get(at, k + 1)
        return F.when(F.get(z, i)["x"] == F.get(z, then)["x"], F.least(then - i, F.get(at, k + 2) - then)).otherwise(0)

    return _let(every, counted)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the word multisets; yes, no and noanswer only match themselves."""
    special = ["yes", "no", "noanswer"]
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")

    def score(s: Column) -> Column:
        f1 = F.when(s["same"] == 0, 0.0).otherwise(2.0 * s["same"] / s["all"])
        return F.when((s["p"].isin(special) | s["g"].isin(special)) & (s["p"] != s["g"]), 0.0).otherwise(f1)

    both = F.struct(normalise_answer(pred).alias("p"), normalise_answer(gold).alias("g"))
    split = lambda s: F.struct(s["p"].alias("p"), s["g"].alias("g"), words(s["p"]).alias("a"), words(s["g"]).alias("b"))
    counted = lambda s: F.struct(s["p"].alias("p"), s["g"].alias("g"), overlap(s["a"], s["b"]).alias("same"), (F.size(s["a"]) + F.size(s["b"])).alias("all"))
    return _let(_let(_let(both, split), counted), score)


def best_f1(pred: Column, golds: Column) -> Column:
    return F.array_max(F.transform(golds, lambda g: token_f1(pred, g)))


def answers(text: Column) -> Column:
    """Contents of all answer tags, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), lambda x: F.trim(x))


def last_answer(text: Column, at_least: int = 1) -> Column:
    """The last answer; null with fewer tags than `at_least` (2 where the prompt shows one)."""
    found = answers(text)
    return F.when(F.size(found) >= at_least, F.element_at(found, -1))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def first_action(text: Column) -> Column:
    """kind and content of the first search or answer tag; nulls without one."""
    pattern = r"(?s)<(search|answer)>(.*?)</\1>"
    kind = F.regexp_extract(text, pattern, 1)
    return F.struct(F.when(kind != "", kind).alias("kind"), F.when(kind != "", F.trim(F.regexp_extract(text, pattern, 2))).alias("content"))


def actions(text: Column, kinds: tuple[str, ...] = ("think", "search", "answer", "information")) -> Column:
    """All tags in order: kind in lower case and trimmed content."""
    pattern = r"(?si)<(" + "|".join(kinds) + r")>(.*?)</\1>"
    names, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(names, bodies, lambda k, b: F.struct(F.lower(k).alias("kind"), F.trim(b).alias("content")))


def valid_sequence(text: Column, marker: str = "<|im_start|>assistant") -> Column:
    """After the first mark of the assistant's turn: think, any number of search, information, think, then one answer, and nothing between; without the mark it isn't valid."""
    inside = r"[^<]*+(?:<(?!/?(?:think|search|information|answer)>)[^<]*+)*+"
    turn = r"\s*+<{0}>" + inside + r"</{0}>\s*+"
    think, search, info, answer = (turn.replace("{0}", x) for x in ("think", "search", "information", "answer"))
    said = F.when(F.contains(text, F.lit(marker)), F.substr(text, F.locate(marker, text) + len(marker), F.length(text)))
    return F.coalesce(said.rlike(rf"(?s)^(?:{think})(?:{search}{info}{think})*{answer}$"), F.lit(False))


def score_tiers(f1: Column, valid: Column, retrieved: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, variant: str = "f1") -> Column:
    """Tiered reward. em: what is right scores 1 or 1 - structure, what is wrong by its format. f1: the F1 takes the place of 1, and wrong and invalid is 0."""
    if variant == "em":
        return F.when(f1 >= 1, F.when(valid, 1.0).otherwise(1 - structure)).when(valid, F.when(retrieved, structure + retrieval).otherwise(structure)).otherwise(final)
    return F.when(f1 > 0, F.when(valid, f1).otherwise(f1 - structure)).when(valid, F.when(retrieved, structure + retrieval).otherwise(structure)).otherwise(0.0)


def final_number(text: Column, method: str = "strict") -> Column:
    """strict: the number after ####; flexible: the last number of the text. Without commas and dollar signs."""
    if method == "strict":
        found = F.regexp_extract(text, r"#### (\-?[0-9.,]+)", 1)
        return F.when(found != "", F.regexp_replace(found, "[,$]", ""))
    numbers = F.filter(F.regexp_extract_all(text, F.lit(r"(\-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.when(F.size(numbers) > 0, F.element_at(numbers, -1))


def number_score(text: Column, truth: Column, method: str = "strict", format_score: float = 0.0) -> Column:
    found = final_number(text, method)
    return F.when(found.isNull(), 0.0).when(found == truth, 1.0).otherwise(format_score)


def with_question_mark(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.endswith(t, F.lit("?")), t).otherwise(F.concat(t, F.lit("?")))


def base_prompt(question: Column, template: str = "base") -> Column:
    if template != "base":
        raise NotImplementedError(template)
    return F.concat(F.lit(BASE_PROMPT), question, F.lit("\n"))


def estimated_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")) * 1.3).cast("long")


def abstractions(words: Column, width: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    """The text, and it with each span of 1 to `width` words replaced by [X]; spans of stopwords alone are left."""
    n = F.size(words)
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")

    def spans(w: int) -> Column:
        def one(i: Column) -> Column:
            span = F.slice(words, i, w)
            text = F.array_join(F.concat(F.slice(words, 1, i - 1), F.array(F.lit("[X]")), F.slice(words, i + w, F.greatest(n - i - w + 1, F.lit(0)))), " ")
            return F.when(F.forall(span, lambda x: F.array_contains(stop, F.lower(x))), F.lit(None).cast("string")).otherwise(text)

        return F.when(n >= w, F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), one)).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.array(F.array_join(words, " ")), *(spans(w) for w in range(1, width + 1)))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def question_reference(text: Column) -> Column:
    return F.regexp_replace(text, r"#\d+", "[X]")


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).cast("long") * 3600 + F.get(p, F.lit(1)).cast("long") * 60 + F.get(p, F.lit(2)).cast("long")


def metric_key(text: Column) -> Column:
    """Characters that metric stores refuse become underscores."""
    return F.regexp_replace(F.replace(text, F.lit("@"), F.lit("_at_")), r"[^A-Za-z0-9/_\-. ]", "_")


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start mark and the next end mark; null without either."""
    at = F.locate(start, text)
    rest = F.substr(text, at + len(start), F.length(text))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 0), F.substr(rest, F.lit(1), stop - 1))


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def pattern_counts(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).alias(name) for name, p in patterns.items()]


def last_boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} or \\fbox{...} with balanced braces; null without one.

    The text after the last mark is cut at braces, and the depth is counted piece by piece.
    """
    back = F.reverse(text)
    marks = F.filter(F.array(F.locate("{dexob\\", back), F.locate("{xobf\\", back)), lambda p: p > 0)
    there = F.size(marks) > 0
    rest = F.when(there, F.substr(text, F.length(text) - F.array_min(marks) + 2, F.length(text))).otherwise(F.lit(""))
    pieces = F.regexp_extract_all(rest, F.lit(r"([^{}]*[{}])"), F.lit(1))
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("end"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(F.endswith(p, F.lit("{")), 1).otherwise(-1)
        here = acc["at"] + F.length(p)
        return F.struct(depth.alias("depth"), F.when((acc["end"] == 0) & (depth == 0), here).otherwise(acc["end"]).alias("end"), here.alias("at"))

    end = F.aggregate(pieces, zero, step, lambda a: a["end"])
    return F.when(there & (end > 0), F.substr(rest, F.lit(1), end - 1))


def same_mapping(found: Column, truth: Column) -> Column:
    """Whether two JSON objects hold the same keys (case and outer spaces aside) with the same whole numbers."""
    read = lambda c: F.transform(F.map_entries(F.from_json(F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), r",\s*}", "}"), "map<string,string>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].try_cast("int").alias("v")))
    return F.coalesce(F.sort_array(read(found)) == F.sort_array(read(truth)), F.lit(False))
