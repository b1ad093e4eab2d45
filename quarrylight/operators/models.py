"""Where a language model has a say: its answers are a column, joined by the hash of the prompt or made by a function.

No operator here calls a model itself. `ask` takes answers from a table (prompt_hash, answer), `generate` from a function
that the caller passes; a missing, broken or empty answer always leaves the rule that holds without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as T
from ..functions.urls import blank
from . import planning as P

DECISION = "search string, query string, reason string, category string, depth string, verified_sources_required string, url string"
MODES = ("llm_primary", "llm_only", "legacy")


def ask(rows: DataFrame, prompt: Column, answers: DataFrame, name: str = "answer") -> DataFrame:
    """rows plus the answer to each row's prompt, null where the table has none."""
    known = answers.select(F.col("prompt_hash").alias("__h"), F.col("answer").alias(name)).dropDuplicates(["__h"])
    return rows.withColumn("__h", F.sha2(prompt, 256)).join(known, "__h", "left").drop("__h")


def generate(rows: DataFrame, prompt: Column, function: Callable[[str], str], name: str = "answer") -> DataFrame:
    """rows plus the function's answer to each row's prompt, in Arrow batches; an error of the function gives a null."""

    def one(text: str | None) -> str | None:
        try:
            return function(text or "")
        except Exception:  # noqa: BLE001  (whatever the caller's function raises, the rule without a model holds)
            return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(one, na_action=None)

    return rows.withColumn(name, run.asNondeterministic()(prompt))


def body(answer: Column) -> Column:
    """From the first brace of an answer to the last, null without any."""
    return F.nullif(F.regexp_extract(blank(answer), r"(?s)\{.*\}", 0), F.lit(""))


def semantic_decision(rows: DataFrame, year: int, message: str = "message", answer: str = "answer") -> DataFrame:
    """rows plus should_search, category, search_query, confidence, reason, depth, verified and url, from the answer."""
    m = F.col(message)
    read = rows.withColumn("__json", P.decision_json(F.col(answer))).withColumn("__d", F.from_json("__json", DECISION))
    d = lambda c: F.col(f"__d.{c}")
    search = ~F.lower(F.coalesce(d("search"), F.lit("false"))).isin("false", "0", "", "null", "[]", "{}")
    read = read.withColumn("__yes", F.col("__json").isNotNull() & search)
    yes = F.col("__yes")
    category = F.when(yes, F.coalesce(I.category_from_llm(d("category")), F.lit("general")))
    query = F.trim(blank(d("query")))
    asked = F.when(query != "", query).otherwise(I.optimize_query(m, F.coalesce(category, F.lit("general")), year))
    reason = F.when(F.col("__json").isNull(), F.lit("semantic LLM: no JSON")).otherwise(F.coalesce(F.nullif(d("reason"), F.lit("")), F.lit("semantic_classifier")))
    url = F.trim(blank(d("url")))
    return read.select(
        *rows.columns,
        yes.alias("should_search"),
        category.alias("category"),
        F.when(yes, asked).otherwise(F.lit("")).alias("search_query"),
        F.when(F.col("__json").isNull(), F.lit(0.0)).otherwise(F.lit(0.88)).alias("confidence"),
        reason.alias("reason"),
        F.when(yes, I.depth_from_llm(d("depth"))).otherwise(F.lit("fast")).alias("depth"),
        I.truthy(d("verified_sources_required")).alias("verified"),
        F.when(F.startswith(url, F.lit("http")), url).otherwise(F.lit("")).alias("url"),
    )


def classify(rows: DataFrame, year: int, mode: str = "llm_primary", has_model: bool = True, fallback: bool = False) -> DataFrame:
    """rows (.., message, answer) plus should_search, category, search_query, confidence and reason.

    llm_primary: small talk is skipped, then the model decides, and the rules where its answer is no JSON. llm_only: the
    model alone. legacy: the rules alone. Without a model both llm modes decline, or take the rules if `fallback`.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    cols = ["should_search", "category", "search_query", "confidence", "reason"]
    if mode == "legacy" or (fallback and not has_model and mode == "llm_only"):
        return I.legacy_decision(rows, year)
    by_rule = I.legacy_decision(rows, year).select(*rows.columns, F.struct(*cols).alias("__rule"))
    said = semantic_decision(by_rule, year).select(*rows.columns, "__rule", F.struct(*cols).alias("__said"))
    none = lambda reason: F.struct(F.lit(False).alias(cols[0]), F.lit(None).cast("string").alias(cols[1]), F.lit("").alias(cols[2]), F.lit(0.0).alias(cols[3]), F.lit(reason).alias(cols[4]))
    if mode == "llm_only":
        picked = F.col("__said") if has_model else none("llm_only_requires_generate_fn")
    else:
        by_model = F.when(F.col("__said.reason") == "semantic LLM: no JSON", F.col("__rule")).otherwise(F.col("__said"))
        without = F.col("__rule") if fallback else none("llm_primary_requires_generate_fn")
        picked = F.when(I.is_trivial_no(F.trim("message")), none("trivial_skip_llm_primary")).otherwise(by_model if has_model else without)
    return said.withColumn("__picked", picked).select(*rows.columns, "__picked.*")


def model_plans(answer: Column, most: int = 5) -> Column:
    """Array of (agent_id, role, query) from a planner's answer: of its first `most` entries those with a query of six characters."""
    read = F.from_json(body(answer), "agents array<struct<id:string,role:string,query:string>>")["agents"]
    number = lambda prefix, i: F.concat(F.lit(prefix), (i + 1).cast("string"))
    own = lambda x, default, n: F.substring(F.trim(F.when(blank(x) != "", x).otherwise(default)), 1, n)
    each = F.transform(F.slice(read, 1, most), lambda a, i: F.struct(own(a["id"], number("a", i), 16).alias("agent_id"), own(a["role"], number("agent_", i), 48).alias("role"), F.substring(F.trim(blank(a["query"])), 1, 240).alias("query")))
    return F.filter(F.coalesce(each, F.array().cast("array<struct<agent_id:string,role:string,query:string>>")), lambda a: F.length(a["query"]) >= 6)


def build_plans(rows: DataFrame, year: int, most: int = 5) -> DataFrame:
    """rows (query_id, message, answer) -> (query_id, ord, agent_id, role, query): the model's plan if it has two parts, else the heuristic one."""
    own = rows.withColumn("__p", model_plans(F.col("answer"), most))
    by_model = own.where(F.size("__p") >= 2).select("query_id", F.posexplode("__p").alias("ord", "p")).select("query_id", F.col("ord").cast("long").alias("ord"), "p.*")
    by_rule = P.plan(own.where(F.size("__p") < 2).select("query_id", "message"), year, most)
    return by_model.unionByName(by_rule.withColumn("agent_id", F.concat(F.lit("a"), (F.col("ord") + 1).cast("string"))))


def model_gap_queries(answer: Column) -> Column:
    """Up to five queries of eight characters or more from a gap planner's answer, each once whatever its case."""
    read = F.from_json(body(answer), "queries array<string>")["queries"]
    clean = F.filter(F.transform(F.coalesce(read, F.array().cast("array<string>")), lambda q: T.collapse(blank(q))), lambda q: F.length(q) >= 8)
    return F.slice(F.transform(I.keep_first(clean, F.lower, 5), lambda q: F.substring(q, 1, 240)), 1, 5)


def gap_plan(message: Column, answer: Column, gaps: Column, thin: Column, force: Column, year: int) -> Column:
    """Follow-up queries: none where the evidence suffices and none is forced; the model's, else the heuristic ones."""
    own = model_gap_queries(answer)
    found = F.when(F.size(own) > 0, own).otherwise(P.gap_queries(message, gaps, year))
    return F.when(thin | force, found).otherwise(F.array().cast("array<string>"))


def pick(ranked: DataFrame, answers: DataFrame, keep: int) -> DataFrame:
    """ranked (query_id, rank, ..), answers (query_id, answer) -> the best `keep` rows with pick 1, 2, ..

    The answer names places 0, 1, .. of the order; those that exist count, each once. Without any the order stands.
    """
    named = answers.select("query_id", F.posexplode(F.from_json(body(F.col("answer")), "keep array<string>")["keep"]).alias("at", "x"))
    named = named.select("query_id", "at", F.expr("try_cast(x as int)").alias("place")).where("place >= 0").groupBy("query_id", "place").agg(F.min("at").alias("at"))
    joined = ranked.join(named.withColumn("rank", F.col("place") + 1).select("query_id", "rank", "at"), ["query_id", "rank"], "left")
    by = Window.partitionBy("query_id")
    any_named = F.max(F.col("at").isNotNull()).over(by)
    kept = joined.withColumn("__any", any_named).where(~F.col("__any") | F.col("at").isNotNull())
    place = F.row_number().over(by.orderBy(F.coalesce("at", F.col("rank")), "rank"))
    return kept.withColumn("pick", place.cast("long")).where(F.col("pick") <= keep).drop("__any", "at")
