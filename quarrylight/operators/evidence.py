"""Evidence per query: totals and gaps, numeric conflict, readiness, wave stops, and answer quality per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.urls import blank
from .guards import value_at_rank


def _asked(messages: DataFrame) -> DataFrame:
    kept = [c for c in ("query_id", "message", "depth") if c in messages.columns]
    return messages.select(*kept, F.transform(F.slice(I.place_tokens(F.col("message")), 1, 4), F.lower).alias("places"))


def assess(rows: DataFrame, messages: DataFrame, min_enriched: int = 2500, min_numeric: int = 3, min_hosts: int = 3, min_place: float = 0.35) -> DataFrame:
    """Totals of each query's hits, its gaps (joined by commas) and whether the evidence is thin."""
    c = F.col
    body, snip = F.trim(blank(c("enriched_text"))), F.trim(blank(c("snippet")))
    text = F.concat_ws("\n", F.trim(blank(c("title"))), F.trim(blank(c("url"))), F.when(body != "", body).otherwise(snip))
    rows = _asked(messages).join(rows, "query_id").withColumn("text", text).withColumn("low", F.lower("text"))
    placed = F.exists("places", lambda p: F.contains(c("low"), p))
    out = rows.groupBy("query_id").agg(
        F.sum(F.length(body)).alias("enriched_chars"),
        F.sum(F.when(body == "", F.length(snip)).otherwise(0)).alias("snippet_chars"),
        F.sum(N.mention_count(F.substring("text", 1, 12000))).alias("numeric_hits"),
        F.count_if(placed).alias("place_hits"),
        F.count_distinct(F.when(U.bare_host(c("url")) != "", U.bare_host(c("url")))).alias("hosts"),
        F.count("*").alias("row_count"),
        F.count_if(body != "").alias("enriched_rows"),
        F.max(F.size("places")).alias("n_places"),
    )
    gap = lambda cond, name: F.when(cond, F.lit(name))
    gaps = F.array_compact(
        F.array(
            gap(c("row_count") < 4, "too_few_results"),
            gap((c("enriched_chars") < min_enriched) & (c("snippet_chars") < 2 * min_enriched), "thin_page_text"),
            gap(c("numeric_hits") < min_numeric, "missing_numbers"),
            gap((c("n_places") > 0) & (c("place_hits") / c("row_count") < min_place), "weak_place_overlap"),
            gap(c("hosts") < min_hosts, "too_few_hosts"),
        )
    )
    out = out.withColumn("gap_list", gaps)
    thin = (F.size("gap_list") >= 2) | (F.size(F.array_remove("gap_list", "too_few_hosts")) > 0)
    return out.withColumn("thin", thin).withColumn("gaps", F.array_join("gap_list", ",")).drop("gap_list", "n_places")


def conflicts(rows: DataFrame) -> DataFrame:
    """(query_id, has_numbers, conflict): no two of several pages with numbers share a close one.

    Numbers close to each other are found by buckets a match can't leap over: one of widths by logarithm for the
    relative bound, one of unit width for the absolute; each number is looked up in its own and the neighbour buckets.
    """
    nums = rows.where(F.trim(blank(F.col("enriched_text"))) != "").select("query_id", "pos", N.page_numbers(F.trim("enriched_text")).alias("v")).where(F.size("v") > 0)
    first = nums.select("query_id", "pos", F.explode(F.array_distinct(F.slice("v", 1, 16))).alias("x"))
    width = -F.log(F.lit(1 - 0.08))
    sign = F.signum("x").cast("int")
    keys = F.array(
        F.struct(F.lit(0).alias("way"), F.floor("x").alias("b")),
        F.struct((F.lit(2) + sign).alias("way"), F.floor(F.log(F.greatest(F.abs("x"), F.lit(1e-9))) / width).alias("b")),
    )
    own = first.select("query_id", "pos", "x", F.explode(keys).alias("k")).select("query_id", "pos", "x", "k.way", "k.b")
    near = own.select("query_id", F.col("pos").alias("pos2"), F.col("x").alias("y"), "way", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    met = own.join(near, ["query_id", "way", "b"]).where((F.col("pos") < F.col("pos2")) & N.numbers_close(F.col("x"), F.col("y")))
    shared = met.select("query_id").distinct().withColumn("shared", F.lit(True))
    pages = nums.groupBy("query_id").agg(F.count("*").alias("pages"))
    all_rows = rows.select("query_id").distinct().join(pages, "query_id", "left").join(shared, "query_id", "left")
    has = F.coalesce("pages", F.lit(0))
    return all_rows.select("query_id", (has > 0).alias("has_numbers"), ((has >= 2) & ~F.coalesce("shared", F.lit(False))).alias("conflict"))


def answer_ready(rows: DataFrame, messages: DataFrame, depth: Column) -> DataFrame:
    """(query_id, ready, reason): whether the pages read so far suffice."""
    c = F.col
    body = F.trim(blank(c("enriched_text")))
    near = F.lower(F.concat_ws("\n", blank(c("title")), blank(c("url")), F.substring(body, 1, 4000)))
    asked = _asked(messages.withColumn("depth", depth)).withColumn("depth", I.effective_depth(c("message"), c("depth")))
    placed = F.exists("places", lambda p: F.contains(c("near"), p))
    pages = asked.join(rows.withColumn("body", body).withColumn("near", near), "query_id")
    agg = pages.groupBy("query_id", "depth").agg(
        F.count_if(c("body") != "").alias("n"),
        F.sum(F.length("body")).alias("chars"),
        F.max(((F.size("places") == 0) | ((c("body") != "") & placed)).cast("int")).alias("place_ok"),
        F.max(F.length(F.trim("message"))).alias("asked"),
    )
    all_ = agg.join(conflicts(rows), "query_id").join(assess(rows, messages).select("query_id", "thin", "gaps"), "query_id")
    solid = c("has_numbers") | (c("chars") >= 600)
    single = c("has_numbers") & ((c("asked") < 100) | (c("chars") >= 400))
    reason = (
        F.when(c("n") == 0, F.lit("no_enriched"))
        .when(c("conflict"), F.lit("numeric_conflict"))
        .when(c("place_ok") == 0, F.lit("weak_place"))
        .when((c("depth") == "fast") & (c("n") >= 2) & solid, F.lit("fast_multi_agree"))
        .when((c("depth") == "fast") & single, F.lit("fast_single_solid"))
        .when(c("depth") == "fast", F.lit("fast_need_more"))
        .when(c("thin"), F.concat(F.lit("deep_thin:"), F.array_join(F.slice(F.split("gaps", ","), 1, 4), ",")))
        .when(c("n") < 3, F.lit("deep_need_hosts"))
        .otherwise(F.lit("deep_sufficient"))
    )
    ready = F.array(*[F.lit(x) for x in ("fast_multi_agree", "fast_single_solid", "deep_sufficient")])
    return all_.select("query_id", F.array_contains(ready, reason).alias("ready"), reason.alias("reason"))


def waves(eligible: DataFrame, size: int = 2, most: int = 6) -> DataFrame:
    """The wave (0, 1, ...) in which each of the first `most` pages of a query is read."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return eligible.withColumn("n", n).where(F.col("n") <= most).withColumn("wave", F.floor((F.col("n") - 1) / size).cast("long")).drop("n")


def enrich_budget(rows: DataFrame, base: int = 4, cap: int = 14) -> DataFrame:
    """Pages to read: two more for short snippets, one more where numbers of the first hits disagree."""
    c = F.col
    order = Window.partitionBy("query_id").orderBy("pos")
    top = rows.withColumn("n", F.row_number().over(order)).where("n <= 5").withColumn("s", F.trim(blank(c("snippet"))))
    nums = F.filter(F.transform(F.regexp_extract_all("s", F.lit(r"\d[\d\.,]*"), F.lit(0)), lambda x: F.when(F.replace(x, F.lit(","), F.lit(".")).rlike(r"^\d+\.?\d*$"), F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))), lambda v: v.isNotNull())
    top = top.withColumn("v", F.when(c("n") <= 3, nums).otherwise(F.array().cast("array<double>")))
    out = top.groupBy("query_id").agg(F.median(F.when(c("s") != "", F.length("s"))).alias("typical"), F.flatten(F.collect_list("v")).alias("v"))
    spread = (F.array_max("v") - F.array_min("v")) / (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    more = F.when(c("typical") < 95, 2).otherwise(0) + F.when((F.size("v") >= 4) & (spread > 0.035), 1).otherwise(0)
    return out.select("query_id", F.least(F.lit(base) + more, F.lit(cap)).cast("long").alias("budget"))


_RUNS = "struct<w:string,n:int,at:int,n1:int,at1:int,w1:string,n2:int,at2:int,w2:string>"


def _two_most(words: Column) -> Column:
    """The two most frequent words of an array, by their first places where they tie: one pass over the sorted words."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    none = F.from_json(F.lit('{"n":0,"at":0,"n1":0,"at1":0,"n2":0,"at2":0}'), _RUNS)

    def close(s):
        """The state once its current word has ended."""
        better = lambda n, at: (s["n"] > n) | ((s["n"] == n) & (s["at"] < at))
        first, second = better(s["n1"], s["at1"]), better(s["n2"], s["at2"])
        pick = lambda a, b, c: F.when(first, a).when(second, b).otherwise(c)
        return (
            F.when(first, s["n"]).otherwise(s["n1"]), F.when(first, s["at"]).otherwise(s["at1"]), F.when(first, s["w"]).otherwise(s["w1"]),
            pick(s["n1"], s["n"], s["n2"]), pick(s["at1"], s["at"], s["at2"]), pick(s["w1"], s["w"], s["w2"]),
        )

    def state(w, n, at, best):
        return F.struct(w.alias("w"), n.cast("int").alias("n"), at.cast("int").alias("at"), *[v.alias(k) for k, v in zip(("n1", "at1", "w1", "n2", "at2", "w2"), best, strict=True)])

    def add(s, x):
        same = s["w"].eqNullSafe(x["w"])
        kept = [s[k] for k in ("n1", "at1", "w1", "n2", "at2", "w2")]
        return F.when(same, state(s["w"], s["n"] + 1, s["at"], kept)).otherwise(state(x["w"], F.lit(1), x["at"], close(s)))

    # a word that sorts last of all ends the last one
    return F.aggregate(F.concat(placed, F.array(F.struct(F.lit("\U0010ffff").alias("w"), F.lit(0).alias("at")))), none, add)


def with_repetition(texts: DataFrame) -> DataFrame:
    """texts plus ratio: share of the most frequent word of four letters or more, the next one if that is a glue word; 0
    under 40 words. Counted within the row, so nothing is shuffled; words and counts are columns of their own, so that
    each is computed once."""
    words = F.filter(F.transform(F.regexp_extract_all(blank(F.col("text")), F.lit(T.TOKEN), F.lit(0)), F.lower), lambda w: F.length(w) >= 4)
    counted = texts.withColumn("__words", words).withColumn("__top", _two_most(F.col("__words")))
    n = F.when(F.col("__top.w1").isin(*T.GLUE_WORDS), F.col("__top.n2")).otherwise(F.col("__top.n1"))
    ratio = F.when(F.size("__words") < 40, F.lit(0.0)).otherwise(F.round(n / F.size("__words"), 6))
    return counted.withColumn("ratio", ratio).drop("__words", "__top")


def repetition_ratio(texts: DataFrame, key: str) -> DataFrame:
    return with_repetition(texts).select(key, "ratio")


def long_enough(texts: DataFrame) -> DataFrame:
    """Texts whose diversity is defined. Filter by this, not by the diversity: a filter on it is pushed into its inputs."""
    s = F.trim(blank(F.col("text")))
    return texts.where((F.length(s) >= 1200) & (F.regexp_count(s, F.lit(T.TOKEN)) >= 80))


def gram_diversity(texts: DataFrame) -> DataFrame:
    """texts plus diversity: distinct share of every third run of five words; null under 1200 characters or 80 words.

    The words are a column of their own, so that the runs don't tokenise the text again each.
    """
    s = F.trim(blank(F.col("text")))
    words = F.when(F.length(s) >= 1200, F.regexp_extract_all(F.lower(s), F.lit(T.TOKEN), F.lit(0)))
    split = texts.withColumn("__words", words)
    starts = F.sequence(F.lit(0), F.size("__words") - 5, F.lit(3))
    runs = split.withColumn("__runs", F.when(F.size("__words") >= 80, F.transform(starts, lambda i: F.array_join(F.slice(F.col("__words"), i + 1, 5), " "))))
    return runs.withColumn("diversity", F.round(F.size(F.array_distinct("__runs")) / F.size("__runs"), 6)).drop("__words", "__runs")


def answer_quality(texts: DataFrame, key: str, research: bool = True) -> DataFrame:
    """(key, ok, reasons): empty, looping, repetitive or collapsed texts. One pass over the rows, nothing is shuffled."""
    rated = with_repetition(gram_diversity(texts))
    t = F.col("text")
    empty = F.trim(blank(t)) == ""
    varied = F.col("diversity") if research else F.lit(None).cast("double")
    reasons = F.array_compact(
        F.array(
            F.when(T.has_token_loop(t), F.lit("phrase_loop")),
            F.when(F.col("ratio") >= 0.22, F.lit("token_repetition")),
            F.when(T.ellipsis_collapse(t), F.lit("ellipsis_collapse")),
            F.when(varied < 0.35, F.lit("low_ngram_diversity")),
        )
    )
    return rated.select(key, F.when(empty, F.lit("empty")).otherwise(F.array_join(reasons, ",")).alias("reasons")).withColumn("ok", F.col("reasons") == "")


def outliers(values: DataFrame, group: str, value: str) -> DataFrame:
    """Values ten times above or below the upper median of their group's positive ones; groups under four have none."""
    sizes = values.groupBy(group).agg(F.count("*").alias("__all"))
    middle = value_at_rank(values.where(F.col(value) > 0), group, value, lambda n: F.floor(n / 2)).select(group, F.col("p").alias("__mid"))
    joined = values.join(sizes.join(middle, group, "left"), group).withColumn("mid", F.when(F.col("__all") >= 4, F.col("__mid"))).drop("__all", "__mid")
    v = F.col(value)
    return joined.withColumn("outlier", F.coalesce((v > 0) & (F.col("mid") > 0) & ((v / F.col("mid") >= 10) | (F.col("mid") / v >= 10)), F.lit(False))).drop("mid")


def early_stop(read: DataFrame, messages: DataFrame, depth: Column) -> DataFrame:
    """Read pages (hits with wave) -> those of the waves up to the first after which the answer is ready.

    Every prefix of waves is judged as a query of its own, so no step waits for another.
    """
    part = F.struct("query_id", "upto")
    last = F.max("wave").over(Window.partitionBy("query_id"))
    prefixes = read.withColumn("last", last).withColumn("upto", F.explode(F.sequence("wave", "last")))
    asked = prefixes.select("query_id", "upto").distinct().join(messages.withColumn("depth", depth), "query_id")
    keyed = asked.select(part.alias("query_id"), "message", "depth")
    rows = prefixes.select(part.alias("query_id"), *[c for c in read.columns if c not in ("query_id", "wave")])
    ready = answer_ready(rows, keyed, F.col("depth"))
    first = ready.where("ready").select("query_id.*").groupBy("query_id").agg(F.min("upto").alias("stop"))
    return read.join(first, "query_id", "left").where(F.col("stop").isNull() | (F.col("wave") <= F.col("stop"))).drop("stop")
