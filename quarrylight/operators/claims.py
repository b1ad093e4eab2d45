"""Claims of a draft against evidence: support, conflict and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import urls as U
from ..functions.urls import blank


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.lower(blank(x)), r"\s+", "")


def _wording_key(w: Column) -> Column:
    """What a wording shares with every text that holds it: the end of its first run of digits and the character after
    it, or the one before it and the run's start."""
    ended, begun = F.regexp_extract(w, r"(\d{1,3}\D)", 1), F.regexp_extract(w, r"(\D\d{1,3})", 1)
    return F.when(ended != "", ended).otherwise(begun)


def _text_keys(x: Column) -> Column:
    """All the keys that wordings in x can have."""
    ends = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\d{1,3}\D"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i))))
    starts = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\D\d{1,3}"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(2), F.length(r)), lambda i: F.substr(r, F.lit(1), i))))
    return F.array_union(F.array_union(ends, starts), F.array(F.lit("")))


def worded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, w): the distinct wordings of the claims (query_id, raw) that a text of the query's evidence holds.

    Wordings and texts meet by query and key, page by page, and only then is the text searched.
    """
    asked = claims.select("query_id", _squeezed(F.col("raw")).alias("w")).distinct().withColumn("k", _wording_key(F.col("w")))
    pages = evidence.select("query_id", _squeezed(F.col("text")).alias("page"))
    return pages.withColumn("k", F.explode(_text_keys(F.col("page")))).join(asked, ["query_id", "k"]).where(F.contains("page", F.col("w"))).select("query_id", "w").distinct()


def _number_keys(x: Column, around: int) -> Column:
    """Buckets in which numbers meet that differ by 1 or by a quarter at most: of unit width, and by logarithm."""
    sign = F.signum(x).cast("int")
    log = F.floor(F.log(F.greatest(F.abs(x), F.lit(1e-9))) / -F.log(F.lit(0.75)))
    near = lambda way, b: [F.struct(way.alias("way"), (b + i).cast("long").alias("b")) for i in range(-around, around + 1)]
    return F.array(*near(F.lit(0), F.floor(x)), *near(F.lit(2) + sign, log))


def verify(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """drafts (draft_id, query_id, text), evidence (query_id, pos, url, text) -> the verdict on each claim.

    Where primary sources give figures, only they support a claim; one that is near them, or that other sources or the
    wording support, conflicts with them. Elsewhere wording or a figure within tolerance supports, and several figures
    near it conflict. Numbers meet by query and bucket, wordings by query and key; a claim without a value is supported
    by its wording or unverified.
    """
    claims = drafts.select("draft_id", "query_id", F.posexplode(N.claims(F.col("text"))).alias("n", "c")).select("draft_id", "query_id", F.col("n").cast("long").alias("n"), "c.*")
    rows = evidence.select("query_id", U.is_primary_source(F.col("url")).alias("prim"), "text")
    numbers = rows.select("query_id", "prim", F.explode(N.evidence_numbers(F.col("text"))).alias("e")).select("query_id", "prim", F.col("e.value").alias("x"))
    numbers = numbers.groupBy("query_id", "x").agg(F.max("prim").alias("prim"), F.count("*").alias("times"))
    has_primary = numbers.groupBy("query_id").agg(F.max("prim").alias("has_primary"))
    match = N.approx_equal(F.col("value"), F.col("x"))
    near = N.approx_equal(F.col("value"), F.col("x"), 0.25, F.greatest(F.lit(1.0), F.col("value") * 0.05))
    mine = claims.where("value is not null").select("draft_id", "query_id", "n", "value", F.explode(_number_keys(F.col("value"), 0)).alias("k"))
    theirs = numbers.select("query_id", "x", "prim", "times", F.explode(_number_keys(F.col("x"), 1)).alias("k"))
    # numbers that meet in neighbouring units are counted there alone
    once = (F.col("k.way") == 0) | (F.abs(F.floor("value") - F.floor("x")) > 1)
    met = mine.join(theirs, ["query_id", "k"]).where(once & (near | match))
    flags = met.groupBy("draft_id", "n").agg(
        F.max((match & F.col("prim")).cast("int")).alias("p_match"),
        F.max((near & F.col("prim")).cast("int")).alias("p_near"),
        F.max(match.cast("int")).alias("any_match"),
        F.sum(F.when(near, F.col("times"))).alias("n_near"),
    )
    said = worded(claims, evidence).withColumn("said", F.lit(1))
    all_ = claims.withColumn("w", _squeezed(F.col("raw"))).join(said, ["query_id", "w"], "left").join(has_primary, "query_id", "left").join(flags, ["draft_id", "n"], "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    literal = on("said")
    verdict = (
        F.when(F.col("value").isNull(), F.when(literal, F.lit("supported")).otherwise(F.lit("unverified")))
        .when(F.coalesce("has_primary", F.lit(False)), F.when(on("p_match"), F.lit("supported")).when(on("p_near") | on("any_match") | literal, F.lit("conflict")).otherwise(F.lit("unsupported")))
        .when(literal | on("any_match"), F.lit("supported"))
        .when(F.coalesce("n_near", F.lit(0)) >= 2, F.lit("conflict"))
        .otherwise(F.lit("unsupported"))
    )
    return all_.select("draft_id", "n", "raw", "value", "kind", verdict.alias("verdict"))


def report(verdicts: DataFrame) -> DataFrame:
    """Claims of each draft by verdict, and whether none is bad."""
    v = F.col("verdict")
    out = verdicts.groupBy("draft_id").agg(F.count("*").alias("claims"), F.count_if(v == "supported").alias("supported"), F.count_if(v == "unsupported").alias("unsupported"), F.count_if(v == "conflict").alias("conflicts"))
    return out.withColumn("ok", (F.col("unsupported") == 0) & (F.col("conflicts") == 0))


def star_verdicts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Star claims (query_id, n, value) against the counts of fact rows (query_id, stars), which alone decide."""
    close = N.approx_equal(F.col("value"), F.col("stars").cast("double"), 0.02, F.greatest(F.lit(5.0), F.col("stars") * 0.005))
    return claims.join(facts, "query_id").groupBy("query_id", "n").agg(F.max(close).alias("supported"))


_GRAM = 6


def _grams(x: Column) -> Column:
    """Distinct runs of _GRAM characters of x, and the empty one, which stands for shorter texts."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (_GRAM - 1), F.lit(1))), lambda i: F.substr(x, i, F.lit(_GRAM)))
    return F.array_union(runs, F.array(F.lit("")))


def _last_gram(x: Column) -> Column:
    return F.when(F.length(x) >= _GRAM, F.right(x, F.lit(_GRAM))).otherwise(F.lit(""))


def citations_ok(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answers (id, query_id, text), allowed (query_id, url) -> whether the answer names an allowed URL or host.

    Answers and addresses meet by query and by the last characters of the address or host, among the answer's runs of as
    many characters; only then is the answer searched.
    """
    h = U.bare_host(F.trim("url"))
    one = allowed.select("query_id", F.trim("url").alias("u"), h.alias("h")).where("u != ''").distinct()
    names = one.select("query_id", "u", "h", F.explode(F.array_distinct(F.array(_last_gram(F.lower("u")), F.when(F.col("h") != "", _last_gram(F.col("h"))).otherwise(_last_gram(F.lower("u")))))).alias("g"))
    low = F.lower("text")
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)https?://[^\s)\]\"'>]+"), F.lit(0)), U.bare_host)
    found = F.contains("text", F.col("u")) | ((F.col("h") != "") & (F.contains(low, F.col("h")) | F.array_contains("cited", F.col("h"))))
    texts = answers.select("id", "query_id", "text", cited.alias("cited"))
    keys = F.array_union(_grams(low), F.transform("cited", _last_gram))
    hit = texts.withColumn("g", F.explode(keys)).join(names, ["query_id", "g"]).where(found).select("id").distinct().withColumn("ok", F.lit(True))
    return answers.select("id").join(hit, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("ok"))
