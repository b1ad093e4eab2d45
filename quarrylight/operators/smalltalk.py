"""Small talk by a lexicon table, for lists too long for an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intent import normalize_trivial


def trivial_by_table(messages: DataFrame, lexicon: DataFrame, most_words: int = 5) -> DataFrame:
    """messages (id, message), lexicon (kind: phrase or token, term) -> (id, trivial): blank, a listed phrase, or a few listed words.

    Phrases and words meet the lexicon by equality; repeated terms count once, null messages are blank, and ids are unique.
    """
    said = messages.select("id", normalize_trivial(F.col("message")).alias("n"))
    phrases = lexicon.where("kind = 'phrase'").select(F.col("term").alias("n")).distinct().withColumn("listed", F.lit(True))
    words = said.where((F.col("n") != "") & (F.size(F.split("n", " ")) <= most_words)).select("id", F.explode(F.array_distinct(F.split("n", " "))).alias("w"))
    tokens = lexicon.where("kind = 'token'").select(F.col("term").alias("w")).distinct().withColumn("known", F.lit(1))
    all_known = words.join(tokens, "w", "left").groupBy("id").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known"))
    out = said.join(phrases, "n", "left").join(all_known, "id", "left")
    return out.select("id", ((F.col("n") == "") | F.coalesce("listed", F.lit(False)) | (F.coalesce("all_known", F.lit(0)) == 1)).alias("trivial"))
