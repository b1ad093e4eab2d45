"""What a conversation remembers of its searches: the last lines, and a preview of them before an answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import blank

#: The head and the rule round the remembered lines.
HEAD = "\n--- SESSION_WEB_MEMORY (reuse only if relevant; cite URLs verbatim) ---\n"
RULE = "-" * 68


def lines(contexts: DataFrame, most: int = 16, least: int = 40, cut: int = 720) -> DataFrame:
    """contexts (conversation, turn, pos, url, source, snippet, enriched_text), useful ones -> (conversation, turn, pos, line)."""
    text = F.when(blank(F.col("enriched_text")) != "", F.col("enriched_text")).otherwise(blank(F.col("snippet")))
    excerpt, url = F.trim(F.substring(text, 1, cut)), F.trim(blank(F.col("url")))
    n = F.row_number().over(Window.partitionBy("conversation", "turn").orderBy("pos"))
    first = contexts.withColumn("__n", n).where(F.col("__n") <= most)
    fit = first.where(F.startswith(url, F.lit("https://")) & (F.length(excerpt) >= least))
    return fit.select("conversation", "turn", "pos", F.concat(F.lit("• ["), blank(F.col("source")), F.lit("] "), excerpt, F.lit("\n  "), url).alias("line"))


def memory(contexts: DataFrame, cap: int = 24) -> DataFrame:
    """(conversation, n, line): the lines that each conversation holds in the end, oldest first.

    A line that is among the last `cap` isn't taken again, and the last `cap` stay (5 to 80). A conversation's lines stream
    through its task in order, with the ring alone carried along.
    """
    cap = max(5, min(cap, 80))
    ordered = lines(contexts).repartition("conversation").sortWithinPartitions("conversation", "turn", "pos", "line")
    kind = contexts.schema["conversation"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ring = None, []

        def held() -> pd.DataFrame:
            return pd.DataFrame({"conversation": [current] * len(ring), "n": range(len(ring)), "line": ring})

        for batch in batches:
            for conversation, line in zip(batch["conversation"], batch["line"], strict=True):
                if conversation != current:
                    if ring:
                        yield held()
                    current, ring = conversation, []
                if line not in ring:
                    ring = [*ring, line][-cap:]
        if ring:
            yield held()

    return ordered.mapInPandas(run, f"conversation {kind}, n long, line string")


def with_preview(answers: DataFrame, remembered: DataFrame, n: int = 8) -> DataFrame:
    """answers (conversation, text) with the last n remembered lines (2 to 24) before each text that isn't blank."""
    n = max(2, min(n, 24))
    last = F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("n")))
    few = remembered.withColumn("__r", last).where(F.col("__r") <= n)
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n")
    head = few.groupBy("conversation").agg(F.concat(F.lit(HEAD), block, F.lit(f"\n{RULE}\n\n")).alias("__head"))
    text: Column = F.col("text")
    put = F.when(F.col("__head").isNotNull() & (F.trim(blank(text)) != ""), F.concat("__head", "text")).otherwise(text)
    return answers.join(head, "conversation", "left").withColumn("text", put).drop("__head")
