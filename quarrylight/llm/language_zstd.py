"""Language identification by compression: the language whose raw-content dictionary encodes a text shortest wins.

Training takes a bounded sample: `sample_docs` distinct texts a language, whole, least text hashes first, cut into pieces
of `piece_chars`, of which the `pieces_per_lang` with the least hashes are the language's raw-content dictionary. A text
is reduced to lower-case words of letters and encoded, whole, once per language, by the same dictionaries and level
whatever its size; it is cut into equal pieces of at most `piece_bytes`, each encoded on its own and their sizes summed,
since a dictionary saves a frame a bounded number of bytes and a margin over one long frame would shrink with its length.
Every frame starts with an anchor, the end of the language's own dictionary, which costs the same few bytes in each
language; without it zstandard stores a short text raw and all sizes tie.
A text is rejected when the runner-up's size exceeds the winner's by less than `min_margin` of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 256
    piece_chars: int = 2000
    pieces_per_lang: int = 64
    anchor_bytes: int = 512
    level: int = 6
    piece_bytes: int = 8192
    min_margin: float = 0.005


def letters(text: str | None) -> bytes:
    """The text's words of letters (Unicode category L), lower-cased, one space between them."""
    words = _WORDS.findall((text or "").lower())  # with number signs such as \u00bd, which aren't letters
    return " ".join(w for w in (x if x.isalpha() else "".join(filter(str.isalpha, x)) for x in words) if w).encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """docs (text, lang) -> language: its dictionary. Null languages and null texts are left out, equal texts count once.

    The sample's size is set by its settings whatever the size of docs: only texts under a bound on their hash, drawn from
    the number of distinct texts of the language, leave their tasks. A table without usable rows gives no language.
    """
    picked = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    # twice the sample is expected under the bound, so that fewer than the sample are as good as ruled out
    bounds = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(int(min(1.0, 2 * settings.sample_docs / max(n, 1)) * 2**64) - 2**63, 2**63 - 1)))]
    under = picked.where(F.col("h") <= F.create_map(*bounds)[F.col("lang")])
    least = Window.partitionBy("lang").orderBy("h", "text")
    sample = under.groupBy("lang", "h", "text").count().withColumn("n", F.row_number().over(least)).where(F.col("n") <= settings.sample_docs)
    piece = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{settings.piece_chars}}}"), F.lit(0)))
    pieces = sample.select("lang", piece.alias("text")).withColumn("h", F.xxhash64("text")).distinct()
    kept = pieces.withColumn("n", F.row_number().over(least)).where(F.col("n") <= settings.pieces_per_lang)
    model: dict[str, list[bytes]] = {}
    for lang, text in kept.orderBy("lang", "n").select("lang", "text").collect():
        if content := letters(text):
            model.setdefault(lang, []).append(content)
    return {lang: b" ".join(parts) for lang, parts in model.items()}


class Encoder:
    """Encodes texts with each language's dictionary."""

    def __init__(self, model: dict[str, bytes], settings: Settings):
        self.settings = settings
        self.languages = sorted(model)
        self.frames = [self._frame(model[k], settings.level) for k in self.languages]

    def _frame(self, content: bytes, level: int):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
        if shared:
            shared.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
        return packer.compress, content[-self.settings.anchor_bytes :]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted). Score: 1 - winner's size / runner-up's, 1 if only one language is known."""
        body = letters(text)
        if not body or not self.languages:
            return UNDETERMINED, 0.0, False
        body = b" " + body + b" "
        each = -(-len(body) // -(-len(body) // self.settings.piece_bytes))
        pieces = [body[k : k + each] for k in range(0, len(body), each)]
        sizes = sorted((sum(len(pack(anchor + x)) for x in pieces), lang) for lang, (pack, anchor) in zip(self.languages, self.frames, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        margin = 1.0 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], margin, margin >= self.settings.min_margin


@lru_cache(maxsize=2)
def _encoder(model: tuple, settings: Settings) -> Encoder:
    return Encoder(dict(model), settings)


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs plus lang_pred, lang_score, lang_accepted, from the text alone; such columns of docs are replaced.

    Null texts and texts without letters: und, 0, false. Ties go to the language that sorts first and are rejected.
    Repeated rows give repeated rows; an empty table an empty result.
    """
    frozen = tuple(sorted(model.items()))
    held = docs.sparkSession.sparkContext.broadcast((frozen, settings))  # bounded by the settings

    @F.pandas_udf("lang_pred string, lang_score double, lang_accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*held.value)
        for texts in batches:
            yield pd.DataFrame([encoder.classify(t) for t in texts], columns=["lang_pred", "lang_score", "lang_accepted"])

    predict = predict.asNondeterministic()  # else a filter on its result runs it a second time
    rest = docs.drop("lang_pred", "lang_score", "lang_accepted")
    marked = rest.withColumn("__found", predict(F.col(text_col).cast("string")))
    return marked.select(*rest.columns, "__found.lang_pred", "__found.lang_score", "__found.lang_accepted")


def held_out(doc_id):
    """Documents never learned from: crc32 of the id as text, mod 4, is 2. A null id is neither held out nor learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit_documents(docs: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    return fit(docs.where(~held_out(F.col("doc_id"))), settings)


def keep_identified(docs: DataFrame, model: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """The documents whose language is accepted; columns as they were."""
    return identify(docs, model, settings=settings).where("lang_accepted").select(*docs.columns)


def op2_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row of docs; the dictionaries come from those not held out.

    Nulls, ties, empty tables and the like as `identify` says; without labelled rows every prediction is und.
    """
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted")
    )
