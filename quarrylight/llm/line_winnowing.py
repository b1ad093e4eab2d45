"""Line deduplication by winnowing over line hashes, in DataFrame expressions alone.

A window starts at a line and takes lines until it has `min_words` words, or takes them leftwards from its last line.
The line of least hash in a window is its fingerprint, and a line that is the least of many windows is one fingerprint at
one position (a seed): two equal runs of min_words words or more hold an equal window, so both have a seed of that hash
at the same line of the run. Seeds are joined by hash: those whose hash has no second position go, which is most, and
with them every window they stand for. From the seeds that remain a match extends both ways as far as lines stay equal.
Line by line that would pair the members of a group, so it goes by the seed's windows: those that start at earlier lines
carry the match to the left, those that end at later lines to the right, and a window whose lines (hash and contents, 128
bits) were first met elsewhere earlier is a repeat. So the deleted lines are exactly those in a run of min_words words or
more that occurs earlier, in document order.

Only line hashes and positions are shuffled until the surviving lines are put together. Nothing pairs documents: each
window meets just the first place of its content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def _lines(docs: DataFrame) -> DataFrame:
    """(rid, doc, pos, a, b, words, n): two independent hashes of each normalised line that has a word."""
    line = F.trim(F.regexp_replace(F.lower("line"), r"[\x20\x09-\x0D]+", " "))
    out = docs.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.select("rid", "doc_id", "pos", line.alias("line")).where("line != ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return out.select("rid", "doc_id", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), words.cast("long").alias("words"))


def seeds(lines: DataFrame, min_words: int) -> DataFrame:
    """(rid, doc_id, at, fingerprint, windows): each selected line once, with the windows (first, last, content) of which it is the least."""
    by_doc = Window.partitionBy("rid").orderBy("pos")
    lines = lines.withColumn("upto", F.sum("words").over(by_doc))
    lines = lines.withColumn("before", F.col("upto") - F.col("words")).withColumn("total", F.sum("words").over(Window.partitionBy("rid")))
    right = Window.partitionBy("rid").orderBy("before").rangeBetween(0, min_words - 1)
    left = Window.partitionBy("rid").orderBy("upto").rangeBetween(1 - min_words, 0)

    def of(frame, far):
        least = F.min(F.struct("a", "pos")).over(frame)
        span = F.struct(F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.xxhash64(F.collect_list("b").over(frame)).alias("content"))
        return F.when(far, F.struct(least["a"].alias("fingerprint"), least["pos"].alias("at"), span.alias("span")))

    both = lines.select("rid", "doc_id", of(right, F.col("total") - F.col("before") >= min_words).alias("r"), of(left, F.col("upto") >= min_words).alias("l"))
    each = both.select("rid", "doc_id", F.explode(F.array_compact(F.array("r", "l"))).alias("w"))
    # the windows of a line lie in its document's task, so this needs no shuffle
    each = each.select("rid", "doc_id", "w.at", "w.fingerprint", "w.span")
    return each.groupBy("rid", "doc_id", "at", "fingerprint").agg(F.collect_set("span").alias("windows"))


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs (rid, doc_id, text) -> (rid, deleted): positions of the lines that lie in a repeated run."""
    selected = written(seeds(_lines(docs), min_words), "seeds")
    again = selected.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    met = selected.join(again, "fingerprint", "left_semi").select("rid", "doc_id", "fingerprint", F.explode("windows").alias("w"))
    met = written(met.select("rid", "doc_id", "fingerprint", "w.*"), "windows")
    key = ["fingerprint", "content"]
    place = F.struct("doc_id", "rid", "first")
    first = met.groupBy(*key).agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = met.join(first, key).where(place > F.col("origin"))
    spans = later.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return spans.select("rid", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("deleted"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with text reduced to the lines that stay, plus n_lines and n_deleted; such columns of docs are replaced.

    The rows are numbered once and written with their numbers; windows and deletions both go by that table, since numbers
    given in two scans differ where the cut into tasks does.

    Earlier means a smaller doc_id (null first), then an earlier row, then an earlier line. Lines are compared
    lower-cased with white space collapsed; lines without words belong to the run around them if it is deleted, and
    never stand for one. Null text stays null with 0 lines; texts under min_words words and runs under it are left
    alone; repeated rows are repeats; an empty table gives an empty result.
    """
    rows = docs.drop("n_lines", "n_deleted")
    rows = written(rows.withColumn("__rid", F.monotonically_increasing_id()), "numbered", compression="zstd")
    gone = repeated_lines(rows.select(F.col("__rid").alias("rid"), "doc_id", "text"), min_words)
    gone = gone.select(F.col("rid").alias("__rid"), F.col("deleted").alias("__deleted"))
    marked = rows.join(gone, "__rid", "left")
    lines = F.split("text", "\n")
    # positions alternate with the spans of kept lines between them
    ends = F.concat(F.array_sort("__deleted"), F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.array_sort("__deleted"), lambda p: p + 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))
    text = F.when(F.col("__deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    out = marked.withColumn("__n", n_lines.cast("long")).withColumn("__d", F.coalesce(F.size("__deleted"), F.lit(0)).cast("long"))
    cols = [text.alias(c) if c == "text" else F.col(c) for c in rows.columns if c != "__rid"]
    return out.select(*cols, F.col("__n").alias("n_lines"), F.col("__d").alias("n_deleted"))


def keep_deduplicated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with repeated runs deleted; a document that lost all lines with a word goes, n_chars is counted again."""
    out = dedup_lines(docs, min_words)
    blank = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")) == ""
    out = out.where(~((F.col("n_deleted") > 0) & blank))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted and the text that stays, a row per row; nulls, ties, empty tables and the like as `dedup_lines` says."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "text")


#: The same rule over line contents themselves: windows of 50 words, their first place, the lines of later ones.
OP4_SQL = r"""
with l as (
  select doc_id, pos - 1 as pos, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
w as (
  select *, length(line) - length(replace(line, ' ', '')) + 1 as words from l where line <> ''),
c as (
  select *, sum(words) over (partition by doc_id order by pos) as upto, sum(words) over (partition by doc_id) as total from w),
b as (select *, upto - words as before from c),
r as (
  select doc_id, total - before >= 50 as whole, 0 as way, list(line) over f as content, min(pos) over f as first, max(pos) over f as last
  from b window f as (partition by doc_id order by before range between current row and 49 following)
  union all
  select doc_id, upto >= 50, 1, list(line) over f, min(pos) over f, max(pos) over f
  from b window f as (partition by doc_id order by upto range between 49 preceding and current row)),
o as (select *, min(doc_id * 10000000 + first) over (partition by way, content) as origin from r where whole),
d as (select distinct doc_id, unnest(generate_series(first, last)) as pos from o where doc_id * 10000000 + first > origin),
a as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
t as (
  select a.doc_id, count(*) as n_lines, count(d.pos) as n_deleted, coalesce(string_agg(a.line, chr(10) order by a.pos) filter (where d.pos is null), '') as text
  from a left join d on a.doc_id = d.doc_id and a.pos = d.pos group by a.doc_id)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_deleted as bigint) as n_deleted, text from t
"""
