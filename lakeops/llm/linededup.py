"""Duplicate lines across documents, by built-in functions alone.

A text is split at U+000A.  A line's key is the line without leading and trailing space and U+0009
to U+000D, A-Z lower-cased.  A key of at least ``least`` code points stays in one document, the one
of the smallest id that holds it, and loses its lines everywhere else.

1. Keys travel as 128-bit hashes with document and position, never as text.
2. The hashes are partitioned by range and sorted by hash, document and position within each range,
   so the first row of a run names the document that keeps the key, and the rest is streamed past it.
   No second shuffle is needed, as a range never cuts a run.
3. Keys that a sample shows in more than a small share of all lines would fill a range on their own.
   Each of them is dealt over salted runs, and the smallest document of all its runs comes from an
   aggregate with map-side combine.  The sample only decides on the dealing: results are exact
   whatever it finds.  It shows at most ``SAMPLE / SEEN`` such keys a range, which bounds the broadcast.
4. The lines to drop become bits: one 64-bit word per 64 lines, only words with a dropped line being
   kept.  This list per document is the result; texts are read again by ``without_lines`` alone.

Defined results: a null or empty text is one empty line.  Rows of the same id are one document, and
each row has marks of its own text.  Rows without an id count as one document after all others.
Texts of any length are read whole.  Repeated rows stay.  An empty table gives no rows.  Other
columns, whatever their names, are ignored by ``marks`` and handed on by ``without_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.urlglobs import LOWER, UPPER
from lakeops.operators.ordered import default_slices
from lakeops.session import settle

BLANK = " \t\n\x0b\x0c\r"
#: Rows of the sample for each range, and how many of them make a key one to be dealt.
SAMPLE, SEEN = 200, 20


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_id(name: str = "text") -> Column:
    """Tells the texts of rows with the same id apart."""
    return F.xxhash64(text_of(name))


def keyed_lines(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_id, pos, h1, h2) of every line whose key has ``least`` code points or more."""
    lowered = F.split(F.translate(text_of(), UPPER, LOWER), "\n")
    lines = documents.select("doc_id", text_id().alias("text_id"), F.posexplode(lowered).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    return lines.where(F.length(key) >= least).select(
        "doc_id", "text_id", "pos", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")
    )


def busy_keys(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, h2, first): keys with a large share of all lines, and their smallest document."""
    share = min(1.0, SAMPLE * parts / max(1, lines.count()))
    seen = lines.select("h1", "h2").sample(share, 5).groupBy("h1", "h2").count().where(F.col("count") >= SEEN)
    held = lines.join(F.broadcast(seen.select("h1", "h2")), ["h1", "h2"], "left_semi")  # SAMPLE / SEEN keys a range
    return held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))


def late_lines(lines: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text_id, pos) of the lines whose key a smaller document holds."""
    busy = busy_keys(lines, parts).withColumn("busy", F.lit(True))
    salt = F.when(F.col("busy"), F.pmod(F.xxhash64("doc_id", "text_id", "pos"), F.lit(parts))).otherwise(F.lit(0))
    salted = lines.join(F.broadcast(busy), ["h1", "h2"], "left").withColumn("salt", salt)
    dealt = salted.repartitionByRange(parts, "h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    holder = F.least(F.first("doc_id").over(run), "first")
    later = F.col("holder").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("holder")))
    return dealt.withColumn("holder", holder).where(later).select("doc_id", "text_id", "pos")


def marks(documents: DataFrame, least: int = 10, parts: int | None = None) -> DataFrame:
    """(doc_id, text_id, keep, n_dropped) of every text that loses a line.

    ``keep`` lists (word, bits): bit b of word w is 1 if line 64 w + b stays; words that are not
    listed keep all their lines.
    """
    parts = parts or default_slices(documents)
    lines = settle(keyed_lines(documents, least), "linededup-keys")
    gone = late_lines(lines, parts).select("doc_id", "text_id", F.expr("CAST(pos DIV 64 AS INT)").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = gone.groupBy("doc_id", "text_id", "word").agg(F.bit_or("bit").alias("gone"))
    listed = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))  # of one text
    return words.groupBy("doc_id", "text_id").agg(listed.alias("keep"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))


def without_lines(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``documents`` as a struct, and its text without the lines of ``found``."""
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), text_id().alias("of"), text_of().alias("text"))
    at = found.select(F.col("doc_id").alias("mark_doc"), F.col("text_id").alias("mark_of"), "keep", "n_dropped")
    both = rows.join(at, F.col("doc").eqNullSafe(F.col("mark_doc")) & (F.col("of") == F.col("mark_of")), "left")
    lines = both.withColumn("lines", F.split("text", "\n"))
    # The bits of all words, bound once as m; get(m, i div 64) has line i.
    kept = F.expr(
        """transform(array(transform(sequence(0, (size(lines) - 1) DIV 64), w -> coalesce(try_element_at(map_from_entries(keep), CAST(w AS INT)), -1L))),
             m -> array_join(filter(lines, (line, i) -> (shiftright(get(m, CAST(i DIV 64 AS INT)), i % 64) & 1L) = 1L), '\\n'))[0]"""
    )
    return lines.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def dedup(documents: DataFrame, least: int = 10) -> DataFrame:
    """``documents`` with the remaining lines as text; rows that lose nothing stay as they are."""
    found = without_lines(documents, marks(documents, least))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def digest(documents: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``documents``."""
    found = without_lines(documents.select("doc_id", "text"), marks(documents, least))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
