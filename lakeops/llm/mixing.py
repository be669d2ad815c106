"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

Every source gets a target in words: its weight's share of ``share`` times all words, stopped at
``most`` times the source's own words, the excess going to the others by weight until none is
above (targets are min(most * size, level * weight), and the level is found by a few aggregates
over the table of sources).

A source is first taken whole as often as its target allows; these epochs come before any
selection.  The rest of the target is drawn without replacement: document i has the key
-ln(u_i) / w_i with u_i uniform from a hash of its id and a seed and w_i its quality weight,
and documents are taken by rising key until the words run out.  The document on the border
gives only its first words.  Sums along the keys are made in ranges, so that a source of any
size is spread over all tasks.

Defined results: null text has size 0 and is never taken; a null source is a source of its own,
last in the order; rows with equal id and text share what they take.  An empty table gives no
rows.  Columns other than doc_id, text and source are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import WORD, word_count
from lakeops.operators.ordered import row_numbers, running
from lakeops.session import settle

SYMBOLS = "#*$%&|<>"


def quality_weight(text: str = "text") -> Column:
    """100 to 1000: 1000 less 4000 times the share of symbols among the characters."""
    chars = F.coalesce(F.length(text), F.lit(0))
    symbols = chars - F.coalesce(F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return (1000 - F.least(F.lit(900), F.floor(4000 * symbols / F.greatest(chars, F.lit(1))))).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """(0, 1] from the md5 of the key as text and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Add ``target`` to (source, source_size); sources by code point, null last, repeat ``weights``."""
    last = sizes.select(F.col("source").isNull().alias("_null"), "source", "source_size")
    ranked = row_numbers(last, [], ["_null", "source"], "_place")
    turn = ((F.col("_place") - 1) % len(weights) + 1).cast("int")
    ranked = settle(ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long")), "mix-sources")
    every = ranked.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("w")).first()
    goal = (every["words"] or 0) * share[0] / share[1]
    level = goal / every["w"] if every["w"] else 0.0
    while True:
        above = F.col("source_size") * most < level * F.col("_w")
        found = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0)).alias("w"),
        ).first()
        higher = (goal - found["stopped"]) / found["w"] if found["w"] else level
        if higher <= level:
            break
        level = higher
    target = F.least((F.col("source_size") * most).cast("double"), level * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 20240229,
) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken), one row per row of ``documents``."""
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight()
    rows = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count().alias("size"), key.alias("_key")
    )
    rows = settle(rows, "mix-rows")
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    goals = targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    upto = running(rows, ["source"], ["_key", "doc_id", "text_hash"], {"_upto": F.col("size")})
    both = upto.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_upto") - F.col("size"))))
    taken = (epochs * F.col("size") + part).cast("long")
    return both.select("doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``documents``: each document as often as it is taken, the rest of a
    count as the text's first words (its ``n_chars`` is then counted anew)."""
    plan = mix(documents, **options).where("taken > 0")
    # Equal rows share alike, so that the join gives each of them its own part.
    plan = plan.groupBy("doc_id", "text_hash").agg(F.floor(F.avg("taken")).cast("long").alias("_taken"), F.min("size").alias("_size"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_taken", "_size")
    # The row travels as one column, so that no name of the input can clash with these.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    both = rows.join(plan, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    full = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") % F.col("_size")).cast("int")
    none = F.array().cast("array<int>")
    each = both.withColumn("_rest", F.explode(F.concat(F.array_repeat(F.lit(0), full), F.when(rest > 0, F.array(rest)).otherwise(none))))
    part, row = F.col("_rest") > 0, F.col("_row")
    cut = F.array_join(F.slice(F.regexp_extract_all(row["text"], F.lit(WORD), F.lit(0)), F.lit(1), F.col("_rest")), " ")
    new = {"text": F.when(part, cut).otherwise(row["text"])}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(part, F.length(cut).cast(documents.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return each.select(*[new.get(c, row[c]).alias(c) for c in documents.columns])
