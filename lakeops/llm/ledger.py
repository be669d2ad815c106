"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule.  A policy is a mask of the rules that count, so versions of a policy and ablations
are bit operations on the ledger and never read a text again.

Measurements (a word is a run of characters other than space and U+0009 to U+000D):
``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of ``#*$%&|<>``;
``n_lines``, lines with a word; ``n_dup_lines``, lines with a word that are equal to an earlier
line; ``n_repeat_words``, words inside a window of eight words that occurs twice or more in
the text, its first place included.

Defined results: a null or empty text measures 0 everywhere and fails the rule on length.  Texts
are read whole.  Rows are measured one by one, so repeated rows and ids stay.  An empty table gives
an empty ledger.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import map_batches, shingle_hashes, utf8, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named failure condition in SQL over the measurements; its place in the list is its bit."""

    name: str
    fails: str


#: Integer comparisons only, so that any engine gives the same bits.
RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
)
#: Versioned policies: the rules that count, by name.
POLICIES = {"base": ("too_short", "repeated_windows"), "full": tuple(r.name for r in RULES)}


def policy_mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window that occurs at least twice."""
    if len(words) <= WINDOW:
        return 0
    windows = shingle_hashes(word_hashes(words), WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    change[:-WINDOW] += twice
    change[WINDOW:] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def bytes_in(chars: str) -> bytes:
    return chars.encode()


SYMBOLS = bytes_in("#*$%&|<>")
NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"  # continuation bytes and white space
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text.translate(None, NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ledger(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, measurements, failed): ``failed`` has bit i set when rule i fails."""

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([measure(t) for t in batch["text"].to_pylist()], np.int64).reshape(-1, len(MEASURES))
            columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(MEASURES))]
            return pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *MEASURES])

        return run

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = map_batches(documents.select("doc_id", utf8().alias("text")), build, schema)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", bits)


def fails(mask: int, failed: str = "failed") -> Column:
    """Whether a document fails the policy ``mask``."""
    return F.col(failed).bitwiseAND(F.lit(mask).cast("long")) != 0


def ablations(book: DataFrame, policies: dict[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(policy, rule, n_failed, n_rejected, n_rejected_without, n_only): what each rule adds.

    Documents are first counted by failure bits, at most 2^rules rows, so the policies and the
    ablations are computed on that table alone.
    """
    counts = book.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p, r.name, policy_mask(names, rules), 1 << i) for p, names in policies.items() for i, r in enumerate(rules) if r.name in names]
    listed = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cases])
    each = counts.select("failed", "n", F.explode(listed).alias("case")).select("failed", "n", "case.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    n = F.col("n")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit != 0, n).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not("bit")) != 0, n).otherwise(0)).alias("n_rejected_without"),
        F.sum(F.when(hit == F.col("bit"), n).otherwise(0)).alias("n_only"),
    )
