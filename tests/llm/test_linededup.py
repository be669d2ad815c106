"""Line dedup against a plain rewrite of its definition."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakeops.llm import linededup

DOCS = "doc_id long, text string, keep string, h1 int, pos int, row string, first string, `a.b` int"
BLANK = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "r", "f", 3) for i, t in rows], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, least=10):
    def key(line):
        return lowered(line.strip(BLANK))

    holders: dict = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and doc is not None:
                holders[key(line)] = min(doc, holders.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or key(x) not in holders or doc is not None and doc <= holders[key(x)]]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def got(df):
    return [tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


HARD = [
    (None, "no id at all\nshared by many documents"),
    (None, "no id at all\nshared by many documents"),
    (1, None),
    (2, ""),
    (3, "\n\n"),
    (4, "Shared By Many Documents \n own line of four\n\tshared by many documents\nshort\n"),
    (5, "SHARED by many documents\nshort\nÄRGER im Übermaß\n"),
    (5, "shared by many documents\nsecond text of five"),
    (5, "shared by many documents\nsecond text of five"),
    (6, "ärger im Übermaß\nÄRGER im Übermaß \n\x0b0123456789\x0c"),
    (7, "0123456789\n012345678\n012345678"),
    (8, "012345678\n  0123456789  "),
    (9, "\n".join(f"line number {i % 900} of a long text" for i in range(5000))),
    (10, "\n".join(f"line number {i} of a long text" for i in range(2000))),
    (-3, "line number 64 of a long text\nline number 1999 of a long text"),
]


def test_lines_like_by_hand(spark):
    assert ordered(got(linededup.digest(docs_of(spark, HARD)))) == ordered(by_hand(HARD))


def test_busy_lines_are_dealt_and_exact(spark):
    dice = random.Random(3)
    pool = [f"line {i} of the common pool" for i in range(40)]
    rows = [(i, "\n".join(["the line of all documents"] * dice.randint(0, 3) + [dice.choice(pool) for _ in range(3)] + [f"only in {i} and nowhere"])) for i in range(1500)]
    dice.shuffle(rows)
    docs = docs_of(spark, rows)
    lines = linededup.keyed_lines(docs, 10).cache()
    busy = linededup.busy_keys(lines, 8)
    assert 1 <= busy.count() <= 8 * linededup.SAMPLE // linededup.SEEN
    assert ordered(got(linededup.digest(docs))) == ordered(by_hand(rows))


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    rows = [(1, "a line to be repeated"), (2, "\n".join(["x"] * 130 + ["a line to be repeated"]))]
    (found,) = linededup.marks(docs_of(spark, rows)).collect()
    assert found["doc_id"] == 2 and found["n_dropped"] == 1
    assert [(w["word"], w["bits"] & (2**64 - 1)) for w in found["keep"]] == [(2, 2**64 - 1 - 4)]


def test_texts_without_their_lines_keep_all_columns(spark):
    docs = docs_of(spark, HARD)
    found = linededup.dedup(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert found.where("doc_id = 8").first()["text"] == "012345678"
    assert found.where("doc_id = 1").first()["text"] is None
    again = linededup.digest(found.where("doc_id IS NOT NULL"))
    assert again.agg(F.sum("n_dropped")).first()[0] == 0


def test_no_rows(spark):
    assert linededup.digest(docs_of(spark, [])).count() == 0
    assert linededup.dedup(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_number_of_ranges_changes_nothing(spark, parts):
    docs = docs_of(spark, HARD)
    found = linededup.marks(docs, parts=parts).groupBy().agg(F.sum("n_dropped")).first()[0]
    assert found == sum(r[2] for r in by_hand(list({*HARD})))
