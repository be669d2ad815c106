"""Segment messages: X12, EDIFACT, TRADACOMS and HL7 v2.

``parse_messages`` takes message text in a column.  Splitting works inside the row, so no
shuffle is needed.  ``read_x12_files``, ``read_edifact_files``, ``read_tradacoms_files`` and
``read_hl7_files`` scan files of any size: the file is split at segment ends, and only per-split
counts cross tasks before segments are grouped into their transaction.

Result: one row per transaction with ``header`` (a struct: envelope tag -> elements), ``segments``
(body only; each has ``segment`` and ``elements``) and ``txn_no`` in the message.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.functions.common import col
from lakeops.session import settle
from lakeops.sources.files import BLOCK, FILE, raw_lines


@dataclass(frozen=True)
class Dialect:
    name: str
    start: str  # tag that opens a transaction
    end: str | None  # tag that closes it
    envelope: tuple[str, ...]  # other tags outside the body
    release: str | None = None  # escape character
    tag_sep: str | None = None  # what follows the tag, if not the element separator


# Fixed values of the four standards.
X12 = Dialect("x12", "ST", "SE", ("ISA", "GS", "GE", "IEA"))
EDIFACT = Dialect("edifact", "UNH", "UNT", ("UNA", "UNB", "UNG", "UNE", "UNZ"), release="?")
TRADACOMS = Dialect("tradacoms", "MHD", "MTR", ("STX", "BAT", "EOB", "END"), release="?", tag_sep="=")
HL7 = Dialect("hl7", "MSH", None, ("FHS", "BHS", "BTS", "FTS"))

# What stands between two escape signs, and what it means.
HL7_ESCAPES = {"F": "|", "S": "^", "T": "&", "R": "~", "X0D": "\r", "E": "\\"}


# Stand-ins for released (escaped) characters while a message is split; control
# characters are not part of the EDIFACT and TRADACOMS character sets.
STAND_INS = "\u0001\u0002\u0003\u0004"
#: Column of the release sign and separators of a message, in the order of the stand-ins.
SIGNS = "signs"
#: Column of a file's number.
FILE_NO = "_no"


def literal_pattern(sep: Column) -> Column:
    """A separator as a regular expression; backslash plus one sign is split without regex."""
    return F.when(sep.rlike("^[A-Za-z0-9]$"), sep).otherwise(F.concat(F.lit("\\"), sep))


def hide_released(text: Column, d: dict[str, Column], dialect: Dialect) -> Column:
    """Replace ?? and released separators, so that plain splitting is exact."""
    if dialect.release is None:
        return text
    for sign, stand_in in zip(d["signs"], STAND_INS):
        pair = F.concat(d["release"], sign)
        text = F.when(d["release"] == " ", text).otherwise(F.replace(text, pair, F.lit(stand_in)))
    return text


def delimiters(text: Column | str, dialect: Dialect) -> dict[str, Column]:
    """Element, component and segment separators, as the envelope of the message states them."""
    text = F.ltrim(F.ltrim(col(text), F.lit("\ufeff")))
    if dialect.name == "x12":
        # ISA has 16 elements; the last is the component separator, then comes the terminator.
        element = F.substring(text, 4, 1)
        rest = F.get(F.split(text, literal_pattern(element), 17), F.lit(16))
        return {"element": element, "component": F.substring(rest, 1, 1), "segment": F.substring(rest, 2, 1)}
    if dialect.name == "edifact":
        stated = text.startswith("UNA")
        at = lambda n, default: F.when(stated, F.substring(text, n, 1)).otherwise(default)
        return {"component": at(4, ":"), "element": at(5, "+"), "release": at(7, dialect.release), "segment": at(9, "'")}
    if dialect.name == "tradacoms":
        return {"element": F.lit("+"), "component": F.lit(":"), "release": F.lit(dialect.release), "segment": F.lit("'")}
    return {"element": F.substring(text, 4, 1), "component": F.substring(text, 5, 1), "segment": F.lit(None)}


def _cut(s: Column, pattern: Column, dialect: Dialect) -> Column:
    """Text of one segment -> [tag, element 1, element 2, ..]; ``pattern`` stands for the element separator."""
    if dialect.tag_sep:
        # TRADACOMS: TAG=first+second.
        s = F.regexp_replace(s, f"^([A-Z]+){dialect.tag_sep}", "$1+")
    return F.split(s, pattern)


def _named(parts: Column, element: Column, dialect: Dialect) -> Column:
    """[tag, elements..] -> struct(segment, elements)."""
    tag = F.get(parts, F.lit(0))
    elements = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    if dialect.name == "hl7":
        # MSH-1 is the separator itself, so MSH elements start one place later.
        elements = F.when(tag == "MSH", F.concat(F.array(element), elements)).otherwise(elements)
    return F.struct(tag.alias("segment"), elements.alias("elements"))


def parse_messages(df: DataFrame, text: str, dialect: Dialect) -> DataFrame:
    """One row per transaction of the messages in column ``text``; other columns are kept."""
    keep = [c for c in df.columns if c != text]
    d = delimiters(text, dialect)
    clean = F.ltrim(F.col(text), F.lit("\ufeff"))
    # ``inline`` of one struct keeps Catalyst from copying the separator expressions into
    # every later use of them; it computes them once per message.
    one = F.struct(clean.alias("_text"), *[v.alias(f"_d_{k}") for k, v in d.items()])
    with_d = df.select(*keep, F.inline(F.array(one)))
    # One pattern per message, not one per segment.
    with_d = with_d.select("*", F.inline(F.array(F.struct(literal_pattern(F.col("_d_element")).alias("_pattern")))))
    seps = {k: F.col(f"_d_{k}") for k in d}
    seps["signs"] = [seps[k] for k in ("release", "segment", "element", "component") if dialect.release]
    pattern = F.lit("[\\r\\n]+") if dialect.name == "hl7" else literal_pattern(seps["segment"])
    raw = F.transform(F.split(hide_released(F.col("_text"), seps, dialect), pattern), lambda s: F.trim(s, F.lit(" \t\r\n")))
    own = F.filter(raw, lambda s: (s != "") & ~s.startswith("UNA"))
    element = seps["element"]
    cut = F.transform(own, lambda s: _cut(s, F.col("_pattern"), dialect))
    parts = F.transform(cut, lambda p: _named(p, element, dialect))
    stated = [F.col("_d_component").alias("component")]
    if dialect.release:
        stated.append(F.concat(*seps["signs"]).alias(SIGNS))
    parsed = with_d.select(*keep, *stated, F.inline(F.array(F.struct(parts.alias("_s")))))
    names = ["component", SIGNS][: len(stated)]
    at = F.array_compact(F.transform("_s", lambda x, i: F.when(x["segment"] == dialect.start, i)))
    outer = F.filter(
        F.transform("_s", lambda x, i: F.struct(i.alias("at"), x.alias("s"))), lambda e: e["s"]["segment"].isin(*dialect.envelope)
    )
    marked = parsed.select("*", F.inline(F.array(F.struct(at.alias("_starts"), outer.alias("_env")))))
    # Envelope segments by tag, once per message; a transaction then looks among those of each tag.
    marked = marked.select("*", F.inline(F.array(F.struct(*[_of_kind(t) for t in dialect.envelope]))))

    def transaction(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_starts", i + 1), F.size("_s"))
        own = F.slice("_s", start + 1, until - start)
        return F.struct((i + 1).alias("txn_no"), _header(start, dialect).alias("header"), _body(own, dialect).alias("segments"))

    # Each transaction carries its own slice only, so a long interchange stays linear.
    return marked.select(*keep, *names, F.inline(F.transform("_starts", transaction)))


def _of_kind(tag: str) -> Column:
    return F.filter("_env", lambda e: e["s"]["segment"] == tag).alias(f"_env_{tag}")


def _header(start: Column, dialect: Dialect) -> Column:
    """Elements of the start segment and of the last envelope segment of each kind before it."""

    def last(tag):
        before = F.filter(f"_env_{tag}", lambda e: e["at"] < start)
        return F.try_element_at(before, F.lit(-1))["s"]["elements"]

    own = F.get("_s", start)["elements"].alias(dialect.start)
    return F.struct(own, *[last(t).alias(t) for t in dialect.envelope])


def _body(own: Column, dialect: Dialect) -> Column:
    outside = [t for t in (dialect.start, dialect.end, *dialect.envelope) if t]
    if dialect.name == "hl7":
        outside.remove("MSH")
    return F.filter(own, lambda s: ~s["segment"].isin(*outside))


#: For each standard a letter of its envelope tags, and how many parts between such letters hold
#: the signs: 106 characters of ISA, the first of MSH, 9 of UNA.
MARKS = {"x12": ("S", 108), "hl7": ("S", 2), "edifact": ("N", 10)}


def file_signs(spark: SparkSession, path, dialect: Dialect, **select) -> DataFrame:
    """(_file, df_file_name, element, component, segment, release, _no): the separators that each file states at its start.

    The file is cut at a letter of the envelope's tags, so its first parts are short whether it has line
    ends or not, and blank lines before the envelope are in the first part.  The signs are looked for in
    the first split of a file; one without an envelope there ends the scan in an error that names it.
    """
    mark, parts = MARKS[dialect.name]
    first = Window.partitionBy(FILE).orderBy("_at")
    cut = raw_lines(spark, path, mark, **select).where(F.col(BLOCK) == 0)
    head = cut.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= parts)
    text = head.groupBy(FILE, "df_file_name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "value")))["value"], mark).alias("_t"))
    clean = F.ltrim(F.regexp_replace("_t", "^\\x{FEFF}", ""), F.lit(" \t\r\n"))
    tags = {"x12": "ISA", "hl7": "^(MSH|FHS|BHS)", "edifact": "^UN[AB]"}
    message = F.concat(F.lit(f"no {dialect.name} envelope in "), F.col(FILE))
    known = F.when(clean.rlike(tags[dialect.name]), clean).when(clean == "", F.lit(None)).otherwise(F.raise_error(message))
    found = text.select(FILE, "df_file_name", known.alias("_t")).where("_t IS NOT NULL")
    signs = delimiters("_t", dialect)
    signs.setdefault("release", F.lit(None).cast("string"))
    return _numbered(found.select(FILE, "df_file_name", *[signs[k].alias(k) for k in ("element", "component", "segment", "release")]), dialect)


def _numbered(signs: DataFrame, dialect: Dialect) -> DataFrame:
    """The signs of each file with its number, written once."""
    return settle(signs.select("*", F.monotonically_increasing_id().alias(FILE_NO)), f"{dialect.name}-signs")


#: Parts of a split (2^14) and transactions (2^8) that are put in order together.
PARTS, TRANSACTIONS = 14, 8


def _placed(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """``txn_no`` of every part: how many transactions its file has begun up to it.

    A part begins one if it has the start tag and the part before it is not open, which means that its
    terminator was released.  Splits are cut into runs of parts, so that no task orders a whole split;
    only counts and the state of the last part cross runs.
    """
    run = [FILE_NO, BLOCK, "_run"]
    inside = Window.partitionBy(*run).orderBy("_at")
    if dialect.release:
        rows = rows.withColumn("_before", F.lag("_open").over(inside))
        known = F.col("_begins") & (F.col("_before") == F.lit(False))
        rows = rows.withColumn("_sure", F.coalesce(known, F.lit(False))).withColumn("_asks", F.col("_begins") & F.col("_before").isNull()).drop("_before", "_begins")
    else:
        rows = rows.withColumn("_sure", F.col("_begins")).withColumn("_asks", F.lit(False)).withColumn("_open", F.lit(False)).drop("_begins")
    per_run = rows.groupBy(*run).agg(F.count_if("_sure").alias("_n"), F.bool_or("_asks").alias("_first"), F.max_by("_open", "_at").alias("_last"))
    order = Window.partitionBy(FILE_NO).orderBy(BLOCK, "_run")
    came = F.coalesce(F.lag("_last").over(order), F.lit(False))
    per_run = per_run.select(*run, "_n", (F.col("_first") & ~came).alias("_first"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(*run, "_first", F.coalesce(F.sum(F.col("_n") + F.col("_first").cast("long")).over(earlier), F.lit(0)).alias("_earlier"))
    begins = F.col("_sure") | (F.col("_asks") & F.col("_first"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    txn = F.col("_earlier") + F.sum(F.when(begins, 1).otherwise(0)).over(upto)
    return rows.join(offsets, run).select(FILE_NO, BLOCK, "_at", "value", txn.alias("txn_no"))


def _read_files(spark: SparkSession, path, dialect: Dialect, line_sep, signs: DataFrame, **select) -> DataFrame:
    """Transactions of the files that ``signs`` lists, all with the same line separator.

    Until they are one row per transaction, parts cross tasks as text under the number of their file.
    """
    element = F.col("element")
    lines = raw_lines(spark, path, line_sep, **select).join(signs.select(FILE, FILE_NO, "element", "release"), FILE)
    text = F.trim("value", F.lit(" \t\r\n\ufeff"))
    seps = [dialect.tag_sep and F.lit(dialect.tag_sep), element]
    begins = reduce(lambda a, b: a | b, [text.startswith(F.concat(F.lit(dialect.start), sep)) for sep in seps if sep is not None], text == dialect.start)
    rows = lines.select(FILE_NO, BLOCK, F.shiftright("_at", PARTS).alias("_run"), "_at", "value", begins.alias("_begins"), *([_is_open().alias("_open")] if dialect.release else []))
    if not dialect.release:
        rows = rows.where(F.trim("value", F.lit(" \t\r\n\ufeff")) != "")
    group = [FILE_NO, "_group"]
    dealt = _placed(rows, dialect).withColumn("_group", F.shiftright("txn_no", TRANSACTIONS)).repartition(*group)
    whole = dealt.groupBy(*group, "txn_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct(BLOCK, "_at", "value")))["value"], line_sep or "\n").alias("_text"))
    told = whole.join(signs.select(FILE_NO, "df_file_name", "element", "component", "release"), FILE_NO)
    kept = ["df_file_name", "component"]
    hidden, pattern = F.col("_text"), F.lit("[\\r\\n]+") if line_sep is None else literal_pattern(F.lit(line_sep))
    if dialect.release:
        seps = {"release": F.col("release"), "segment": F.lit(line_sep), "element": element, "component": F.col("component")}
        hidden = hide_released(hidden, seps | {"signs": list(seps.values())}, dialect)
        told = told.withColumn(SIGNS, F.concat(*seps.values()))
        kept.append(SIGNS)
    raw = F.transform(F.split(hidden, pattern), lambda x: F.trim(x, F.lit(" \t\r\n\ufeff")))
    own = F.filter(raw, lambda x: (x != "") & ~x.startswith("UNA")) if dialect.release else F.filter(raw, lambda x: x != "")
    # As in ``parse_messages``, ``inline`` of one struct has Catalyst compute these once per transaction.
    told = told.select(*group, "txn_no", *kept, "element", F.inline(F.array(F.struct(own.alias("_own"), literal_pattern(element).alias("_pattern")))))
    parts = F.transform("_own", lambda x: _named(_cut(x, F.col("_pattern"), dialect), element, dialect))
    parsed = told.select(*group, "txn_no", *kept, F.inline(F.array(F.struct(parts.alias("_s")))))

    def last(tag):
        return F.try_element_at(F.filter("_s", lambda x: x["segment"] == tag), F.lit(-1))["elements"].alias(f"_e_{tag}")

    parsed = parsed.select("*", *[last(t) for t in dialect.envelope])
    # Envelope segments behind a transaction's end hold for those after it.
    carried = [f"_e_{t}" for t in dialect.envelope]
    per_group = parsed.groupBy(*group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("txn_no"))).alias(c) for c in carried])
    before = Window.partitionBy(FILE_NO).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_group.select(*group, *[F.last(c, ignorenulls=True).over(before).alias(f"_c{c}") for c in carried])
    inside = Window.partitionBy(*group).orderBy("txn_no").rowsBetween(Window.unboundedPreceding, -1)
    heads = [F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c{c}")).alias(t) for c, t in zip(carried, dialect.envelope)]
    header = F.struct(F.get("_s", F.lit(0))["elements"].alias(dialect.start), *heads)
    found = parsed.join(earlier, group).select(*kept, "txn_no", header.alias("header"), _body(F.col("_s"), dialect).alias("segments"))
    return found.where("txn_no > 0")


def _is_open() -> Column:
    """True for a part that ends in an odd number of release signs: its terminator was released."""
    signs = F.when(F.col("release") == " ", 0).otherwise(F.length("value") - F.length(F.rtrim("value", F.col("release"))))
    return signs % 2 == 1


def _by_terminator(spark: SparkSession, path, dialect: Dialect, signs: DataFrame, default: str, **select) -> DataFrame:
    """Files with the same terminator are read together: one scan for each of the few signs that serve as one."""
    ends = [r["segment"] for r in signs.where("segment <> ''").select("segment").distinct().orderBy("segment").collect()]
    each = [_read_files(spark, path, dialect, end, signs.where(F.col("segment") == end), **select) for end in ends]
    return reduce(lambda a, b: a.unionByName(b), each) if each else _read_files(spark, path, dialect, default, signs, **select)


def read_x12_files(spark: SparkSession, path, **select) -> DataFrame:
    """Transactions of X12 files; each file has the separators stated in its own envelope."""
    return _by_terminator(spark, path, X12, file_signs(spark, path, X12, **select), "~", **select)


def read_edifact_files(spark: SparkSession, path, **select) -> DataFrame:
    """Messages of EDIFACT files of any size, with or without line ends; each file has the signs of its UNA."""
    return _by_terminator(spark, path, EDIFACT, file_signs(spark, path, EDIFACT, **select), "'", **select)


def read_tradacoms_files(spark: SparkSession, path, **select) -> DataFrame:
    """Messages of TRADACOMS files of any size; the signs are fixed."""
    files = raw_lines(spark, path, "'", **select).select(FILE, "df_file_name").distinct()
    signs = _numbered(files.select("*", *[v.alias(k) for k, v in delimiters(F.lit(""), TRADACOMS).items()]), TRADACOMS)
    return _read_files(spark, path, TRADACOMS, "'", signs, **select)


def read_hl7_files(spark: SparkSession, path, **select) -> DataFrame:
    """Messages of HL7 v2 files (segments end with CR, LF or both), each with its own separators."""
    signs = file_signs(spark, path, HL7, **select)
    return _read_files(spark, path, HL7, None, signs, **select)


def unescaped(c: Column) -> Column:
    """HL7 text with its escapes decoded in one pass: every second part between signs is a code."""
    parts = F.split(c, r"\\")
    last = F.size(parts) - 1

    def decoded(part: Column, i: Column) -> Column:
        known = F.lit(None).cast("string")
        for code, char in HL7_ESCAPES.items():
            known = F.when(part == code, F.lit(char)).otherwise(known)
        other = F.concat(F.lit("\\"), part, F.when(i < last, F.lit("\\")).otherwise(F.lit("")))
        return F.when(i % 2 == 0, part).when(i == last, other).otherwise(F.coalesce(known, other))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def clean_element(c: Column, dialect: Dialect) -> Column:
    """Element text with escapes decoded, by the signs of its own message."""
    if dialect.name == "hl7":
        return unescaped(c)
    if dialect.release:
        return F.call_function("translate", c, F.lit(STAND_INS), F.col(SIGNS))
    return c


def header_column(tag: str, n: int) -> Column:
    """Element n (1-based) of an envelope segment, such as ISA_6 or UNH_2."""
    return F.get(F.col("header")[tag], F.lit(n - 1))


def components(c: Column, sep: str = ":") -> Column:
    """Components of one element."""
    return F.split(c, literal_pattern(F.lit(sep)))


def _occurrences(tag: str, n: int, dialect: Dialect) -> Column:
    """Element n of every segment with a tag, in message order; NULL where it is absent."""
    own = F.filter("segments", lambda s: s["segment"] == tag)
    return F.transform(own, lambda s: clean_element(F.get(s["elements"], F.lit(n - 1)), dialect))


def _split_path(path: str) -> tuple[str, int]:
    tag, n = path.rsplit("_", 1)
    return tag.upper(), int(n)


def materialize(
    df: DataFrame,
    paths: Sequence[str],
    dialect: Dialect,
    mode: str = "first",
    max_repeating: int | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Columns for paths such as ``beg_3`` (segment, 1-based element).

    Repeated segments: ``first`` keeps the first, ``indexed`` gives seg_occurrence_element
    columns, ``concatenate`` joins with ``|``, ``to_json`` gives a JSON array.  ``names``
    (path -> friendly name) puts the name before the path.
    """
    out: dict[str, Column] = {}
    for path in paths:
        tag, n = _split_path(path)
        every = _occurrences(tag, n, dialect)
        name = f"{names[path]}_{path}" if names and path in names else path
        if mode == "first":
            out[name] = F.get(every, F.lit(0))
        elif mode == "indexed":
            if max_repeating is None:
                raise ValueError("indexed columns need max_repeating, the number of occurrences to show")
            for i in range(1, max_repeating + 1):
                out[f"{tag.lower()}_{i}_{n}"] = F.get(every, F.lit(i - 1))
        elif mode == "concatenate":
            out[name] = F.nullif(F.array_join(every, "|", ""), F.lit(""))
        elif mode == "to_json":
            out[name] = F.when(F.size(every) > 0, F.to_json(F.transform(every, lambda x: F.coalesce(x, F.lit("")))))
        else:
            raise ValueError(f"unknown repeat mode {mode!r}")
    return df.withColumns(out)


def body_json(dialect: Dialect) -> Column:
    """The body as JSON: [{"segment": .., "elements": [{"value": ..}, ..]}, ..]."""
    return F.to_json(
        F.transform(
            "segments",
            lambda s: F.struct(
                s["segment"].alias("segment"),
                F.transform(s["elements"], lambda e: F.struct(clean_element(e, dialect).alias("value"))).alias("elements"),
            ),
        )
    )


def with_document(df: DataFrame, dialect: Dialect, kind: str = "transaction") -> DataFrame:
    """Add df_<kind>_json and df_<kind>_id (a digest of envelope and body)."""
    text = F.col(f"df_{kind}_json")
    return df.withColumn(f"df_{kind}_json", body_json(dialect)).withColumn(
        f"df_{kind}_id", F.sha2(F.concat(F.to_json("header"), F.col("txn_no").cast("string"), text), 256)
    )
