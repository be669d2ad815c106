"""File scans: delimited text, line numbering, Parquet, ORC, XML, lineage columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, BLOCK, LINE = "_file", "_block", "line_no"


def _reader(spark: SparkSession, file_filter: str | None, recursive: bool):
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", file_filter) if file_filter else reader


def raw_lines(
    spark: SparkSession, path, line_sep: str | None = None, file_filter: str | None = None, recursive: bool = False
) -> DataFrame:
    """Lines of text files with their split (_file, _block) and their order in it (_at)."""
    reader = _reader(spark, file_filter, recursive)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.col("_metadata.file_name").alias("df_file_name"),
        F.col("_metadata.file_modification_time").alias("df_file_modified"),
        F.monotonically_increasing_id().alias("_at"),
    )


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None, **select) -> DataFrame:
    """``raw_lines`` with the 1-based number of each line in its file (line_no).

    A line's number is its place in the split plus the lines of earlier splits of that
    file; only one row per split crosses tasks, so a file of any size is numbered in
    parallel.
    """
    lines = raw_lines(spark, path, line_sep, **select)
    splits = lines.groupBy(FILE, BLOCK).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(FILE, BLOCK, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        lines.join(offsets, [FILE, BLOCK])
        .withColumn(LINE, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_first", "_before")
    )


def read_delimited(
    spark: SparkSession,
    path,
    schema: str | T.StructType | None = None,
    has_header: bool = True,
    delimiter: str = ",",
    quote: str = '"',
    null_value: str | None = None,
    comment_char: str | None = None,
    skip_starting_rows: int = 0,
    max_rows: int | None = None,
    trim_whitespace: bool = False,
    file_filter: str | None = None,
    recursive: bool = False,
    file_metadata: bool = False,
) -> DataFrame:
    """Delimited text as typed columns (text columns if no schema is given).

    ``skip_starting_rows`` drops the first lines of each file, the header is the next line that
    is neither blank nor a comment, and ``max_rows`` counts data lines per file.  These two and ``file_metadata`` need line
    numbers, so they take one record per line; other scans use Spark's CSV source as is.
    """
    options = {"sep": delimiter, "quote": quote, "header": str(has_header).lower()}
    if null_value is not None:
        options["nullValue"] = null_value
    if comment_char is not None:
        options["comment"] = comment_char
    if trim_whitespace:
        options |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    if not skip_starting_rows and max_rows is None and not file_metadata:
        reader = _reader(spark, file_filter, recursive).options(**options)
        return reader.csv(path, schema=schema) if schema is not None else reader.csv(path)
    counted = numbered_lines(spark, path, file_filter=file_filter, recursive=recursive).where(F.col(LINE) > skip_starting_rows)
    lines = _records(counted, comment_char)
    first_data = 2 if has_header else 1
    line_options = {k: v for k, v in options.items() if k not in ("header", "comment")}
    if schema is None:
        schema = _header_schema(lines, line_options, has_header)
    rows = lines.where(F.col(LINE) >= first_data)
    if max_rows is not None:
        rows = rows.where(F.col(LINE) < first_data + max_rows)
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = rows.withColumn("_r", F.from_csv("value", ddl, line_options))
    extra = []
    if file_metadata:
        extra = ["df_file_name", "df_file_modified", (F.col(LINE) - first_data + 1).alias("df_row_number")]
    return parsed.select("_r.*", *extra)


def _records(lines: DataFrame, comment_char: str | None) -> DataFrame:
    """The lines that are neither blank nor comments, numbered anew by their order in the file."""
    kept = F.trim("value", F.lit(" \t\r")) != ""
    return _renumbered(lines.where(kept if comment_char is None else kept & ~F.col("value").startswith(comment_char)))


def _renumbered(lines: DataFrame) -> DataFrame:
    """Number the lines that are left in each file from 1, by counts per split."""
    splits = lines.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(FILE, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # A window covers one split of a file, which maxPartitionBytes bounds.
    place = F.row_number().over(Window.partitionBy(FILE, BLOCK).orderBy(LINE))
    return lines.join(offsets, [FILE, BLOCK]).withColumn(LINE, F.col("_before") + place).drop("_before")


def _header_schema(lines: DataFrame, options: dict[str, str], has_header: bool) -> T.StructType:
    """Text columns named by the first line, which is parsed as a record like any other."""
    first = lines.where(F.col(LINE) == 1).select("value").first()
    if first is None:
        raise ValueError("no line to take the columns from; state a schema")
    names = _cells(lines.sparkSession, [first["value"]], options)[0]
    return T.StructType([T.StructField(n if has_header and n else f"_c{i}", T.StringType()) for i, n in enumerate(names)])


def _positions(headers: Sequence[str], sep: str) -> str:
    """Text columns c0, c1, ... for the widest of some lines."""
    return ", ".join(f"c{i} string" for i in range(max(h.count(sep) for h in headers) + 1))


def _cells(spark: SparkSession, headers: Sequence[str], options: dict[str, str]) -> list[list[str | None]]:
    """Header lines parsed as records, without empty cells at the end."""
    df = spark.createDataFrame(list(enumerate(headers)), "at int, value string")
    rows = df.select("at", F.from_csv("value", _positions(headers, options["sep"]), options).alias("r")).collect()
    out = []
    for row in sorted(rows, key=lambda r: r["at"]):
        names = list(row["r"])
        while len(names) > 1 and names[-1] is None:
            names.pop()
        out.append(names)
    return out


def union_by_header(
    spark: SparkSession, path, delimiter: str = ",", quote: str = '"', comment_char: str | None = None, **select
) -> DataFrame:
    """Delimited files with different headers as one table of text; absent columns are NULL.

    One scan: a record is parsed once, by position, and its cells are named by the header of its own
    file, the first line that is neither blank nor a comment.  Headers are records too, so their
    names may be quoted; a column without a name is ``_c`` and its position, and of equal names in a
    file the first counts.  Only the distinct headers (one per schema version) come to the driver.
    One record per line.
    """
    lines = _records(numbered_lines(spark, path, **select), comment_char).select(FILE, LINE, "value")
    heads = lines.where(F.col(LINE) == 1).select(FILE, F.col("value").alias("_head"))
    versions = [r["_head"] for r in heads.select("_head").distinct().orderBy("_head").collect()]
    if not versions:
        raise ValueError("no header to take the columns from")
    options = {"sep": delimiter, "quote": quote}
    places: dict[str, list[tuple[str, int]]] = {}
    for head, cells in zip(versions, _cells(spark, versions, options)):
        names = [(n or f"_c{i}").strip() for i, n in enumerate(cells)]
        for n in dict.fromkeys(names):
            places.setdefault(n, []).append((head, names.index(n)))
    body = lines.where(F.col(LINE) > 1).join(heads, FILE)
    body = body.withColumn("_r", F.from_csv("value", _positions(versions, delimiter), options))

    def value(found: list[tuple[str, int]]):
        return F.coalesce(*[F.when(F.col("_head") == head, F.col(f"_r.c{i}")) for head, i in found])

    return body.select(*[value(found).alias(n) for n, found in places.items()])


def with_lineage(df: DataFrame, dataset: str) -> DataFrame:
    """Add df_file_name, df_file_modified, df_dataset and df_row_number to a Parquet scan."""
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("df_file_name"),
        F.col("_metadata.file_modification_time").alias("df_file_modified"),
        F.lit(dataset).alias("df_dataset"),
        (F.col("_metadata.row_index") + 1).alias("df_row_number"),
    )


def read_parquet(
    spark: SparkSession, path, max_rows: int | None = None, file_filter: str | None = None, recursive: bool = False
) -> DataFrame:
    """Parquet scan; ``max_rows`` is per file and uses the row position, without a sort."""
    df = _reader(spark, file_filter, recursive).option("mergeSchema", "true").parquet(path)
    return df if max_rows is None else df.where(F.col("_metadata.row_index") < max_rows)


def read_orc(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("mergeSchema", "true").orc(path)


def read_xml(spark: SparkSession, path, row_tag: str, schema=None, attribute_prefix: str = "attr_", namespaces: bool = False):
    """One row per ``row_tag`` element; prefixes are stripped unless ``namespaces``."""
    reader = spark.read.option("rowTag", row_tag).option("attributePrefix", attribute_prefix)
    reader = reader.option("ignoreNamespace", str(not namespaces).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format("xml").load(path)


def detect_schema(df: DataFrame, sketch_bits: int | None = None) -> DataFrame:
    """(column_name, data_type, nulls, distinct_values) of a scan.

    Exact distinct counts multiply each row by the number of columns; with ``sketch_bits`` they are
    estimates of sketches with 2^bits slots (14: a standard error of about 0.8 %).
    """
    facts = []
    for c, t in df.dtypes:
        number = F.countDistinct(c) if sketch_bits is None else F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(sketch_bits)))
        facts += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), number.alias(f"{c}__distinct")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.col(f"{c}__nulls").alias("nulls"),
                F.col(f"{c}__distinct").alias("distinct_values"),
            )
            for c, t in df.dtypes
        ]
    )
    return df.agg(*facts).select(F.explode(rows).alias("r")).select("r.*")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as typed ones; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def infer_types(df: DataFrame, columns: Sequence[str], order=("bigint", "double", "timestamp")) -> dict[str, str]:
    """The first type in ``order`` that every non-empty value of a text column fits.

    One aggregate over all columns; columns without values stay text.
    """
    aggs = []
    for c in columns:
        filled = F.nullif(F.trim(c), F.lit(""))
        aggs.append(F.count(filled).alias(f"{c}__n"))
        aggs += [F.count(filled.try_cast(t)).alias(f"{c}__{t}") for t in order]
    found = df.agg(*aggs).first()
    out = {}
    for c in columns:
        fits = [t for t in order if found[f"{c}__n"] and found[f"{c}__{t}"] == found[f"{c}__n"]]
        out[c] = fits[0] if fits else "string"
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): how many rows one read has and the other lacks, duplicates counted."""
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a"))
    return only_a.withColumn("only_b", b.exceptAll(a).agg(F.count(F.lit(1))).scalar())


def not_loaded(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not hold yet (a load that may be replayed)."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")
