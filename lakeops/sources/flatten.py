"""Flatten nested JSON or XML rows into columns, by a configuration of dotted paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Flatten:
    """What to keep and how.

    Paths are dotted, from ``root_path``.  ``include_paths`` (empty = all) and
    ``exclude_paths`` name subtrees.  ``text_paths`` keep a subtree as one JSON column.
    ``explode_paths`` give one row per array element, parents repeated.  ``arrays`` says
    what other arrays become: to_json, count or join_comma.  ``column_mappings`` renames.
    Structs below ``max_depth`` stay one JSON column; by default there is no such limit.
    """

    root_path: str = ""
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    text_paths: tuple[str, ...] = ()
    explode_paths: tuple[str, ...] = ()
    column_mappings: dict[str, str] = field(default_factory=dict)
    arrays: str = "to_json"
    separator: str = "_"
    max_depth: int | None = None
    infer_types: bool = True


def _under(path: str, roots: tuple[str, ...]) -> bool:
    return any(path == r or path.startswith(r + ".") for r in roots)


def _leads_to(path: str, roots: tuple[str, ...]) -> bool:
    return any(r.startswith(path + ".") for r in roots)


def _array_value(c: Column, how: str) -> Column:
    if how == "count":
        return F.size(c).cast("long")
    if how == "join_comma":
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return F.to_json(c)


def _leaves(schema: T.StructType, cfg: Flatten, prefix: str = "", depth: int = 1):
    """(path, column, type) of every output column below a struct."""
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if _under(path, cfg.exclude_paths):
            continue
        wanted = not cfg.include_paths or _under(path, cfg.include_paths)
        if not wanted and not _leads_to(path, cfg.include_paths):
            continue
        c = F.col("_row." + ".".join(f"`{p}`" for p in path.split(".")))
        if isinstance(f.dataType, T.StructType) and path not in cfg.text_paths and (cfg.max_depth is None or depth < cfg.max_depth):
            yield from _leaves(f.dataType, cfg, path, depth + 1)
        elif wanted:
            yield path, c, f.dataType


def _explode(df: DataFrame, path: str) -> DataFrame:
    """Replace the array at a path by its elements, one row each; none keeps the row."""
    parts = path.split(".")
    array = F.col("_row." + ".".join(f"`{p}`" for p in parts))
    spread = df.withColumn("_e", F.explode_outer(array))
    return spread.withColumn("_row", F.col("_row").withField(".".join(f"`{p}`" for p in parts), F.col("_e"))).drop("_e")


def flatten(df: DataFrame, cfg: Flatten, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat columns of every row; ``keep`` columns (lineage, say) pass through as they are."""
    body = [c for c in df.columns if c not in keep]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in body]).alias("_row"), *keep)
    if cfg.root_path:
        rows = rows.select(F.col(f"_row.{cfg.root_path}").alias("_row"), *keep)
        if isinstance(rows.schema["_row"].dataType, T.ArrayType):
            rows = rows.withColumn("_row", F.explode_outer("_row"))
    for path in cfg.explode_paths:
        rows = _explode(rows, path)
    out = []
    for path, c, dtype in _leaves(rows.schema["_row"].dataType, cfg):
        if isinstance(dtype, T.ArrayType):
            c = F.to_json(c) if path in cfg.text_paths else _array_value(c, cfg.arrays)
        elif isinstance(dtype, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif not cfg.infer_types:
            c = c.cast("string")
        name = cfg.column_mappings.get(path) or path.replace(".", cfg.separator)
        out.append(c.alias(name))
    return rows.select(*out, *keep)


def _parsed(bundles: DataFrame, text: str, resource_schema: str) -> DataFrame:
    schema = f"""id string, type string, timestamp string, total bigint,
        entry array<struct<fullUrl: string, resource: struct<resourceType: string, {resource_schema}>>>"""
    return bundles.select(F.from_json(text, schema).alias("b"))


def resolve_references(
    bundles: DataFrame, text: str, resource_schema: str, resource_type: str, reference: str, target_type: str
) -> DataFrame:
    """Entries of one type with the entry of ``target_type`` that their ``reference`` names in the same bundle.

    Gives bundle_id, df_full_url, resource and target (null where the bundle has no such entry; of
    several, the first).  The text is parsed once and references are looked up in the row, without a
    shuffle; the work grows with the entries of a bundle times its references.
    """
    of_type = lambda kind: F.filter("b.entry", lambda e: e["resource"]["resourceType"] == kind)
    entries = _parsed(bundles, text, resource_schema).select(
        F.col("b.id").alias("bundle_id"), of_type(target_type).alias("_targets"), F.explode(of_type(resource_type)).alias("_e")
    )
    wanted = F.col(f"_e.resource.{reference}")
    found = F.get(F.filter("_targets", lambda e: e["fullUrl"] == wanted), F.lit(0))
    return entries.select("bundle_id", F.col("_e.fullUrl").alias("df_full_url"), F.col("_e.resource").alias("resource"), found["resource"].alias("target"))


def unbundle(bundles: DataFrame, text: str, resource_schema: str, resource_types: tuple[str, ...] = ()) -> DataFrame:
    """One row per entry of FHIR bundles held as JSON text.

    Gives df_full_url, resourcetype, the resource fields and the bundle's id, type,
    timestamp and stated total.  The text is parsed once, with only the listed fields.
    """
    entries = _parsed(bundles, text, resource_schema).select(
        F.col("b.id").alias("bundle_id"),
        F.col("b.type").alias("bundle_type"),
        F.col("b.timestamp").alias("bundle_timestamp"),
        F.col("b.total").alias("bundle_total"),
        F.explode("b.entry").alias("e"),
    )
    if resource_types:
        entries = entries.where(F.col("e.resource.resourceType").isin(*resource_types))
    return entries.select(
        "bundle_id",
        "bundle_type",
        "bundle_timestamp",
        "bundle_total",
        F.col("e.fullUrl").alias("df_full_url"),
        F.col("e.resource.resourceType").alias("resourcetype"),
        F.col("e.resource").alias("resource"),
    )
