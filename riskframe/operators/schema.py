"""Schema operators (B1-B18), implicit joins (C1-C3) and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce_numeric, map_lookup, word_or_number


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B1: rename columns present in ``mapping`` (absent keys ignored, like pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def strip_names(df: DataFrame) -> DataFrame:
    """B2: strip whitespace from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def tag_source(df: DataFrame, name: str, column: str = "DatasetSource") -> DataFrame:
    """Literal source tag."""
    return df.withColumn(column, F.lit(name))


def align(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Project onto a common column list, null-filling absent columns."""
    types = types or {}
    out = []
    for c in columns:
        if c in df.columns:
            out.append(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c))
        else:
            out.append(F.lit(None).cast(types.get(c, "double")).alias(c))
    return df.select(*out)


def align_union(frames: Iterable[DataFrame], columns: Sequence[str] | None = None,
                types: dict[str, str] | None = None) -> DataFrame:
    """G1 + B3: union of heterogeneous frames by name; missing columns are NULL.

    With ``columns`` every frame is first aligned to that list (reference
    depression pool); without, the union keeps every column seen (burnout pool).
    """
    frames = list(frames)
    if columns is not None:
        seen = {}
        for f in frames:
            for fld in f.schema.fields:
                seen.setdefault(fld.name, fld.dataType.simpleString())
        types = {**{c: seen[c] for c in columns if c in seen}, **(types or {})}
        frames = [align(f, columns, types) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unify_sources(frames: Sequence[DataFrame], specs: Sequence[dict], columns: Sequence[str] | None = None,
                  source_col: str = "DatasetSource") -> DataFrame:
    """B1 + B4 + B3 + G1: rename each source by its map, tag it, align and union."""
    renamed = [tag_source(rename_map(f, s.get("column_map", {})), s["source_name"], source_col)
               for f, s in zip(frames, specs)]
    if columns is not None:
        columns = list(columns) + ([source_col] if source_col not in columns else [])
    return align_union(renamed, columns)


def coerce_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Coerce the listed (present) columns to double; unparseable -> NULL."""
    from ..functions import nan_to_null
    from pyspark.sql import types as T
    out = {}
    for c in columns:
        if c not in df.columns:
            continue
        dt = df.schema[c].dataType
        out[c] = nan_to_null(c) if isinstance(dt, (T.NumericType,)) else coerce_numeric(c)
    return df.withColumns(out)


def words_or_numbers(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """Per column, map known words (lower/trim) else parse a number."""
    return df.withColumns({c: word_or_number(c, words) for c, words in mapping.items() if c in df.columns})


def scale_cols(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Coerce then multiply listed columns by a factor."""
    from ..functions import numeric_col
    return df.withColumns({c: numeric_col(df, c) * float(f) for c, f in factors.items() if c in df.columns})


def null_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null fraction per column, one scan, returned long (column, null_fraction).
    One count buffer per column and one for the rows."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', if(_rows = 0, null, (_rows - `{c}`) / _rows)" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, null_fraction)")


def sparse_names(df: DataFrame, threshold: float = 0.8, protect: Sequence[str] = ()) -> DataFrame:
    """One row (column) per column whose null fraction exceeds ``threshold``, minus the protect list; one scan."""
    return (null_fractions(df).where(F.col("null_fraction") > threshold)
            .where(~F.col("column").isin(list(protect))).select("column"))


def sparse_columns(df: DataFrame, threshold: float = 0.8, protect: Sequence[str] = ()) -> list[str]:
    """B8 (fit): the names of ``sparse_names``; only they reach the driver."""
    return [r["column"] for r in sparse_names(df, threshold, protect).collect()]


def drop_sparse(df: DataFrame, threshold: float = 0.8, protect: Sequence[str] = ()) -> DataFrame:
    """Drop columns that are more than ``threshold`` null."""
    return df.drop(*sparse_columns(df, threshold, protect))


def missing_flags(df: DataFrame, columns: Iterable[str], absent_value: int | None = None) -> DataFrame:
    """``X_missing`` = 1 when X is null.  Absent columns: skipped, or ``absent_value``."""
    out = {}
    for c in columns:
        if c in df.columns:
            out[f"{c}_missing"] = F.col(c).isNull().cast("int")
        elif absent_value is not None:
            out[f"{c}_missing"] = F.lit(int(absent_value))
    return df.withColumns(out)


def purge_leaks(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the listed columns if present."""
    return df.drop(*[c for c in columns if c in df.columns])


def feature_views(df: DataFrame, target: str, diagnostic: Sequence[str] = ("GAD7", "PHQ9")) -> tuple[DataFrame, DataFrame]:
    """Version A (all but target) and version B (also without diagnostic totals)."""
    a_cols = [c for c in df.columns if c != target]
    b_cols = [c for c in a_cols if c not in diagnostic]
    return df.select(*a_cols, target), df.select(*b_cols, target)


def select_by(df: DataFrame, *, endswith: str | None = None, contains: str | None = None,
              startswith: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Column names by predicate (driver-side metadata only)."""
    exclude = set(exclude)
    out = []
    for c in df.columns:
        if c in exclude:
            continue
        if endswith and not c.endswith(endswith):
            continue
        if contains and contains not in c.lower():
            continue
        if startswith and not c.startswith(startswith):
            continue
        out.append(c)
    return out


def default_fill(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Coalesce each field with its default; an absent column becomes the default."""
    out = {}
    for c, d in defaults.items():
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(d))) if c in df.columns else F.lit(float(d))
    return df.withColumns(out)


def masked_copy(df: DataFrame, columns: Sequence[str], new_source: str, source_col: str = "DatasetSource") -> DataFrame:
    """The frame plus a copy with ``columns`` nulled and retagged."""
    masked = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns if c in df.columns})
    return df.unionByName(masked.withColumn(source_col, F.lit(new_source)))


def enforce_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact feature order; fails early on a missing feature."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*features)


def feature_align(df: DataFrame, features: Sequence[str], default: float = 0.0,
                  missing_flag_default: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Add absent features (``*_missing`` -> 1, others -> ``default``), exact order."""
    cols = [F.col(k) for k in keep]
    for f in features:
        if f in df.columns:
            cols.append(F.col(f))
        else:
            cols.append(F.lit(float(missing_flag_default if f.endswith("_missing") else default)).alias(f))
    return df.select(*cols)


def lookup_column(df: DataFrame, column: str, mapping: dict, default=None, out: str | None = None) -> DataFrame:
    """Small fixed code -> value map (literal map, no join)."""
    return df.withColumn(out or column, map_lookup(mapping, column, default))


def lookup_join(df: DataFrame, table: DataFrame, key: str, value: str, default=None, out: str | None = None) -> DataFrame:
    """C1 (table form): left join to a dimension table; AQE broadcasts it when small."""
    joined = df.join(table.select(F.col(key), F.col(value).alias("_lk")), on=key, how="left")
    v = F.col("_lk") if default is None else F.coalesce(F.col("_lk"), F.lit(default))
    return joined.withColumn(out or value, v).drop("_lk")


def consensus(lists: DataFrame, name_col: str = "feature", list_col: str = "list_id", min_lists: int = 2) -> DataFrame:
    """Names present in at least ``min_lists`` of the lists."""
    return (lists.select(name_col, list_col).distinct().groupBy(name_col)
            .agg(F.count(F.lit(1)).alias("n_lists")).filter(F.col("n_lists") >= min_lists))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one side, tagged with the side they are in."""
    return (a.exceptAll(b).withColumn("side", F.lit("left_only"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only"))))


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows (NULL equals NULL, as in pandas)."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


def filter_rows(df: DataFrame, cond: Column | str) -> DataFrame:
    """Row filter from a Column or SQL predicate."""
    return df.filter(cond)
