"""Writers: CSV with the usual boolean spelling, nested JSON summaries, JSON lines, map points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# The columns of the sample for reviewers, by the field they come from; reviewers fill those that come from none.
VALIDATION_COLUMNS = {
    "source": "source", "source_type": "source_type", "source_listing_id": "source_listing_id", "source_url": "source_url", "title": "title", "city": "city", "district": "district", "subdistrict": "subdistrict",
    "community_name": "community_name", "rent_price": "rent_price", "rent_price_unit": "rent_unit", "currency": "currency", "area_sqm": "area_sqm", "layout": "layout", "floor": "floor", "deposit": "deposit",
    "subway_info": "subway_info", "published_at": "published_at", "price_confidence": "price_confidence", "location_confidence": "location_confidence", "area_confidence": "area_confidence",
    "layout_confidence": "layout_confidence", "overall_confidence": "overall_confidence",
}
REVIEWER_COLUMNS = ("人工验证状态", "人工备注")
# The columns of exported candidates.
FILTER_COLUMNS = ("accepted", "reasons", "source", "source_listing_id", "source_url", "title", "district", "subdistrict", "community_name", "rent_price", "area_sqm", "layout", "description", "parse_confidence")


def validation_rows(df: DataFrame) -> DataFrame:
    """The sample for reviewers: fields under the exported names, those that ``df`` lacks and the reviewers' own blank."""
    have = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if c == "published_at" else F.col(c)).alias(n) if c in df.columns else F.lit("").alias(n) for c, n in VALIDATION_COLUMNS.items()]
    return csv_ready(df.select(*have, *[F.lit("").alias(c) for c in REVIEWER_COLUMNS]))


def csv_ready(df: DataFrame, true: str = "True", false: str = "False") -> DataFrame:
    """Booleans as words, arrays and structs as JSON, null texts as empty."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            c = F.when(c, true).when(~c, false)
        elif kind == "array<string>":
            c = F.concat_ws("; ", c)
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        out.append((F.coalesce(c, F.lit("")) if kind in ("string", "boolean", "array<string>") else c).alias(name))
    return df.select(*out)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, single: bool = False, order: list[str] | None = None, bom: bool = False) -> None:
    """CSV with a header; ``single`` for small exports only, as it makes one task write them. ``bom`` marks the header of every
    file as UTF-8, as spreadsheets want it.
    """
    d = csv_ready(df.orderBy(*order) if order else df)
    if bom:
        d = d.withColumnRenamed(d.columns[0], BOM + d.columns[0])
    (d.coalesce(1) if single else d).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias(name))
