"""Small results as Markdown; large ones belong in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def markdown_table(df: DataFrame) -> str:
    """A table of at most MOST_ROWS rows, in df's order; larger ones are refused, not cut."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write them as Parquet")
    text = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([text(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def markdown_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def data_dictionary(profile: DataFrame, catalog_rows: DataFrame) -> str:
    """One table per feature group: column, meaning, unit, missing and distinct values."""
    t = profile.join(catalog_rows.select("column", "unit", "description"), "column", "left")
    groups = sorted(r[0] for r in t.select("group").distinct().collect())
    columns = ["column", "description", "unit", "n_missing", "missing_pct", "n_distinct", "is_constant", "needs_verification"]
    return markdown_report("Data dictionary", {g: t.where(t["group"] == g).select(*columns).orderBy("column") for g in groups})
