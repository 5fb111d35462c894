"""Feature catalogs: names, groups, axes and units travel in the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    axis: str | None = None
    unit: str = ""
    description: str = ""
    needs_verification: bool = False


@dataclass(frozen=True)
class FeatureCatalog:
    key: str
    target: str
    row_id: str
    features: tuple[Feature, ...] = field(default_factory=tuple)

    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def strings(self, df: DataFrame) -> list[str]:
        """Features that are not numeric, by schema."""
        return [n for n in self.names() if not isinstance(df.schema[n].dataType, T.NumericType)]

    def numerics(self, df: DataFrame) -> list[str]:
        return [n for n in self.names() if n not in self.strings(df)]

    def group_of(self, name: str, default: str = "other") -> str:
        return next((f.group for f in self.features if f.name == name), default)

    def table(self, spark: SparkSession) -> DataFrame:
        """column, group, axis (the group where none is given), unit, description, needs_verification."""
        rows = [(f.name, f.group, f.axis or f.group, f.unit, f.description, f.needs_verification) for f in self.features]
        return spark.createDataFrame(rows, "column string, `group` string, axis string, unit string, description string, needs_verification boolean")

    def with_metadata(self, df: DataFrame) -> DataFrame:
        for f in self.features:
            df = df.withMetadata(f.name, {"group": f.group, "axis": f.axis or f.group, "unit": f.unit})
        return df

    def missing_from(self, df: DataFrame) -> list[str]:
        return [n for n in (self.row_id, self.key, self.target, *self.names()) if n not in df.columns]
