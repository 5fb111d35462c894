import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.sources import catalog, readers

CATALOG = catalog.FeatureCatalog("k", "y", "i", (catalog.Feature("a", "g"), catalog.Feature("b", "g", "axis", "unit", "text | here", True)))


def test_csv_headers_and_nan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i, a,b \n1,NaN,x\n2,0.5,\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["i", "a", "b"]
    assert [r.a for r in df.orderBy("i").collect()] == [None, 0.5]
    typed = readers.read_csv(spark, str(tmp_path / "t.csv"), "i int, a double, b string")
    assert dict(typed.dtypes) == {"i": "int", "a": "double", "b": "string"}


def test_colliding_names(spark):
    with pytest.raises(ValueError, match="collide"):
        readers.trimmed_names(spark.createDataFrame([(1, 2)], ["a", " a"]))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_preview_and_largest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "small.csv").write_text("a\n1\n")
    (tmp_path / "d" / "large.csv").write_text("a\n" + "1\n" * 50)
    (tmp_path / "d" / "larger.txt").write_text("x" * 1000)
    assert readers.largest_file(spark, str(tmp_path)).endswith("large.csv")
    rows, width, there = readers.preview(readers.read_csv(spark, str(tmp_path / "d" / "large.csv")), "y")
    assert (rows.count(), width, there) == (5, 1, False)


def test_materialized_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for force in (False, False, True):
        assert readers.materialized(spark, make, str(tmp_path / "t"), force).count() == 3
    assert len(calls) == 2


def test_store_survives_a_broken_write(spark, tmp_path):
    """Nothing stands at the path until all of it is written; what lay beside is gone."""
    path = tmp_path / "t"
    half = spark.range(4).select((F.lit(1) / F.when(F.col("id") < 3, 1).otherwise(F.raise_error(F.lit("broken")).cast("int"))).alias("x"))
    with pytest.raises(PySparkException):
        readers.materialized(spark, lambda: half, str(path))
    assert not path.exists() and list(tmp_path.iterdir()) == []
    assert readers.materialized(spark, lambda: spark.range(3), str(path)).count() == 3


def test_store_of_two_writers(spark, tmp_path):
    """The second to finish takes the first one's table."""
    path = str(tmp_path / "t")

    def slow():
        readers.materialized(spark, lambda: spark.range(5), path, source="s")
        return spark.range(7)

    assert readers.materialized(spark, slow, path, source="s").count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(readers.StoreError, match="another source"):
        readers.materialized(spark, lambda: spark.range(5), path, source="other")
    assert readers.materialized(spark, lambda: spark.range(9), path, force=True, source="other").count() == 9


def test_store_notices_other_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(readers.StoreError, match="no finished store"):
        readers.materialized(spark, lambda: spark.range(3), str(tmp_path / "plain"))
    path = str(tmp_path / "t")
    readers.materialized(spark, lambda: spark.range(3), path)
    spark.range(2).write.mode("append").parquet(path)
    with pytest.raises(readers.StoreError, match="not what its marker says"):
        readers.materialized(spark, lambda: spark.range(3), path)
    assert readers.fingerprint("a", 1) == readers.fingerprint("a", 1) != readers.fingerprint("a", 2)


def test_settings(monkeypatch, spark):
    monkeypatch.setenv("RISKLOOM_FOLDS", "7")
    assert readers.Settings.from_environment() == readers.Settings(folds=7)
    assert readers.doctor(spark, readers.Settings(data_dir="/nowhere"))["data"] is False


def test_catalog(spark):
    df = spark.createDataFrame([(1, "k", 1, 0.5, "s")], "i int, k string, y int, a double, b string")
    assert CATALOG.strings(df) == ["b"] and CATALOG.numerics(df) == ["a"] and CATALOG.missing_from(df.drop("a")) == ["a"]
    assert CATALOG.with_metadata(df).schema["b"].metadata == {"group": "g", "axis": "axis", "unit": "unit"}
    assert CATALOG.group_of("b") == "g" and CATALOG.group_of("zzz") == "other"
    assert [r.axis for r in CATALOG.table(spark).orderBy("column").collect()] == ["g", "axis"]
