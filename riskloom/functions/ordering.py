"""Exact ranks, running totals and quantiles without sorting a whole group in one task.

Rows fall into buckets that follow the order; bucket totals are added up (combined before the shuffle), and only rows of
one bucket are sorted together. A group with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Slices of a running total. Their cuts come from the rows, so each holds about that share of them however the keys lie.
SLICES = 1024
#: Rows of one task that come from one repeated row.
CHUNK = 1 << 20


def sliced(rows: DataFrame, key: str, slices: int = SLICES) -> DataFrame:
    """Adds _slice, rising with `key` (a number without nulls). The cuts are quantiles from a mergeable sketch, one row sent to all tasks; a row finds its slice in
    log2(slices) comparisons. Equal keys share a slice, so count them before where they can be many."""
    width = 1 << (slices - 1).bit_length()
    cuts = rows.agg(F.percentile_approx(key, [i / width for i in range(1, width)], F.lit(20 * width)).alias("_cuts"))
    halves = F.array(*(F.lit(width >> i) for i in range(1, width.bit_length())))
    place = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.element_at("_cuts", at + step) < F.col(key), at + step).otherwise(at))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("_slice", place).drop("_cuts")


def running_totals(rows: DataFrame, key: str, sums: list[str], by: list[str] = (), tie: list[Column | str] = (), slices: int = SLICES) -> DataFrame:
    """Adds <s>_before (the sum of s over rows of lower key, then lower tie) and <s>_total for each s, within each group of `by`: sums inside a slice, and the totals
    of the slices before it. `key` and `tie` should tell rows apart."""
    placed = sliced(rows, key, slices)
    totals = placed.groupBy(*by, "_slice").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    lower = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    everything = Window.partitionBy(*by)
    offsets = totals.select(*by, "_slice", *(F.coalesce(F.sum(f"_{s}").over(lower), F.lit(0)).alias(f"_{s}_before") for s in sums), *(F.sum(f"_{s}").over(everything).alias(f"{s}_total") for s in sums))
    within = Window.partitionBy(*by, "_slice").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, [*by, "_slice"])
    return joined.withColumns({f"{s}_before": F.col(f"_{s}_before") + F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).drop("_slice", *(f"_{s}_before" for s in sums))


def global_rank(rows: DataFrame, key: Column, tie: list[Column], into: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Adds the row's rank from 0 among all rows, by a numeric key and then `tie`. Equal rows are counted first and dealt out again afterwards, in chunks if they are
    many, so a row that repeats a billion times is sorted once."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_key", key)
    placed = running_totals(counted, "_key", ["_n"], tie=tie).select(*rows.columns, "_n", "_n_before")
    dealt = lambda low, high: F.explode(F.sequence(low, high))
    few = placed.where(F.col("_n") <= chunk).withColumn("_i", dealt(F.lit(0).cast("long"), F.col("_n") - 1))
    many = placed.where(F.col("_n") > chunk).withColumn("_c", dealt(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))).repartition("_c", "_n_before")
    many = many.withColumn("_i", dealt(F.col("_c") * chunk, F.least(F.col("_n"), (F.col("_c") + 1) * chunk) - 1)).drop("_c")
    return few.unionByName(many).select(*rows.columns, (F.col("_n_before") + F.col("_i")).alias(into))


def hash_rank(df: DataFrame, by: list[str], key: Column, key_range: int, tie: list[str], into: str = "rank", buckets: int = 8192) -> DataFrame:
    """Adds the row's rank from 0 within its group, by an integer key in [0, key_range) and then `tie`."""
    placed = df.withColumn("_key", key.cast("long")).withColumn("_bucket", F.floor(F.col("_key") * buckets / key_range))
    totals = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy("_key", *tie)
    return placed.join(offsets, [*by, "_bucket"]).withColumn(into, F.col("_before") + F.row_number().over(within) - 1).drop("_key", "_bucket", "_before")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: what stands after a generator is not put into later expressions again and again."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_one")
    return df.select("*", one).select(*df.columns, *(F.col(f"_one.{n}").alias(n) for n in columns))


def with_ordered_bits(df: DataFrame, v: Column, into: str) -> DataFrame:
    """Adds a double's place among all doubles, as a signed integer: larger values have larger ones, both zeros have 0. These are the bits of its size, put together
    by exact arithmetic, in generated code."""
    size = F.abs(v)
    guess = F.least(F.floor(F.log2(size)), F.lit(1023))
    df = _once(df, _neg=v < 0, _size=size, _exponent=guess, _scaled=size / F.pow(F.lit(2.0), guess))  # divided by a power of two: exact; the guess may be off by one
    size, exponent, scaled = F.col("_size"), F.col("_exponent"), F.col("_scaled")
    normal = lambda e, x: (e + 1023) * F.lit(2**52) + F.floor((x - 1) * 2.0**52)
    finite = F.when(scaled < 1, normal(exponent - 1, scaled * 2)).when(scaled >= 2, normal(exponent + 1, scaled * 0.5)).otherwise(normal(exponent, scaled))
    bits = F.when(size == float("inf"), F.lit(2047 * 2**52)).when(size < 2.0**-1022, F.floor(size * 2.0**537 * 2.0**537)).otherwise(finite)
    df = _once(df, _bits=bits)
    return _once(df, **{into: F.when(F.col("_neg"), -F.col("_bits")).otherwise(F.col("_bits"))}).drop("_neg", "_size", "_exponent", "_scaled", "_bits")


def value_at(bits: int) -> float:
    """The double at that place."""
    size = struct.unpack(">d", struct.pack(">q", abs(bits)))[0]
    return -size if bits < 0 else size


@dataclass
class Quantiles:
    """What one group holds: known values, zeros among them, whether zeros were left out, and the quantiles (None without values)."""

    group: tuple
    n: int
    zeros: int
    without_zeros: bool
    quantiles: list[float] | None


def _between(places: list[float], n: int, at: dict[int, float]) -> list[float]:
    found = []
    for p in places:
        place = (n - 1) * p
        low, high = at[math.floor(place)], at[math.ceil(place)]
        found.append(low if low == high else low + (high - low) * (place - math.floor(place)))
    return found


#: Rows of a bucket that are counted value by value without another pass by leading bits.
DIRECT = 1 << 20


def less_own_fold(rows: DataFrame, keys: list[str], fold: str, k: int, sums: dict[str, Column], of_all: dict[str, Column] = {}, into: str = "_fold") -> DataFrame:  # noqa: B006
    """keys, `into` (0 to k - 1) and each sum over the rows of all other folds: the total less the fold's own, so rows are read once and not once a fold. Groups that
    have no row outside a fold have none for it. `of_all`: aggregates over all rows, whatever their fold."""
    own = {f"{s}_{i}": F.sum(F.when(F.col(fold) == i, c).otherwise(0)) for s, c in sums.items() for i in range(k)}
    totals = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"{s}_all") for s, c in sums.items()), F.count("*").alias("_rows_all"), *(c.alias(n) for n, c in {**own, **of_all}.items()), *(F.count_if(F.col(fold) == i).alias(f"_rows_{i}") for i in range(k)))
    each = [F.struct(F.lit(i).alias(into), (F.col("_rows_all") - F.col(f"_rows_{i}")).alias("_rows"), *((F.col(f"{s}_all") - F.col(f"{s}_{i}")).alias(s) for s in sums)) for i in range(k)]
    return totals.select(*keys, *of_all, F.explode(F.array(*each)).alias("_r")).select(*keys, *of_all, "_r.*").where("_rows > 0").drop("_rows")


def select_quantiles(values: DataFrame, by: list[str], value: str, probabilities: list[float], bits: int = 16, zero_share: float | None = None, folds: tuple[str, int] | None = None) -> list[Quantiles]:
    """Linear-interpolated quantiles of the known values of few groups (features, classes), by selection on ordered bits.

    One pass counts all groups' values by their leading bits. Only buckets that hold a wanted rank, and more than one value, are counted again, by the next bits, or
    by all the rest once they hold no more than DIRECT rows: two passes for most data, 64 / bits at most, whatever the distribution. A pass shuffles at most 2^bits
    (at the last, DIRECT) rows per task and bucket; the driver gets a row per group and wanted rank. Groups whose share of zeros reaches zero_share are taken without their zeros. With folds = (column, k), each group has k
    results, the i-th (its group ends with i) over the rows that are not of fold i, from the same passes.
    """
    v = F.col(value).cast("double")
    columns = [*by, *([folds[0]] if folds else [])]
    rows = with_ordered_bits(values.where(v.isNotNull() & ~F.isnan(v)).select(*columns, v.alias("_v")), F.col("_v"), "_key").drop("_v")
    names = [*by, *(["_fold"] if folds else [])]
    zero = (F.col("_key") == 0).cast("long")

    ends = {"_low": F.min("_key"), "_high": F.max("_key")}

    def counts(df: DataFrame, keys: list[str]) -> DataFrame:
        if folds:
            return less_own_fold(df, keys, *folds, {"_n": F.lit(1).cast("long"), "_z": zero}, ends)
        return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(zero).alias("_z"), *(c.alias(n) for n, c in ends.items()))

    at: dict[tuple, dict[int, float]] = {}

    def open_ranks(found: list[tuple]) -> dict:
        """(group, bucket): (rows in it, ranks within it and the ranks they stand for) of buckets with several values; the others are settled."""
        still = {}
        for g, r, ranks in found:
            if r["_low"] == r["_high"]:
                at.setdefault(g, {}).update({k: value_at(r["_low"]) for k in ranks.values()})
            else:
                still[g, r["_b"]] = (r["_n"], ranks)
        return still

    shift = 64 - bits
    all_of, lower = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = counts(rows.withColumn("_b", F.shiftright("_key", shift)), [*by, "_b"])
    counted = counted.withColumns({"_known": F.sum("_n").over(all_of), "_zeros": F.sum("_z").over(all_of)})
    without = F.lit(False) if zero_share is None else F.col("_zeros") / F.col("_known") >= zero_share
    counted = counted.withColumn("_without", without).withColumn("_n", F.col("_n") - F.when(F.col("_without"), F.col("_z")).otherwise(0))
    counted = counted.withColumns({"_total": F.sum("_n").over(all_of), "_before": F.coalesce(F.sum("_n").over(lower), F.lit(0))})
    place = lambda p: (F.col("_total") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities))))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    first = counted.withColumn("_ranks", inside).where((F.size("_ranks") > 0) | (F.col("_before") == 0)).collect()
    groups = {tuple(r[c] for c in names): r for r in first}
    wanted = open_ranks([(tuple(r[c] for c in names), r, {k - r["_before"]: k for k in r["_ranks"]}) for r in first if r["_ranks"]])
    fields = [*values.select(*by).schema.fields, *([T.StructField("_fold", T.IntegerType())] if folds else [])]
    group_fields = [T.StructField(f"_g{i}", f.dataType) for i, f in enumerate(fields)]
    bucket = T.StructField("_p", T.LongType())

    def same(columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(columns)), F.col("_q") == F.col("_p"))

    while wanted:
        before, shift = shift, 0 if max(n for n, _ in wanted.values()) <= DIRECT else max(0, shift - bits)
        create, n_by = values.sparkSession.createDataFrame, len(by)
        buckets = create(list({(*g[:n_by], b) for g, b in wanted}), T.StructType([*group_fields[:n_by], bucket]))
        small = create([(*g, b, groups[g]["_without"], list(r)) for (g, b), (_, r) in wanted.items()], T.StructType([*group_fields, bucket, T.StructField("_skip", T.BooleanType()), T.StructField("_wanted", T.ArrayType(T.LongType()))]))
        met = rows.withColumn("_q", F.shiftright("_key", before)).join(F.broadcast(buckets), same(by)).drop("_p")  # a row per group and wanted rank, at most
        parts = counts(met.withColumn("_b", F.shiftright("_key", shift)), [*by, "_q", "_b"]).join(F.broadcast(small), same(names))
        lower = Window.partitionBy(*names, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_n", F.col("_n") - F.when(F.col("_skip"), F.col("_z")).otherwise(0)).withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        hit = F.filter("_wanted", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        after = []
        for r in parts.withColumn("_hit", hit).where(F.size("_hit") > 0).collect():
            g = tuple(r[c] for c in names)
            stands_for = wanted[g, r["_p"]][1]
            after.append((g, r, {k - r["_before"]: stands_for[k] for k in r["_hit"]}))
        wanted = open_ranks(after)
    return [Quantiles(g, r["_known"], r["_zeros"], r["_without"], _between(probabilities, r["_total"], at[g]) if r["_total"] else None) for g, r in groups.items()]


def exact_quantiles(values: DataFrame, by: list[str], value: str, probabilities: list[float], bits: int = 16) -> DataFrame:
    """by, quantiles: linear-interpolated quantiles of the known values of few groups, in the probabilities' order. See `select_quantiles`."""
    found = [(*q.group, q.quantiles) for q in select_quantiles(values, by, value, probabilities, bits)]
    schema = T.StructType([*values.select(*by).schema.fields, T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    return values.sparkSession.createDataFrame(found, schema)
