"""Summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotmark.functions.scalars import col
from plotmark.operators.skew import attach_groups
from plotmark.session import materialize

# Sketch accuracy used to bracket an exact percentile; the rank error is under n / SKETCH.
SKETCH = 10_000
# Distinct values of a group that one task may order; brackets that may hold more are searched digit by digit.
ORDERED_VALUES = 1_000_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact percentiles per group with linear interpolation, plus the value count ``n``.

    A sketch gives each group a narrow bracket that must hold the wanted rank. Rows
    are then counted below the bracket and, by distinct value, inside it; only those
    few counts are ordered. No task holds the values of a whole large group; a group
    of up to SKETCH values is its own bracket.

    A bracket holds under 8 / SKETCH of its group. Where that may pass ``ORDERED_VALUES`` for the largest
    group, nothing is ordered by value: see ``_by_digits``.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna()
    names, wanted = list(probs), [float(p) for p in probs.values()]
    margin = 3.0 / SKETCH
    edges = [e for p in wanted for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, SKETCH).alias("_e"),
    )
    small = F.col("_n") <= SKETCH
    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                ((F.col("_n") - 1) * p).alias("rank"),
                (F.col("_min") if p <= margin else F.when(small, F.col("_min")).otherwise(F.col("_e")[2 * i])).alias("lo"),
                (F.col("_max") if p >= 1 - margin else F.when(small, F.col("_max")).otherwise(F.col("_e")[2 * i + 1])).alias("hi"),
            )
            for i, (name, p) in enumerate(zip(names, wanted))
        ]
    )
    sketch = sketch.select(*keys, "_n", brackets.alias("_b"), F.col("_n").alias("_size"))
    sketch = materialize(sketch, "brackets")
    largest = sketch.agg(F.max("_size")).first()[0] or 0
    if keys:
        located = attach_groups(rows, sketch, keys, "_size", "inner")
    else:
        one = sketch.select(F.struct("_n", "_b")).scalar()
        located = rows.withColumn("_s", one).select("_v", "_s._n", "_s._b")
    side = located.select(*keys, "_v", F.inline("_b")).filter(F.col("_v") <= F.col("hi"))
    inside = F.col("_v") >= F.col("lo")
    counts = side.groupBy(*keys, "name", "rank", F.when(inside, F.col("_v")).alias("v")).agg(F.count("*").alias("c"))
    pick = _by_digits if min(largest, max(SKETCH, 8 * largest / SKETCH)) > ORDERED_VALUES else _by_order
    picked = pick(counts, keys)
    low = F.floor("rank")
    ok = (F.coalesce("below", F.lit(0)) <= low) & F.col("b").isNotNull()
    result = F.when(ok, F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).otherwise(
        F.raise_error(F.lit("percentile rank outside its bracket")).cast("double")
    )
    wide = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, result)).alias(n) for n in names])
    return wide


def _by_order(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The values ``a`` and ``b`` around each rank, and the rows ``below`` the bracket, by running counts."""
    group = Window.partitionBy(*keys, "name").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("c").over(group.rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("v").isNotNull()
    return counts.withColumn("upto", upto).groupBy(*keys, "name", "rank").agg(
        F.min(F.when((F.col("upto") > F.floor("rank")) & known, F.col("v"))).alias("a"),
        F.min(F.when((F.col("upto") > F.ceil("rank")) & known, F.col("v"))).alias("b"),
        F.max(F.when(~known, F.col("c"))).alias("below"),
    )


def ordered_bits(v: Column) -> Column:
    """A long that orders as the double ``v`` does: its magnitude's exponent and fraction bits, with the sign."""
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    two = F.lit(2.0)
    # A logarithm next to a whole number may be rounded across it.
    fixed = F.when(size < F.pow(two, guess), guess - 1).when(size / two >= F.pow(two, guess), guess + 1).otherwise(guess)
    exponent = F.greatest(fixed, F.lit(-1022))
    fraction = (size / F.pow(two, exponent) * F.lit(2.0**52)).cast("long")
    bits = (exponent + 1022).cast("long") * F.lit(2**52) + fraction
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(bits)
    return F.when(v < 0, -bits).otherwise(bits)


def _by_digits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_by_order``, with no order of values: four rounds fix 16 bits each of the wanted values.

    A round counts the rows of every digit that follows the bits found so far, so at most
    65,536 sums a wanted value are ordered, whatever the group's size.
    """
    group = [*keys, "name"]
    ends = F.array(*[F.struct(F.lit(n).alias("end"), f("rank").alias("want")) for n, f in (("a", F.floor), ("b", F.ceil))])
    counted = materialize(counts.withColumn("bits", ordered_bits(F.col("v"))), "counts")
    heads = counted.groupBy(*group, "rank").agg(F.max(F.when(F.col("v").isNull(), F.col("c"))).alias("below"))
    found = heads.select(*group, "rank", "below", F.inline(ends)).withColumns(
        {"prefix": F.lit(None).cast("long"), "before": F.coalesce("below", F.lit(0).cast("long"))}
    )
    values = counted.filter(F.col("v").isNotNull()).select(*group, "v", "c", "bits")
    running = Window.partitionBy(*group, "end").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("bits", shift)
        # A digit with all bits above it; the first has the sign.
        follows = F.shiftright("bits", shift + 16) == F.col("prefix") if shift < 48 else F.lit(True)
        sums = (
            values.join(found, group)
            .filter(follows)
            .groupBy(*group, "end", "rank", "below", "want", "before", digit.alias("_digit"))
            .agg(F.sum("c").alias("_n"), F.min("v").alias("v"))
        )
        reached = sums.withColumn("_upto", F.col("before") + F.sum("_n").over(running))
        hit = reached.filter((F.col("_upto") > F.col("want")) & (F.col("_upto") - F.col("_n") <= F.col("want")))
        found = materialize(
            hit.select(*group, "end", "rank", "below", "want", F.col("_digit").alias("prefix"), (F.col("_upto") - F.col("_n")).alias("before"), "v"),
            "digits",
        )
        # The last round's digit is the whole value.
        found = found if shift == 0 else found.drop("v")
    values = found.groupBy(*group).agg(*[F.max(F.when(F.col("end") == end, F.col("v"))).alias(end) for end in ("a", "b")])
    return heads.join(values, group, "left")


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group and the number of values (A5)."""
    counts = df.dropna(subset=[*keys, value]).groupBy(*keys).agg(F.count("*").alias("n"))
    return exact_percentiles(df, keys, value, {name: 0.5}).join(counts, list(keys))


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), probs: Sequence[float] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, moments and exact percentiles."""
    moments = df.dropna(subset=[*by, value]).groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("excess_kurtosis"),
    )
    quantiles = exact_percentiles(df, by, value, {f"p{round(p * 100):02d}": p for p in probs})
    if by:
        return moments.join(quantiles, list(by))
    packed = quantiles.select(F.struct(*quantiles.columns)).scalar()
    return moments.withColumn("_q", packed).select(*moments.columns, "_q.*")


def weighted_mean(df: DataFrame, columns: Sequence[str], weight: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted means; a row counts for a column only where that column is known."""
    w = col(weight)
    return df.groupBy(*by).agg(
        *[
            F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c)
            for c in columns
        ]
    )


def exposure_matrix(df: DataFrame, counts: Mapping[str, str], shares: Mapping[str, str], weights: Mapping[str, Column]) -> DataFrame:
    """Share of group j in the area of an average member of group i.

    ``counts`` and ``shares`` map a group to its count and share column; ``weights``
    names population classes, such as flagged and unflagged. Rows
    (group_i, weight, group_j, exposure); everything is one aggregate.
    """
    cells = [(i, w, j) for i in counts for w in weights for j in shares]
    totals = [F.sum(F.col(counts[i]) * weights[w]).alias(f"t{a}_{b}") for a, i in enumerate(counts) for b, w in enumerate(weights)]
    sums = [
        F.sum(F.col(counts[i]) * weights[w] * F.col(shares[j])).alias(f"s{n}") for n, (i, w, j) in enumerate(cells)
    ]
    ia, wb = list(counts), list(weights)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("group_i"),
                F.lit(w).alias("weight"),
                F.lit(j).alias("group_j"),
                F.try_divide(F.col(f"s{n}"), F.col(f"t{ia.index(i)}_{wb.index(w)}")).alias("exposure"),
            )
            for n, (i, w, j) in enumerate(cells)
        ]
    )
    return df.agg(*totals, *sums).select(F.inline(rows))


def stacked_means(df: DataFrame, columns: Sequence[str], groupings: Sequence[tuple[str, str, Column | None]]) -> DataFrame:
    """Column means under several (label, key, condition) groupings, stacked.

    Each row is listed once per grouping it belongs to, so all groupings share one
    scan and one shuffle of partial sums.
    """
    member = [
        F.when(
            F.col(key).isNotNull() & (F.lit(True) if where is None else where),
            F.struct(F.lit(label).alias("grouping"), F.col(key).cast("string").alias("value")),
        )
        for label, key, where in groupings
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*member))).alias("_m"), *columns)
        .groupBy(F.col("_m.grouping").alias("grouping"), F.col("_m.value").alias("value"))
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    )


def attrition(df: DataFrame, status: str, stages: Mapping[str, Column]) -> DataFrame:
    """Rows per status that survive each stage."""
    return df.groupBy(status).agg(
        F.count("*").alias("all_rows"), *[F.count_if(test).alias(name) for name, test in stages.items()]
    )


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Counts of ``a`` by fixed values of ``b``."""
    return df.dropna(subset=[a]).groupBy(a).agg(
        *[F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in values]
    )


def value_counts(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    source = df if where is None else df.filter(where)
    return source.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))


def distinct_if(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Distinct values of each key under each condition: rows (key, condition, n).

    Rows are reduced to distinct (key, value) pairs with a bit per condition before
    anything is counted.
    """
    names = list(conditions)
    values = F.explode(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    )
    pairs = (
        df.select(values.alias("_kv"), *[F.coalesce(conditions[n], F.lit(False)).alias(f"_c{i}") for i, n in enumerate(names)])
        .filter(F.col("_kv.value").isNotNull())
        .groupBy("_kv")
        .agg(*[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(names))])
    )
    counted = pairs.groupBy(F.col("_kv.key").alias("key")).agg(
        *[F.count_if(F.col(f"_c{i}")).alias(f"n{i}") for i in range(len(names))]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])
    return counted.select("key", F.inline(rows))


def standardise(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Z-scores from one row of means and deviations."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
        ).alias("_z")
    )
    return (
        df.withColumn("_z", stats.scalar())
        .withColumns({f"{prefix}{c}": F.try_divide(F.col(c) - F.col(f"_z.m_{c}"), F.col(f"_z.s_{c}")) for c in columns})
        .drop("_z")
    )


def levels_of(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Sorted distinct values of a factor. Each becomes a column in ``one_hot``; fits of factors with
    very many levels need no columns, see ``models.factors``. With ``limit``, more are an error."""
    found = df.select(column).dropna().distinct().orderBy(column)
    found = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return [r[0] for r in found]


def one_hot(df: DataFrame, column: str, levels: Sequence, drop_first: bool = False) -> DataFrame:
    """0/1 columns ``column_1 ... column_n`` in the order of the sorted levels."""
    used = list(enumerate(levels, 1))[1 if drop_first else 0 :]
    return df.withColumns({f"{column}_{i}": F.when(F.col(column) == v, 1).otherwise(0) for i, v in used})


def interact(df: DataFrame, treat: str, columns: Sequence[str]) -> DataFrame:
    """Products of the treatment with other columns; null where either is null."""
    return df.withColumns({f"{treat}_x_{c}": F.col(treat) * F.col(c) for c in columns})


def share_within(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Flagged, total and share per key."""
    return df.dropna(subset=[key]).groupBy(key).agg(
        F.count_if(flag).alias("flagged"),
        F.count("*").alias("total"),
        (F.count_if(flag) / F.count("*")).alias("share"),
    )
