"""Exact quantiles with linear interpolation, at any size.

``percentile`` keeps one counter per distinct value of a group. That is the right plan while a
sketch says there are few distinct values. Beyond that, one scan makes a mergeable quantile sketch per
group, which brackets all wanted ranks at once; a second scan verifies the brackets by counting and writes the
few values inside them. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import settle, stage

FEW_DISTINCT = 500_000
# Size of a quantile sketch; its ranks are off by about 2.3 / SKETCH ** 0.9, so brackets reach SPREAD / SKETCH to either side.
SKETCH = 4096
SPREAD = 12
CELLS = 64


def distinct_sketch(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Approximate distinct values per numeric column, one sketch buffer per column."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    found = long.groupBy("feature").agg(F.approx_count_distinct("value").alias("d")).collect()
    return {r["feature"]: r["d"] for r in found}


def few_distinct(df: DataFrame, cols: Sequence[str], limit: int = FEW_DISTINCT) -> bool:
    """Whether every column's distinct values fit in one aggregation buffer (5 % sketch)."""
    return max(distinct_sketch(df, cols).values(), default=0) <= limit


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    by: Sequence[str] = (),
    limit: int = FEW_DISTINCT,
) -> DataFrame:
    """``(by…, feature, q)`` with ``q`` the array of exact quantiles; NULLs are skipped.

    ``limit`` is the largest number of distinct values one buffer may hold; set it to 0 to
    force the bracketing path.
    """
    numbers = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    if few_distinct(numbers, cols, limit):
        wanted = F.array(*[F.lit(float(q)) for q in qs])
        wide = numbers.groupBy(*by).agg(*[F.percentile(F.col(f"`{c}`"), wanted).alias(c) for c in cols])
        return wide.unpivot(list(by), list(cols), "feature", "q")
    return bracketed_quantiles(numbers, cols, qs, by, limit)


def bracketed_quantiles(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (), limit: int = FEW_DISTINCT, sketch: int = SKETCH
) -> DataFrame:
    """The large-data path of ``quantiles``, in two scans of the rows: sketch, then count.

    The second scan counts what lies below every bracket and writes the distinct values inside with their counts;
    everything after it reads that table. A bracket that a sketch put beside the rank shows in the counts: its group is
    counted again with a wider one, in the end the whole range. Groups of few values, or with NaN (the largest value),
    start with the whole range.
    """
    keys = [*by, "feature"]
    limit = max(limit, 4)
    renamed = [F.col(k).alias(f"_{k}") for k in keys]
    values = df.unpivot(list(by), list(cols), "feature", "value").where(F.col("value").isNotNull()).select(*renamed, "value")
    number = F.when(~F.isnan("value"), F.col("value"))
    groups = stage(
        values.groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(
            F.count("value").alias("n"), F.count(number).alias("numbers"), F.min("value").alias("least"),
            F.max("value").alias("most"), F.kll_sketch_agg_double(number, F.lit(sketch)).alias("sketch"),
        ),
        "sketches",
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    rank = (F.col("n") - 1) * F.col("w.q")
    ranks = groups.drop("sketch").select("*", F.explode(wanted).alias("w")).select(
        *keys, "w.slot", "n", F.floor(rank).alias("low_rank"), (rank - F.floor(rank)).alias("part")
    )
    ranks = ranks.withColumn("high_rank", F.least(F.col("low_rank") + 1, F.col("n") - 1)).drop("n")
    given = [*keys, "slot", "low_rank", "high_rank", "part"]
    counted, todo, spread = None, settle(ranks), SPREAD / sketch
    while not todo.isEmpty():
        tagged = stage(_inside(values, todo, _brackets(groups, keys, qs, spread), keys, given), "inside")
        tally = tagged.groupBy(*given).agg(
            F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("below"), F.sum("c").alias("upto")
        )
        right = (F.col("below") <= F.col("low_rank")) & (F.col("upto") > F.col("high_rank"))
        tally = settle(tally.withColumn("right", right))
        found = _joined(tagged.where(F.col("value").isNotNull()), tally.where("right").drop("upto", "right"), given)
        counted = found if counted is None else counted.unionByName(found)
        # a bracket without any row at all has no tally either
        todo = settle(_joined(todo, tally.where("right").select(*given), given, "left_anti"))
        spread *= 8
    if counted is None:
        empty = values.limit(0)
        return empty.select(*[F.col(f"_{k}").alias(k) for k in keys], F.array("value").alias("q"))
    counted = _few_values(counted, given, limit)
    running = F.col("below") + F.sum("c").over(Window.partitionBy(*given).orderBy("value"))
    low = F.min(F.when(F.col("upto") > F.col("low_rank"), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.col("high_rank"), F.col("value")))
    points = counted.withColumn("upto", running).groupBy(*given).agg(low.alias("low"), high.alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    found = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", value.alias("value")))).alias("q"))
    return found.select(*keys, F.col("q.value").alias("q"))


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined on ``names``, NULL equal to NULL; the columns of ``left``, then the other ones of ``right``."""
    ours = right.withColumnsRenamed({n: f"__{n}" for n in names})
    found = left.join(ours, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], how)
    return found.drop(*[f"__{n}" for n in names])


def _brackets(groups: DataFrame, keys: Sequence[str], qs: Sequence[float], spread: float) -> DataFrame:
    """``(key…, slot, lo, hi)``: values between which the wanted ranks should lie, ``spread`` of all ranks to either side."""
    ends = [min(max(q + side * spread, 0.0), 1.0) for q in qs for side in (-1, 1)]
    whole = (F.col("numbers") < F.col("n")) | (F.col("n") * F.lit(spread) < 4)
    cuts = F.when(~whole, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(e) for e in ends])))
    slots = []
    for i in range(len(qs)):
        lo = F.lit(None) if ends[2 * i] == 0.0 else F.col("cuts")[2 * i]
        hi = F.lit(None) if ends[2 * i + 1] == 1.0 else F.col("cuts")[2 * i + 1]
        slots.append(F.struct(F.lit(i).alias("slot"), F.coalesce(lo, "least").alias("lo"), F.coalesce(hi, "most").alias("hi")))
    return groups.withColumn("cuts", cuts).select(*keys, F.inline(F.array(*slots)))


def _inside(values: DataFrame, todo: DataFrame, brackets: DataFrame, keys: Sequence[str], given: Sequence[str]) -> DataFrame:
    """``(given…, value, c)``: distinct values inside each bracket with counts; NULL stands for all values below it."""
    state = settle(_joined(todo, brackets, [*keys, "slot"]))
    met = values.join(state, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]).where(F.col("value") <= F.col("hi"))
    value = F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value")
    return met.groupBy(*given, value).agg(F.count(F.lit(1)).alias("c"))


def _few_values(counted: DataFrame, given: Sequence[str], limit: int) -> DataFrame:
    """Counted values with those left out that cannot be the answer, until no group has more than ``limit`` of them.

    Each round cuts a group's values into ``CELLS`` cells, counts these exactly and keeps the ones that hold the two
    ranks; ``below`` grows by what was left out under them.
    """
    group = [*given, "below"]
    while True:
        widest = counted.groupBy(*group).agg(F.count("value").alias("d")).agg(F.max("d")).first()[0]
        if (widest or 0) <= limit:
            return counted
        number = F.when(~F.isnan("value"), F.col("value"))
        grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
        sketched = counted.groupBy(*group).agg(F.count(number).alias("m"), F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("sketch"))
        cuts = sketched.select(*group, F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double("sketch", grid)).alias("cuts"))
        cell = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0)).alias("cell")
        placed = _joined(counted, settle(cuts), group).select(*group, "value", "c", cell)
        cells = placed.groupBy(*group, "cell").agg(F.sum("c").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*group).orderBy("cell"))
        near = cells.withColumn("upto", upto).where(F.col("upto") > F.col("low_rank")).where(F.col("upto") - F.col("c") <= F.col("high_rank"))
        kept = near.groupBy(*group).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("upto") - F.col("c")).alias("now"))
        inside = _joined(counted, settle(kept), group).where(F.col("value").between(F.col("lo"), F.col("hi")))
        counted = stage(inside.select(*given, F.col("now").alias("below"), "value", "c"), "inside")


def median_levels(
    df: DataFrame, value: str, levels: Sequence[Sequence[str]], limit: int = FEW_DISTINCT
) -> list[DataFrame]:
    """Medians of ``value`` per level of grouping keys; rows with a NULL key or value do not count.

    With few distinct values all levels come out of one grouping-sets job.
    """
    known = df.select(*dict.fromkeys(k for level in levels for k in level), F.col(value).cast("double").alias(value))
    known = known.where(F.col(value).isNotNull())
    every = list(dict.fromkeys(k for level in levels for k in level))
    if every and few_distinct(known, [value], limit):
        sets = [[F.col(k) for k in level] for level in levels]
        stacked = settle(
            known.groupingSets(sets, *[F.col(k) for k in every]).agg(
                F.percentile(value, F.lit(0.5)).alias("median"), F.grouping_id().alias("level")
            )
        )
        codes = [sum(0 if k in level else 1 << (len(every) - 1 - i) for i, k in enumerate(every)) for level in levels]
        picked = [stacked.where(F.col("level") == code) for code in codes]
    else:
        picked = [
            quantiles(known, [value], [0.5], level, limit).withColumn("median", F.col("q")[0]) for level in levels
        ]
    return [
        t.select(*level, "median").dropna(subset=list(level)) if level else t.select("median")
        for t, level in zip(picked, levels, strict=True)
    ]
