"""Exact quantiles without a task that holds a group.

``F.percentile`` keeps every distinct value of a group in one reducer, so only little input takes it. Otherwise each wanted
rank is narrowed down: rows are counted into bins between the least and the greatest value (a hash aggregate of a fixed
number of cells), the bin of a rank becomes the next interval, and when few rows are left between the ends, they are counted
by value. Each round is one pass over the rows and leaves one row a group and rank. Both forms give the same numbers,
linearly interpolated between neighbouring ranks. Null values don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.session import cut

#: Values (rows times columns) up to which reducers may hold all distinct ones; groups of a 128th of it always fit, as a
#: reducer holds at most 128 groups before it sorts.
MOST = 1 << 21
BINS = 1 << 12
#: Rows of a bin that are counted by value instead of binned once more, and rounds of bins at most.
FEW, ROUNDS = 1 << 16, 4
#: Groups up to which one row a group is broadcast.
BROADCAST_GROUPS = 1 << 16


def quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], probs: list[float], most: int = MOST, accuracy: int = BINS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One row per group: by, n_rows, and of each column an array of its quantiles (null without values).

    ``accuracy`` is the number of bins of a round. ``sizes``, where known, spares the count: the most rows of a group, and of all.
    """
    sizes = sizes or df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[1] or 0) * len(columns) <= most or sizes[0] * len(columns) <= most >> 7:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.percentile(c, probs).alias(k) for k, c in columns.items()])
    return _narrowed(df, by, columns, probs, max(4, accuracy))


def small(df: DataFrame, groups: int) -> DataFrame:
    """A table of one row a group, for a broadcast where there are few."""
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of a value within [lo, hi]; both ends have one of their own, so that every round gets on."""
    width = hi - lo
    inner = F.when((width > 0) & (width < float("inf")), F.least(F.floor((x - lo) / F.when(width > 0, width).otherwise(1.0) * (bins - 2)).cast("int"), F.lit(bins - 3)) + 1)
    return F.when(x <= lo, 0).when(x >= hi, bins - 1).otherwise(F.coalesce(inner, F.lit(1)))


def _narrowed(df: DataFrame, by: list[str], columns: dict[str, Column], probs: list[float], bins: int) -> DataFrame:
    keys, names, per = [f"_by{k}" for k in range(len(by))], list(columns), len(probs)
    values = [f"_v{k}" for k in range(len(names))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[c.cast("double").alias(v) for c, v in zip(columns.values(), values)])
    cells = [(k, j) for k in range(len(names)) for j in range(per)]

    # One row a group: a number for it, its rows, and of each column the number of values and their ends.
    ends = [f(v).alias(f"{n}{v}") for v in values for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    edges = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *ends).withColumn("_group", F.monotonically_increasing_id()))
    groups = edges.count()
    cell = lambda k, j: F.struct(F.lit(k * per + j).alias("cell"), F.lit(k * per).alias("owner"), F.lit(float(probs[j])).alias("p"), *[F.col(f"{n}{values[k]}").alias(n) for n in ("n", "lo", "hi")])
    state = edges.select("_group", F.explode(F.array(*[cell(k, j) for k, j in cells])).alias("s")).select("_group", "s.*").where("n > 0")
    rank, one = F.col("p") * (F.col("n") - 1), F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    state = state.select("_group", "cell", "owner", "lo", "hi", F.lit(0).cast("long").alias("before"), F.floor(rank).alias("f"), F.ceil(rank).alias("c"), (rank - F.floor(rank)).alias("w"), one.alias("a"), one.alias("b"), F.col("n").alias("m"))

    todo = F.col("a").isNull() | F.col("b").isNull()
    for k in range(ROUNDS + 1):
        # At most as many rows as there are columns and ranks.
        left = state.where(todo).groupBy("owner").agg(F.max("m").alias("m")).collect()
        if not left:
            break
        few = k == ROUNDS or max(r.m for r in left) <= FEW
        state = cut(_round(rows, edges.select(*keys, "_group"), state, keys, values, per, groups, 0 if few else bins, sorted(r.owner for r in left), todo))

    value = F.when(F.col("w") == 0, F.col("a")).otherwise(F.col("a") + F.col("w") * (F.col("b") - F.col("a")))
    wide = state.groupBy("_group").agg(*[F.max(F.when(F.col("cell") == k * per + j, value)).alias(f"_q{k}_{j}") for k, j in cells])
    out = [F.when(F.col(f"n{values[k]}") > 0, F.array(*[F.col(f"_q{k}_{j}") for j in range(per)])).alias(name) for k, name in enumerate(names)]
    return edges.join(wide, "_group", "left").select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n_rows", *out)


def _round(rows: DataFrame, number: DataFrame, state: DataFrame, keys: list[str], values: list[str], per: int, groups: int, bins: int, owners: list[int], todo: Column) -> DataFrame:
    """The state after one more pass: intervals of ranks are those of the bins (of the values, without bins) that they fell into.

    state: a row a group and cell (column and rank); ``owner`` is the first cell of the same interval, and ``owners`` are all
    that are left. a and b are the values at the ranks around the wanted one, as far as they are known; m values lie in the
    interval, before of them below it.
    """
    end = lambda c, e: F.max(F.when((F.col("owner") == c) & todo, F.col(e))).alias(f"{e}{c}")
    wide = number.join(state.groupBy("_group").agg(*[end(c, e) for c in owners for e in ("lo", "hi")]), "_group").select("*", *[F.col(k).alias(f"{k}t") for k in keys]).drop(*keys)
    same = reduce(lambda s, k: s & F.col(k).eqNullSafe(F.col(f"{k}t")), keys, F.lit(True))
    met = rows.join(small(wide, groups), same)

    def hit(k: int) -> Column:
        """The interval that holds the k-th value; null without one."""
        x, out = F.col(values[k]), F
        for c in owners:
            if c // per == k:
                lo, hi = F.col(f"lo{c}"), F.col(f"hi{c}")
                out = out.when((x >= lo) & (x <= hi), F.struct(F.lit(c).alias("owner"), lo.alias("lo"), hi.alias("hi"), x.alias("x")))
        return out

    live = sorted({c // per for c in owners})
    hits = met.select("_group", (F.explode(F.array(*[hit(k) for k in live])) if len(live) > 1 else hit(live[0])).alias("s")).where("s is not null").select("_group", "s.*")
    if bins:
        binned = hits.select("_group", "owner", "x", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        counts = binned.groupBy("_group", "owner", "bin").agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    else:
        counts = hits.groupBy("_group", "owner", "x").agg(F.count(F.lit(1)).alias("m")).select("_group", "owner", "m", F.col("x").alias("lo"), F.col("x").alias("hi"))
    counts = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("_group", "owner").orderBy("lo")))

    t = counts.select(F.col("_group").alias("_g"), F.col("owner").alias("_o"), F.col("m").alias("_m"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "upto")
    j = state.join(t, (F.col("_group") == F.col("_g")) & (F.col("owner") == F.col("_o")) & todo, "left")
    top = F.col("before") + F.col("upto")
    within = lambda r: (F.col(r) < top) & (F.col(r) >= top - F.col("_m"))
    at = lambda r, v: F.max(F.when(within(r), v))
    got = j.groupBy("_group", "cell", "owner", "lo", "hi", "before", "f", "c", "w", "a", "b", "m").agg(
        *[at(r, F.col(v)).alias(f"{r}{v}") for r in ("f", "c") for v in ("_lo", "_hi", "_m")], *[at(r, top - F.col("_m")).alias(f"{r}_under") for r in ("f", "c")]
    )

    def found(old: str, r: str) -> Column:
        lo, hi, m, under = (F.col(f"{r}{v}") for v in ("_lo", "_hi", "_m", "_under"))
        return F.coalesce(F.col(old), F.when((lo == hi) | (F.col(r) == under), lo).when(F.col(r) == under + m - 1, hi))

    new = got.select(
        "_group", "cell", *[F.coalesce(f"f_{e}", e).alias(e) for e in ("lo", "hi")], F.coalesce("f_under", "before").alias("before"), "f", "c", "w", found("a", "f").alias("a"), found("b", "c").alias("b"), F.coalesce("f_m", "m").alias("m")
    )
    # Cells of one column that fell into the same bin share an owner.
    return new.withColumn("owner", F.min("cell").over(Window.partitionBy("_group", F.floor(F.col("cell") / per), "before", F.when(todo, 1))))
