"""Standing in a cohort: percentiles, deciles, z-scores, shrinkage. Generic in keys, cohorts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import clip, rounded
from cohortry.sources.tables import stored


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value): one window then serves all metrics, and spreads a large cohort over them."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def wide_form(df: DataFrame, ids: list[str], metrics: list[str], value: str, suffix: str = "") -> DataFrame:
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m + suffix) for m in metrics])


def group_ranks(df: DataFrame, keys: list[str], value: str, buckets: int = 64) -> DataFrame:
    """df with __rank of value in its group (nulls first, ties share the lowest), and the group's __n rows and
    __nulls and the value's __ties, without one task for a group. df should give the same values whenever it is read.

    Values are counted first. Quantiles cut each group's distinct values into buckets: a window over the
    buckets' sums (groups x buckets rows) and one within each bucket give the rows below each value. The quantiles
    are approximate and differ from one computation to the next, so they are written once for both.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__ties"))
    cuts = F.percentile_approx(F.col("__v").cast("double"), [i / buckets for i in range(1, buckets)], 1000)
    nulls = F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__ties"))), F.lit(0))
    groups = stored(counts.groupBy(*own).agg(cuts.alias("__cuts"), F.sum("__ties").alias("__n"), nulls.alias("__nulls")))  # a row a group
    bucket = F.when(F.col("__v").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda e: e <= F.col("__v"))))
    placed = _join_nulls(counts, groups, own).withColumn("__b", bucket).drop("__cuts")
    sums = placed.groupBy(*own, "__b").agg(F.sum("__ties").alias("__s"))
    earlier = F.sum("__s").over(Window.partitionBy(*own).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*own, "__b", F.coalesce(earlier, F.lit(0)).alias("__o"))
    within = F.sum("__ties").over(Window.partitionBy(*own, "__b").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    ranks = _join_nulls(placed.withColumn("__w", F.coalesce(within, F.lit(0))), offsets, [*own, "__b"])
    ranks = ranks.select(*own, "__v", "__n", "__nulls", "__ties", (F.col("__o") + F.col("__w") + 1).alias("__rank"))
    on = F.col(value).eqNullSafe(F.col("__v"))
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return df.join(ranks, on).drop("__v", *own)


def _join_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which null keys are equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(k).alias(f"__r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return left.join(renamed, on).drop(*[f"__r{k}" for k in keys])


#: Distinct values that one task may put in order, at most, to find a quantile.
SETTLED = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], settled: int = SETTLED, cuts: int = 64) -> DataFrame:
    """keys and q, the exact quantiles of value in each group (nulls out), interpolated between neighbours.

    A distributed selection: values are counted, then each group is cut by approximate quantiles, the rows below
    each cut are summed, and only the stretches that hold a wanted place are cut again, until none has more
    than `settled` distinct values. So a task holds the values of one stretch, never those of a group. Null keys
    are a group; a group without values gives no row.
    """
    own = [f"k{i}" for i in range(len(keys))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("key", F.struct(*own) if own else F.struct(F.lit(0).alias("k")))
    text = F.to_json("key", {"ignoreNullFields": "false"})  # one key that is never null
    live = stored(counts.select("key", text.alias("g"), F.lit(0).alias("stretch"), "v", "c"))
    wanted = live.groupBy("g").agg(F.sum("c").alias("n"), F.first("key").alias("key"))
    places = F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in shares]))
    groups = stored(wanted)
    # (g, stretch, place): place counts from the stretch's first row, at is the place in the group.
    asked = groups.select("g", F.explode(F.array_distinct(places)).alias("at")).select("g", F.lit(0).alias("stretch"), "at", F.col("at").alias("place"))
    while live.groupBy("g", "stretch").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > settled:
        edges = stored(live.groupBy("g", "stretch").agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("edges")))  # once: approximate ones differ
        piece = F.size(F.filter("edges", lambda e: e < F.col("v")))
        pieces = live.join(edges, ["g", "stretch"]).withColumn("piece", piece).drop("edges")
        sums = pieces.groupBy("g", "stretch", "piece").agg(F.sum("c").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("g", "stretch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = asked.join(sums.withColumn("before", before), ["g", "stretch"]).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("rows")))
        asked = stored(here.select("g", (F.col("stretch") * cuts + F.col("piece")).alias("next"), "at", (F.col("place") - F.col("before")).alias("place")).withColumnRenamed("next", "stretch"))
        kept = asked.select("g", "stretch").distinct()
        live = stored(pieces.withColumn("stretch", F.col("stretch") * cuts + F.col("piece")).drop("piece").join(kept, ["g", "stretch"], "left_semi"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("g", "stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = asked.join(live.withColumn("below", below), ["g", "stretch"]).where((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("c")))
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("values"))  # two a share
    joined = groups.join(values, "g")

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.element_at("values", F.floor(place)), F.element_at("values", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return joined.select(*[F.col("key")[o].alias(k) for k, o in zip(keys, own, strict=True)], F.array(*map(quantile, shares)).alias("q"))


_MARKS = ["__rank", "__n", "__nulls", "__ties"]


def cohort_percent_rank(df: DataFrame, cohort: list[str], metrics: list[str], ids: list[str], suffix: str = "_pct", digits: int = 1) -> DataFrame:
    """ids, cohort and the percent rank (0 to 100, nulls lowest) of each metric in its cohort."""
    ranked = group_ranks(long_form(df, [*ids, *cohort], metrics), [*cohort, "metric"], "value")
    p = F.when(F.col("__n") > 1, rounded((F.col("__rank") - 1) / (F.col("__n") - 1) * 100, digits)).otherwise(0.0)
    return wide_form(ranked.withColumn("p", p), [*ids, *cohort], metrics, "p", suffix)


def midrank_percentiles(df: DataFrame, cohort: list[str], metrics: list[str], ids: list[str], suffix: str = "_mid", digits: int = 6) -> DataFrame:
    """Percent of the cohort below the middle of a value's ties; null values get 0 but count in the cohort."""
    ranked = group_ranks(long_form(df, [*ids, *cohort], metrics), [*cohort, "metric"], "value")
    mid = (F.col("__rank") - F.col("__nulls") + (F.col("__ties") - 1) / 2 - 0.5) / F.col("__n") * 100
    p = F.when(F.col("value").isNull(), 0.0).otherwise(rounded(clip(mid, 0.0, 100.0), digits))
    return wide_form(ranked.withColumn("p", p), [*ids, *cohort], metrics, "p", suffix)


def global_percent_rank(df: DataFrame, value: str, out: str, digits: int = 1) -> DataFrame:
    ranked = group_ranks(df, [], value)
    p = F.when(F.col("__n") > 1, rounded((F.col("__rank") - 1) / (F.col("__n") - 1) * 100, digits)).otherwise(0.0)
    return ranked.withColumn(out, p).drop(*_MARKS)


def global_ntile(df: DataFrame, value: str, tie: str, out: str, tiles: int = 10) -> DataFrame:
    """Exact NTILE over all rows ordered by (value nulls first, tie; tie a number): the place of a row is its
    value's rank plus the rank of its tie among equal values. Rows equal in both share the lower tile."""
    ranked = group_ranks(df, [], value).withColumnsRenamed({"__rank": "__low", "__n": "__all"}).drop("__nulls", "__ties")
    ranked = group_ranks(ranked, [value], tie)
    place = F.col("__low") - 1 + F.col("__rank") - 1
    size, extra = F.floor(F.col("__all") / tiles), F.col("__all") % tiles
    big = extra * (size + 1)
    tile = F.when(place < big, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - big) / F.greatest(size, F.lit(1)))) + 1
    return ranked.withColumn(out, tile.cast("long")).drop("__low", "__all", *_MARKS)


def with_group(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with aggregates of each row's group, combined in each task first and joined back: no window holds a group.
    df is read twice; null keys are a group. The aggregates are written once: sums of doubles in another order differ
    in their last digits, and so would rows that are read again and joined by value."""
    return _join_nulls(df, stored(df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])), keys)


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, total: str = "__n") -> DataFrame:
    """df with each row's number (from 1) in its group by an order that leaves no ties, and the group's rows.

    Rows are dealt by ranges of group and order and counted on in each range; a table of a row for each group and
    range says where a range begins. So a group is spread over tasks, however large.
    """
    columns = [F.col(k) for k in keys]
    placed = stored(df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*keys, "__part", "__first", before.alias("__before"), F.sum("__c").over(w).alias(total))
    joined = _join_nulls(placed, offsets, [*keys, "__part"])
    return joined.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__first", "__before")


def cohort_ntile(df: DataFrame, cohort: list[str], order: list[Column], out: str, tiles: int = 10) -> DataFrame:
    """Exact NTILE in the cohort by an order that leaves no ties."""
    df = numbered(df, cohort, order, "__place", "__all")
    place, size, extra = F.col("__place") - 1, F.floor(F.col("__all") / tiles), F.col("__all") % tiles
    big = extra * (size + 1)
    tile = F.when(place < big, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - big) / F.greatest(size, F.lit(1)))) + 1
    return df.withColumn(out, tile.cast("long")).drop("__place", "__all")


def below_percentile(df: DataFrame, cohort: list[str], value: str, out: str) -> DataFrame:
    """df with the percent of the cohort strictly below, nulls lowest."""
    ranked = group_ranks(df, cohort, value)
    return ranked.withColumn(out, rounded((F.col("__rank") - 1) / F.col("__n") * 100, 0)).drop(*_MARKS)


def z_score(df: DataFrame, cohort: list[str], value: str, out: str) -> DataFrame:
    """With the population's deviation; 0 deviation counts as 1."""
    df = with_group(df, cohort, {"__mean": F.avg(value), "__deviation": F.stddev_pop(value)})
    spread = F.when(F.col("__deviation") == 0, 1.0).otherwise(F.col("__deviation"))
    return df.withColumn(out, (F.col(value) - F.col("__mean")) / spread).drop("__mean", "__deviation")


def shrunk(df: DataFrame, values: list[str], exposure: str, cohort: list[str], low: float, high: float, suffix: str = "") -> DataFrame:
    """values drawn toward the cohort's mean, in full at exposure `low`, not at all from `high` on."""
    w = clip((F.col(exposure) - low) / (high - low), 0.0, 1.0)
    df = with_group(df, cohort, {f"__m_{v}": F.avg(v) for v in values})
    return df.withColumns({v + suffix: F.col(v) * w + F.col(f"__m_{v}") * (1 - w) for v in values}).drop(*[f"__m_{v}" for v in values])


def confidence(n: Column, full: int = 10) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), n / F.lit(float(full)))).otherwise(0.0)


def rolling_mean(value: str, keys: list[str], order: list[str], window: int = 5) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most k rows a key, ranked from 1; Spark limits each task's rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """De-duplication by keys in which the first row by an explicit order stays."""
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def modal(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The most frequent non-null value of each key, the smallest in a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(out))


def vector_similarity(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """(cosine, 0 for a zero vector; Euclidean distance) of two lists of columns."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    na, nb = (F.sqrt(sum((x * x for x in v), F.lit(0.0))) for v in (a, b))
    distance = F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    return F.coalesce(dot / F.nullif(na * nb, F.lit(0.0)), F.lit(0.0)), distance
