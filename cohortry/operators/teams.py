"""Teams as sums of their members: concentration, shares, bottlenecks, fragility, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import rounded
from cohortry.operators.cohort import with_group

HHI_LIMIT, GAP = 2500.0, 20.0


def long_scores(df: DataFrame, ids: list[str], scores: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(ids, scores, "capability", "score")


def concentration(tall: DataFrame, team: list[str]) -> DataFrame:
    """Herfindahl index and flag of each capability in each team, over positive scores."""
    s = F.when(F.col("score") > 0, F.col("score"))
    total = F.sum(s)
    hhi = F.coalesce(rounded(F.lit(1e4) * F.sum(s * s) / (total * total), 4), F.lit(0.0))
    return tall.groupBy(*team, "capability").agg(hhi.alias("hhi")).withColumn("over_centralised", F.col("hhi") > HHI_LIMIT)


def shares(tall: DataFrame, team: list[str], member: str, k: int = 3) -> DataFrame:
    """The k members with the largest shares of each capability of a team."""
    w = Window.partitionBy(*team, "capability")
    share = rounded(F.coalesce(F.col("score") * 100.0 / F.nullif(F.sum("score").over(w), F.lit(0.0)), F.lit(0.0)), 4)
    ranked = tall.withColumn("share", share).withColumn("rank", F.row_number().over(w.orderBy(F.desc("share"), member)).cast("long"))
    return ranked.where(F.col("rank") <= k).select(*team, "capability", member, "share", "rank")


def bottlenecks(means: DataFrame, team: list[str], rules: list[tuple[str, str]], gap: float = GAP) -> DataFrame:
    """A row for each rule (upstream, downstream) whose scores differ by more than gap."""
    found = [F.when(F.col(u) - F.col(v) > gap, F.struct(F.lit(u).alias("upstream"), F.lit(v).alias("downstream"), rounded(F.col(u) - F.col(v), 1).alias("severity"))) for u, v in rules]
    return means.select(*team, F.explode(F.array_compact(F.array(*found))).alias("b")).select(*team, "b.*")


def fragility(df: DataFrame, member: str, team: list[str], position: str, scores: list[str], floor: float = 0.1) -> DataFrame:
    """What a team loses without a member and cannot restore with the best other of the same position.

    The loss of a capability is the fall of its mean over the others. A replacement c restores the sum of
    (c_k - mean_k) / n over the capabilities that fall, so only the sum of c's scores over that set
    matters: for each position and each of the 2^k sets the two best members are kept, and a member
    meets its own set by an equi-join. Teams of fewer than two give no rows.
    """
    df = df.select(member, *team, position, *scores)
    df = with_group(df, team, {"__n": F.count("*")} | {f"__s_{s}": F.sum(s) for s in scores}).where("__n >= 2")
    rest = {f"__r_{s}": (F.col(f"__s_{s}") - F.col(s)) / (F.col("__n") - 1) for s in scores}
    df = df.withColumns(rest).withColumns({f"__l_{s}": F.col(f"__s_{s}") / F.col("__n") - F.col(f"__r_{s}") for s in scores})
    falls = {s: rounded(F.col(f"__l_{s}"), 9) > 0 for s in scores}  # rounded: sums in another order don't fall
    mask = sum((F.when(falls[s], 1 << i).otherwise(0) for i, s in enumerate(scores)), F.lit(0))
    lost = sum((F.greatest(F.col(f"__l_{s}"), F.lit(0.0)) for s in scores), F.lit(0.0))
    base = sum((F.when(falls[s], F.col(f"__r_{s}")).otherwise(0.0) for s in scores), F.lit(0.0))
    focal = df.select(member, *team, position, mask.cast("int").alias("mask"), lost.alias("lost"), base.alias("base"), F.col("__n").alias("n"))

    two = _two_best(df.select(F.col(member).alias("c"), position, *scores), position, scores)
    top = two.groupBy(position, "mask").agg(*[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("c", "v")])
    j = focal.join(top, [position, "mask"], "left")
    own = F.col("c1") == F.col(member)
    value = F.when(own, F.col("v2")).otherwise(F.col("v1"))
    # One spot of n is filled again: n - 1 others and the replacement.
    restored = F.greatest(F.lit(0.0), F.coalesce((value - F.col("base")) / F.col("n"), F.lit(0.0)))
    deficit = F.col("lost") - restored
    deficit = F.when(rounded(deficit, 4) <= 0, floor).otherwise(deficit)
    return j.select(
        *team, member, F.when(own, F.col("c2")).otherwise(F.col("c1")).alias("replacement"), rounded(F.col("lost"), 4).alias("loss"),
        rounded(deficit, 4).alias("deficit"), rounded(F.lit(100.0) / deficit, 2).alias("replaceability"),
    )


def _two_best(pool: DataFrame, position: str, scores: list[str], parts: int = 16) -> DataFrame:
    """(position, mask, c, v, r): the two members c of each position with the largest sums v of each set of scores, ties by c.

    The sums of all members for all sets are not dealt or sorted: a first pass keeps the largest of each of some parts
    of the members, and the second largest of these bounds the two best from below, so that a second pass lets
    few others through.
    """
    sets = F.explode(F.array(*[F.lit(m) for m in range(2 ** len(scores))])).alias("mask")
    value = sum((F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col(s)).otherwise(0.0) for i, s in enumerate(scores)), F.lit(0.0))
    sums = pool.select("c", position, *scores, sets).select("c", position, "mask", value.alias("v"))
    most = sums.groupBy(position, "mask", F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part")).agg(F.max("v").alias("v"))
    largest = F.sort_array(F.collect_list("v"), asc=False)  # of the parts
    bounds = most.groupBy(position, "mask").agg(F.get(largest, F.lit(1)).alias("bound"))
    let = sums.join(F.broadcast(bounds), [position, "mask"]).where(F.col("bound").isNull() | (F.col("v") >= F.col("bound")))  # positions x sets
    best = Window.partitionBy(position, "mask").orderBy(F.desc("v"), "c")
    return let.withColumn("r", F.row_number().over(best)).where("r <= 2").select(position, "mask", "c", "v", "r")


def best_styles(means: DataFrame, team: list[str], scores: list[str], styles: dict[str, dict[str, float]]) -> DataFrame:
    """Primary and secondary style by the cosine of the team's z-vector (columns z_<score>) with each style."""
    sims = []
    for name, v in styles.items():
        dot = sum((F.col(f"z_{s}") * float(v[s]) for s in scores), F.lit(0.0))
        na = F.sqrt(sum((F.col(f"z_{s}") * F.col(f"z_{s}") for s in scores), F.lit(0.0)))
        nb = sum(x * x for x in v.values()) ** 0.5
        sims.append(F.struct(rounded(F.coalesce(dot / F.nullif(na * nb, F.lit(0.0)), F.lit(0.0)), 6).alias("similarity"), F.lit(name).alias("style")))
    ranked = F.array_sort(F.array(*sims), lambda a, b: F.when(a["similarity"] > b["similarity"], -1).when(a["similarity"] < b["similarity"], 1).when(a["style"] < b["style"], -1).otherwise(1))
    one, two = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return means.select(
        *team, F.when(one["similarity"] > 0.6, one["style"]).otherwise("Balanced").alias("primary_style"), one["similarity"].alias("similarity"),
        F.when(two["similarity"] > 0.75, two["style"]).alias("secondary_style"),
    )


def leave_one_out(score: str, team: list[str]) -> Column:
    """The team's mean without the row; null for a team of one."""
    w = Window.partitionBy(*team)
    return (F.sum(score).over(w) - F.col(score)) / F.nullif((F.count("*").over(w) - 1).cast("double"), F.lit(0.0))


def with_added(team_sum: Column, team_n: Column, score: Column) -> Column:
    return (team_sum + score) / (team_n + 1)


def listed(scores: list[str], keep, order: list[str] | None = None, k: int | None = None) -> Column:
    """The names of the scores for which keep(score column) holds, from the highest score down (or by the
    columns `order`, one a score), the first k at most, as text."""
    order = order or [f"-{s}" for s in scores]
    hits = F.array_compact(F.array(*[F.when(keep(F.col(s)), F.struct(F.expr(o).cast("double").alias("o"), F.lit(s).alias("s"))) for s, o in zip(scores, order, strict=True)]))
    names = F.transform(F.array_sort(hits), lambda x: x["s"])
    return F.array_join(names if k is None else F.slice(names, 1, k), ",")


def emergent_traits(scores: list[str], least: float = 80.0) -> Column:
    """"Elite <Name>" for each mean score above least (M5)."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(s) > least, f"Elite {s.replace('_', ' ').title()}") for s in scores])), ",")
