"""Column expressions: null-safe rates, labels, ids, curves. All stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 0) -> Column:
    """Half-up rounding of the binary value, the same in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)


def ratio(x: Column, y: Column) -> Column:
    """x / y as a double, null where y is 0."""
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def pct(x: Column, y: Column, digits: int = 1) -> Column:
    """Share of x in y in percent."""
    return rounded(ratio(x * F.lit(100.0), y), digits)


def rate(x: Column, exposure: Column, per: float = 90.0, digits: int = 3) -> Column:
    """x per `per` units of exposure."""
    return rounded(ratio(x * F.lit(per), exposure), digits)


def difference(x: Column, y: Column, digits: int = 3) -> Column:
    """x - y with nulls as 0."""
    return rounded(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), digits)


def possession_factor(possession_pct: Column) -> Column:
    """Between 0 and 2, 1 at 50 %: what a count is multiplied by to allow for possession."""
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-0.1) * (possession_pct - F.lit(50.0))))


def clip(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def weighted(terms: dict[str, float], digits: int | None = None) -> Column:
    """Sum of column times weight; null if a column is null."""
    total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in terms.items()])
    return total if digits is None else rounded(total, digits)


def bands(x: Column, cuts: list[tuple[float, str]], below: str | None = None) -> Column:
    """The label of the first cut that x reaches; cuts from high to low."""
    out = None
    for least, label in cuts:
        out = F.when(x >= least, label) if out is None else out.when(x >= least, label)
    return out.when(x.isNotNull(), below)


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear curve through the knots, flat beyond them."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), F.lit(knots[-1][1]))


#: Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    u = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = t * (F.lit(a) + poly)
    erf = F.lit(1.0) - poly * F.exp(-u * u)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2).otherwise((F.lit(1.0) - erf) / 2)


def result_label(home: Column, away: Column, labels: tuple[str, str, str]) -> Column:
    """labels for home > away, home < away, and otherwise."""
    return F.when(home > away, labels[0]).when(home < away, labels[1]).otherwise(labels[2])


def short_id(*parts: Column, length: int = 16, sep: str = ":") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *parts).cast("binary"), 256), 1, length)


def title(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def entity_key(*parts: Column) -> Column:
    return F.lower(F.replace(F.concat_ws("__", *parts), F.lit(" "), F.lit("_")))


def age_years(birth_date: Column, as_of: Column) -> Column:
    """Age at a date that the caller gives."""
    return rounded(F.datediff(as_of, birth_date) / F.lit(365.25), 1)


#: Letters that accent folding turns to plain ones.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded_name(x: Column) -> Column:
    """Lower case, accents folded, other characters than letters, digits and blanks dropped, blanks collapsed."""
    plain = F.translate(F.lower(x), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", ""), " +", " "))


#: Parts of position names and their groups, in the order they are tried.
POSITION_GROUPS = [
    (("goalkeeper",), "Goalkeeper"),
    (("center back",), "Center Back"),
    (("back",), "Fullback"),
    (("defensive midfield",), "Defensive Midfielder"),
    (("attacking midfield",), "Attacking Midfielder"),
    (("midfield",), "Central Midfielder"),
    (("wing",), "Winger"),
    (("forward", "striker"), "Center Forward"),
]


def position_group(name: Column) -> Column:
    low, out = F.lower(name), None
    for parts, group in POSITION_GROUPS:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("Unknown")
