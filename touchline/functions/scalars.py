"""Scalar column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def parse_match_id(match: Column) -> dict[str, Column]:
    """'PL-S2425_GD7_G3' or 'PL-S2425_GD7-2_G3' -> league, season, gameday, number; malformed parts give null."""
    head = F.split(F.element_at(F.split(match, "_"), 1), "-S")
    day, game = (F.get(F.split(match, "_"), F.lit(i)) for i in (1, 2))
    return {
        "league": F.get(head, F.lit(0)),
        "season": F.get(head, F.lit(1)),
        "gameday": F.split(F.substring(day, 3, 20), "-")[0].try_cast("double").cast("int"),
        "number": F.substring(game, 2, 20).try_cast("int"),
    }


def season_label(season: Column) -> Column:
    """2425 or '2425' -> '2024/25'; '708' is filled up to '0708'."""
    s = F.lpad(season.cast("string"), 4, "0")
    return F.concat(F.lit("20"), F.substring(s, 1, 2), F.lit("/"), F.substring(s, 3, 2))


def season_code(label: Column) -> Column:
    """'2024/25' -> '2425'."""
    return F.concat(F.substring(label, 3, 2), F.substring(label, 6, 2))


def normalised_id(match: Column) -> Column:
    """'_GD7.0_' -> '_GD7_'."""
    return F.regexp_replace(match, r"_GD(\d+)\.0_", "_GD$1_")


def split_day(match: Column) -> Column:
    """Whether the match day carries a dash suffix (a day played in parts)."""
    return match.rlike("GD[0-9]+-")


def title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def log_guard(x: Column) -> Column:
    """Natural logarithm, 0 for numbers that have none."""
    return F.when(x <= 0, 0.0).otherwise(F.ln(F.when(x > 0, x)))


def outcome(home: Column, away: Column) -> Column:
    """2 home win, 1 draw, 0 away win; without a score 1."""
    return F.when(home > away, 2).when(home < away, 0).otherwise(1)


def finite_or_zero(a: Column, b: Column) -> Column:
    """a / b with null and undefined results as 0, the average of a standardised feature."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def softmax(xs: Column) -> Column:
    """Probabilities from an array of scores."""
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def multiplied(value: Column, team: Column, lists: list[tuple[list, float]]) -> Column:
    """Apply each list's multiplier to its members, one list after the other; a member of two lists is multiplied twice."""
    return reduce(lambda v, m: v * F.when(team.isin(m[0]), m[1]).otherwise(1.0), lists, value)


def decay(day: Column, last: Column, half_life_years: float) -> Column:
    """Weight 0.5^(age in years / half-life)."""
    return F.pow(F.lit(0.5), F.datediff(last, day) / 365.25 / half_life_years)


def implied(h: Column, d: Column, a: Column) -> Column:
    """Decimal odds -> probabilities [away, draw, home] without the margin."""
    inverse = [1 / x for x in (a, d, h)]
    total = inverse[0] + inverse[1] + inverse[2]
    return F.array(*[x / total for x in inverse])


def overround(h: Column, d: Column, a: Column) -> Column:
    return 1 / h + 1 / d + 1 / a


def renormalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda x, y: x + y)
    return F.transform(p, lambda x: x / total)


def argmax(p: Column) -> Column:
    """Position from 0 of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def side_of_pitch(left: Column, centre: Column, right: Column) -> Column:
    """A player's usual side from the shares of appearances: above 0.66 left, above 0.33 centre, else right; null without any."""
    total = left + centre + right
    at = F.try_divide(left + 0.5 * centre, total)
    return F.when(at > 0.66, "left").when(at > 0.33, "centre").when(at.isNotNull(), "right")
