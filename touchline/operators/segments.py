"""What both sides did before and after each tactical substitution of the side that trails after an hour.

All measures are summed by minute first, then by the boundary that a minute lies at or after. Running sums over a match's boundaries then
give every window as a difference between two of them, so no event meets a segment, however many substitutions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Metres of a yard: lengths and their bounds are divided by it, as the source of these measures does.
YARD = 0.9144
WON = ("Won", "Success", "Success in Play", "Success Out")
MISSED = ("Off T", "Wayward")
LENGTHS = {"0_5": (None, 5), "5_10": (5, 10), "10_20": (10, 20), "20_40": (20, 40), "40": (40, None)}


def measures() -> dict[str, Column]:
    """The measures of an event, each a number to be summed."""
    c = F.col
    one = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    there = lambda name: one(c(name).isNotNull())
    passed = c("pass_length").isNotNull() & c("pass_outcome").isNull()
    length = lambda low, high: F.when(
        passed & (F.lit(True) if low is None else c("pass_length") > low / YARD) & (F.lit(True) if high is None else c("pass_length") <= high / YARD), c("pass_length") / YARD
    ).otherwise(0.0)
    return {
        "clearances_total": there("clearance_body_part"),
        "dribble_total": there("dribble_outcome"), "dribble_success": one(c("dribble_outcome") == "Complete"),
        "duel_total": there("duel_outcome"), "duel_success": one(c("duel_outcome").isin(*WON)),
        "fouls_committed": there("foul_committed_type"),
        "interceptions_total": there("interception_outcome"), "interceptions_success": one(c("interception_outcome").isin(*WON)),
        "pass_shot_assist": there("pass_shot_assist"), "pass_goal_assist": there("pass_goal_assist"),
        "pass_success_length__total": length(None, None), **{f"pass_success_length__{k}": length(*v) for k, v in LENGTHS.items()},
        "passes_total": there("pass_length"), "passes_success": one(passed),
        "shots_total": there("shot_outcome"), "shots_target": one(~c("shot_outcome").isin(*MISSED)), "goals_scored": one(c("shot_outcome") == "Goal"),
        "substitution_tactical": one(c("substitution_outcome") == "Tactical"),
    }


def around_substitutions(events: DataFrame, hour: int = 60, published_duels: bool = True) -> DataFrame:
    """Rows (match_id, substitution_minute, minutes_after, off, score60_off, score60_def, <measure>__<off|def>__<pre|post>, ...).

    `off` is the side that has scored fewer goals before minute `hour`; level matches drop out. Boundaries are the minutes of its tactical
    substitutions from then on and before the match's last minute; without any the minute before the hour. The window before is all of the
    match up to the boundary, the one after ends with the next boundary or the last minute; boundaries belong to neither. With
    `published_duels` duel_total after a boundary repeats the number before it, as in the definition these measures come from.
    """
    c, names, first = F.col, list(measures()), hour - 1
    # No boundary lies before the minute before the hour: earlier and unknown minutes are one row of a side, which stands before all others.
    at = F.when(c("minute") >= first, c("minute")).otherwise(first - 1).alias("at")
    early = F.when(c("minute") < hour, measures()["goals_scored"]).otherwise(0.0)
    by = events.where("match_id is not null").groupBy("match_id", "side", at).agg(*[F.sum(m).alias(n) for n, m in measures().items()], F.sum(early).alias("early"), F.max("minute").alias("last"))
    by = by.repartition("match_id").sortWithinPartitions("match_id", "at")  # for all windows
    match = Window.partitionBy("match_id")
    late = (c("substitution_tactical") > 0) & (c("at") >= hour)
    of = lambda side, x: F.when(c("side") == side, x)
    by = by.withColumns(
        {
            **{f"g{k}": F.sum(of(k, c("early")).otherwise(0.0)).over(match).cast("long") for k in (0, 1)},
            **{f"any{k}": F.max(of(k, late).otherwise(False)).over(match) for k in (0, 1)}, "last": F.max("last").over(match),
        }
    ).where("g0 <> g1")
    by = by.withColumn("off", F.when(c("g0") < c("g1"), 0).otherwise(1))
    # The boundary that a row lies at or after; the row of the last minute comes along without its sums, as the end of the last window.
    passed = F.max(F.when((c("side") == c("off")) & late & (c("at") < c("last")), c("at"))).over(match.orderBy("at"))
    opening = F.when((c("at") >= first) & (c("last") > first), F.lit(first))
    by = by.withColumn("boundary", F.when(F.when(c("off") == 0, c("any0")).otherwise(c("any1")), passed).otherwise(opening))
    roles = {"off": c("side") == c("off"), "def": c("side") == 1 - c("off")}
    flags = {"open": c("at") < c("last"), "here": c("at") == c("boundary")}
    by = by.withColumns({f"{role}_{k}": F.coalesce(who & when, F.lit(False)) for role, who in roles.items() for k, when in flags.items()})
    total = lambda flag, n: F.sum(F.when(c(flag), c(n)).otherwise(0.0))
    rows = by.groupBy("match_id", "boundary").agg(
        *[F.first(x).alias(x) for x in ("off", "last")], F.first(F.least("g0", "g1")).alias("score60_off"), F.first(F.greatest("g0", "g1")).alias("score60_def"),
        *[total(f"{role}_open", n).alias(f"t_{n}__{role}") for n in names for role in roles],
        *[total(f"{role}_here", n).alias(f"o_{n}__{role}") for n in names for role in roles],
    )
    # Running sums over a match's boundaries: all before one, and from there up to the next.
    w = match.orderBy("boundary")
    sums = {f"b_{x}": F.coalesce(F.sum(f"t_{x}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) for x in (f"{n}__{role}" for n in names for role in roles)}
    rows = rows.withColumns({"next": F.coalesce(F.lead("boundary").over(w), "last"), **sums}).where("boundary is not null")

    def windows(n: str, role: str) -> list[Column]:
        x = f"{n}__{role}"
        pre, post = c(f"b_{x}"), c(f"b_{x}") + c(f"t_{x}") - (c(f"b_{x}") + c(f"o_{x}"))
        return [pre.alias(f"{x}__pre"), (pre if published_duels and n == "duel_total" else post).alias(f"{x}__post")]

    return rows.select(
        "match_id", c("boundary").alias("substitution_minute"), (c("next") - c("boundary")).alias("minutes_after"), "off", "score60_off", "score60_def",
        *[x for n in names for role in roles for x in windows(n, role)],
    )


RATES = {"passes": "passes_total", "shots": "shots_total", "goals": "goals_scored"}
SKILLS = {"shots_target": "shots_total", "duel_success": "duel_total", "interceptions_success": "interceptions_total", "dribble_success": "dribble_total"}


def per_minute(rows: DataFrame) -> DataFrame:
    """Passes, shots and goals a minute of both sides, how they changed for the trailing side, and the sides' differences before."""
    out = {}
    for name, total in RATES.items():
        for role in ("off", "def"):
            for part, length in (("pre", "substitution_minute"), ("post", "minutes_after")):
                out[f"{name}_perMin__{role}__{part}"] = F.try_divide(F.col(f"{total}__{role}__{part}"), F.col(length).cast("double"))
        out[f"strength_diff__{name}"] = F.col(f"{total}__off__pre") - F.col(f"{total}__def__pre")
    rows = rows.withColumns(out)
    return rows.withColumns({f"{n}_perMin__off__DIFF": F.col(f"{n}_perMin__off__post") - F.col(f"{n}_perMin__off__pre") for n in RATES})


def strengths(rows: DataFrame, weight: float = 0.2) -> DataFrame:
    """A side's strength before and after: a fifth of each of five success rates (of passes by their length), null if one is undefined; and
    the difference of the sides."""
    out = {}
    for part in ("pre", "post"):
        for role in ("off", "def"):
            at = lambda n: F.col(f"{n}__{role}__{part}")  # noqa: E731, B023
            lengths = [at(f"pass_success_length__{k}") for k in LENGTHS]
            rates = [F.try_divide(sum(lengths[1:], lengths[0]), at("pass_success_length__total")), *[F.try_divide(at(a), at(b)) for a, b in SKILLS.items()]]
            out[f"strength__{role}__{part}"] = sum((weight * r for r in rates[1:]), weight * rates[0])
    rows = rows.withColumns(out)
    return rows.withColumns({f"strength_diff__{p}": F.col(f"strength__off__{p}") - F.col(f"strength__def__{p}") for p in ("pre", "post")})
