"""Windows around substitutions on hand-made matches; whole tables are held against SQL in test_queries."""

import pytest

from touchline.operators import segments

COLUMNS = "match_id long, side int, minute int, pass_length double, pass_outcome string, pass_shot_assist boolean, pass_goal_assist boolean, shot_outcome string, duel_outcome string, interception_outcome string, dribble_outcome string, clearance_body_part string, foul_committed_type string, substitution_outcome string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def events(spark, rows):
    return spark.createDataFrame([tuple({"match_id": m, "side": s, "minute": t, **x}.get(n) for n in NAMES) for m, s, t, x in rows], COLUMNS)


GOAL, SUB = {"shot_outcome": "Goal"}, {"substitution_outcome": "Tactical"}


def test_boundaries(spark):
    ahead = lambda m: [(m, 0, 10, GOAL), (m, 1, 90, {"shot_outcome": "Saved"})]
    rows = ahead(1) + [(1, 1, t, SUB) for t in (60, 70, 70, 90)] + [(1, 1, 30, SUB), (1, 0, 65, SUB)]
    rows += ahead(2)  # no substitution: the minute before the hour
    rows += [(3, 0, 10, GOAL), (3, 1, 59, GOAL), (3, 1, 70, SUB)]  # level after an hour
    rows += [(4, 0, 60, GOAL), (4, 1, 70, SUB)]  # the goal came in minute 60
    rows += ahead(5) + [(5, 1, 90, SUB)]  # only in the last minute
    rows += [(1, 1, 69, {"duel_outcome": "Won"}), (1, 1, 71, {"duel_outcome": "Lost"}), (1, 0, 70, {"shot_outcome": "Wayward"}), (1, 0, 60, {"clearance_body_part": "Head"})]
    got = {(r.match_id, r.substitution_minute): r.asDict() for r in segments.around_substitutions(events(spark, rows)).collect()}
    assert sorted(got) == [(1, 60), (1, 70), (2, 59)]
    a, b, c = got[1, 60], got[1, 70], got[2, 59]
    assert (a["minutes_after"], b["minutes_after"], c["minutes_after"]) == (10, 20, 31)
    assert (a["off"], a["score60_off"], a["score60_def"]) == (1, 0, 1)
    assert a["substitution_tactical__off__pre"] == 1 and b["substitution_tactical__off__pre"] == 2 and b["substitution_tactical__off__post"] == 0
    assert a["duel_success__off__post"] == 1 and b["duel_total__off__pre"] == b["duel_total__off__post"] == 1 and b["duel_success__off__post"] == 0
    assert a["shots_total__def__post"] == b["shots_total__def__post"] == 0 and b["clearances_total__def__pre"] == 1 and a["clearances_total__def__pre"] == 0
    own = {r.substitution_minute: r for r in segments.around_substitutions(events(spark, rows), published_duels=False).where("match_id = 1").collect()}
    assert own[70]["duel_total__off__post"] == 1 and own[60]["duel_total__off__post"] == 1
    assert segments.around_substitutions(events(spark, [])).collect() == []


def test_rates_and_strengths(spark):
    skills = [{"duel_outcome": "Won"}, {"duel_outcome": "Lost Out"}, {"dribble_outcome": "Complete"}, {"interception_outcome": "Won"}, {"shot_outcome": "Saved"}, {"pass_length": 12.0}, {"pass_length": 3.0, "pass_outcome": "Out"}]
    rows = [(1, 0, 5, GOAL), (1, 1, 95, SUB)] + [(1, s, 20, x) for s in (0, 1) for x in skills] + [(1, 1, 80, GOAL)]
    r = segments.strengths(segments.per_minute(segments.around_substitutions(events(spark, rows)))).first()
    assert r is None  # its only substitution came in the last minute
    r = segments.strengths(segments.per_minute(segments.around_substitutions(events(spark, rows + [(1, 0, 96, GOAL)])))).first()
    assert r["substitution_minute"] == 95 and r["strength__off__pre"] == pytest.approx(0.2 * (1 + 1 + 0.5 + 1 + 1)) and r["strength__off__post"] is None
    assert r["passes_perMin__off__pre"] == pytest.approx(2 / 95) and r["goals_perMin__off__DIFF"] == pytest.approx(-1 / 95) and r["strength_diff__passes"] == 0


def test_odd_rows_against_plain_loops(spark):
    """Unknown matches drop out, unknown minutes lie before any boundary, rows of other sides count for the last minute alone; empty windows give 0."""
    passed = lambda x: {"pass_length": x}
    rows = [(None, 0, 10, GOAL), (None, 1, 70, SUB), (1, 0, 10, GOAL), (1, 0, None, GOAL), (1, 1, None, passed(1.5)), (1, 1, 61, SUB), (1, 1, 61, SUB), (1, 1, 80, SUB), (1, None, 80, SUB), (1, 2, 81, SUB), (1, 2, 97, passed(7.0))]
    rows += [(1, s, t, passed(0.3 * t + (s or 0))) for s in (0, 1, None, 2) for t in (0, 57, 58, 59, 60, 61, 62, 79, 80, 81, 95)] + [(1, 1, None, SUB), (1, 1, 97, SUB)]
    rows += [(2, 1, 59, GOAL), (2, 0, 60, passed(4.0)), (3, 1, 58, GOAL), (3, 0, 59, passed(1.0)), (4, 1, 1, GOAL), (4, 1, 88, GOAL), (5, 1, None, GOAL), (5, 0, 90, GOAL), (6, 0, 3, GOAL), (6, 1, 59, SUB), (6, 1, 64, passed(2.0)), (6, 0, 70, GOAL)]
    yards = 0.9144

    def expected(m, own, bounds, last):
        for b, n in zip(bounds, [*bounds[1:], last], strict=True):
            for role, side in (("off", own), ("def", 1 - own)):
                mine = [(t, x["pass_length"] / yards) for k, s, t, x in rows if (k, s) == (m, side) and "pass_length" in x]
                yield (m, b), f"pass_success_length__total__{role}__pre", sum(x for t, x in mine if t is None or t < b)
                yield (m, b), f"pass_success_length__total__{role}__post", sum(x for t, x in mine if t is not None and b < t < n)

    got = {(r.match_id, r.substitution_minute): r.asDict() for r in segments.around_substitutions(events(spark, rows)).collect()}
    want = [x for m in ((1, 1, [61, 80], 97), (2, 0, [59], 60), (4, 0, [59], 88), (6, 1, [59], 70)) for x in expected(*m)]
    assert got.keys() == {k for k, _, _ in want}
    assert [got[k][n] for k, n, _ in want] == pytest.approx([v for _, _, v in want])
    assert (got[1, 61]["minutes_after"], got[1, 80]["minutes_after"], got[1, 61]["score60_def"]) == (19, 17, 1)
    assert got[1, 61]["substitution_tactical__off__pre"] == 1 and got[1, 80]["substitution_tactical__off__pre"] == 3


def test_events_move_twice_and_meet_no_join(spark):
    """Sums by minute, then a match's rows together: events are read once, all boundaries come out of the rows themselves."""
    rows = segments.around_substitutions(events(spark, [(1, 0, 10, GOAL)]))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text and "Union" not in text
    assert text.count("Scan ") == 1
