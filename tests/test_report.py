"""The report's definitions: what is unknown is never counted as zero."""

import pytest

from trackloom.operators import report as R

SCHEMA = "match_id int, event_id string, kind string, team string, player_id string, target_id string, period int, outcome boolean, x double, y double, end_x double, end_y double, sign int, start_ms long, end_ms long, status string, flags map<string,boolean>, numbers map<string,double>, labels map<string,string>"


def event(ident="e1", **kw):
    row = dict.fromkeys(c.split()[0] for c in SCHEMA.split(", "))
    row |= {"match_id": 1, "event_id": ident, "kind": "pass", "team": "A", "player_id": "p1", "period": 0, "outcome": True, "start_ms": 0, "status": "verified", "flags": {}, "numbers": {}, "labels": {}}
    return tuple((row | kw).values())


@pytest.fixture(scope="module")
def reports(spark):
    """All cases in two reports: each case is a match of its own, certified for nothing or for the kinds named."""
    zone = [(-40, -10, True), (-5, 8, False), (-10, 10, True), (8, 18, True)]
    moved = lambda s, a, b: [event(x=float(a * s), y=0.0, end_x=float(b * s), end_y=0.0, sign=s)]
    cases = {
        "nothing": ([], ()),
        "zero": ([], ("shot",)),
        "no team": ([event(kind="shot", team=None)], ("shot",)),
        "half lost": ([event(), event("e2", outcome=False)], ("pass",)),
        "unknown outcome": ([event(outcome=None)], ()),
        "estimated": ([event(status="estimated")], ()),
        "no model": ([event(kind="shot", numbers={"xg": 0.2})], ()),
        "model": ([event(kind="shot", numbers={"xg": 0.2}, labels={"xg_model": "m"})], ("shot",)),
        "stated unknown": ([event(kind="shot", flags={"on_target": None})], ()),
        "no direction": ([event(x=0.0, y=30.0, end_x=1.0, end_y=30.0)], ()),
        "possession": ([event(kind="possession", start_ms=0, end_ms=5000), event("e2", kind="possession", start_ms=6000, end_ms=21000)], ()),
        "open end": ([event(kind="possession", start_ms=0)], ()),
        **{f"zone {s} {k}": (moved(s, a, b), ("pass",)) for s in (1, -1) for k, (a, b, _) in enumerate(zone)},
    }
    number = {name: k for k, name in enumerate(cases)}
    out = {}
    for certified in (False, True):
        own = [n for n, (_, c) in cases.items() if bool(c) == certified]
        rows = [(number[n], *e[1:]) for n in own for e in cases[n][0]]
        teams = spark.createDataFrame([(number[n], t) for n in own for t in "AB"], "match_id int, team string")
        periods = spark.createDataFrame([(number[n], p) for n in own for p in (0, 1)], "match_id int, period int")
        got = R.rolled_up(spark.createDataFrame(rows, SCHEMA), ["shot", "pass"] if certified else [], teams=teams, periods=periods).where("scope <> 'player'").collect()
        for r in got:
            out[own[[number[n] for n in own].index(r["match_id"])], r["scope"], r["entity"], r["period"], r["group"], r["metric"]] = r
    return out


def test_a_certified_zero_is_not_missing_coverage(reports):
    key = ("team", "A", None, "shots", "total")
    assert reports["nothing", *key]["value"] is None
    assert reports["zero", *key]["value"] == 0 and reports["zero", *key]["state"] == "verified"
    assert reports["zero", "period", "B", 1, "shots", "total"]["value"] == 0
    assert len([k for k in reports if k[:3] == ("zero", "team", "A")]) == sum(map(len, R.CATALOG.values())) + len(R.MEASURES)


def test_events_without_a_team_forbid_zeroes(reports):
    assert reports["no team", "team", "A", None, "shots", "total"]["value"] is None and reports["no team", "team", "B", None, "shots", "total"]["value"] is None


@pytest.mark.parametrize("sign", [1, -1])
def test_progress_depends_on_zone_and_direction(reports, sign):
    for k, yes in enumerate([True, False, True, True]):
        assert reports[f"zone {sign} {k}", "team", "A", None, "passes", "progressive"]["value"] == int(yes), k
        assert reports[f"zone {sign} {k}", "team", "A", None, "passes", "forward"]["value"] == 1


def test_success_and_unknown_outcomes(reports):
    key = ("team", "A", None, "passes", "total")
    got = reports["half lost", *key]
    assert (got["successful"], got["success_pct"], got["state"]) == (1, 50.0, "verified")
    got = reports["unknown outcome", *key]
    assert (got["value"], got["successful"], got["success_pct"], got["state"]) == (1, None, None, "partial")
    assert reports["estimated", *key]["state"] == "estimated"


def test_expected_goals_need_their_model(reports):
    key = ("team", "A", None, "shots", "xg")
    assert reports["no model", *key]["value"] is None and reports["model", *key]["value"] == 0.2


def test_missing_and_stated_unknown_qualifiers(reports):
    assert reports["stated unknown", "team", "A", None, "shots", "on_target"]["value"] is None and reports["stated unknown", "team", "A", None, "shots", "blocked"]["value"] is None
    # a place without a direction says nothing of zones
    assert reports["no direction", "team", "A", None, "passes", "into_box"]["value"] is None and reports["no direction", "team", "A", None, "passes", "short"]["value"] == 1


def test_possession_measures(reports):
    get = lambda case, metric: reports[case, "team", "A", None, "possession", metric]["value"]
    assert get("possession", "time_s") == 20.0 and get("possession", "average_duration_s") == 10.0 and get("possession", "duration_10_20_s") == 1
    assert get("open end", "time_s") is None and get("open end", "duration_0_10_s") is None


def test_pressing_needs_everything(spark):
    rows = [event(team="B", sign=-1, x=20.0, y=0.0), event("e2", kind="tackle", sign=1, x=20.0, y=0.0)]
    need = ["pass", "tackle", "interception", "duel", "foul"]
    get = lambda ev, c: {r["team"]: r["ppda"] for r in R.pressing(spark.createDataFrame(ev, SCHEMA), c).collect()}
    assert get(rows, [])["A"] is None
    assert get(rows, need)["A"] == 1.0 and get(rows, need)["B"] is None
    assert get([*rows, event("e3", team="B", sign=-1, x=20.0, outcome=None)], need)["A"] is None


def test_configurations_must_fit_the_pitch():
    for bad in ({"short_below": 50.0}, {"box_depth": 60.0}, {"box_width": 80.0}, {"press_depth": 200.0}, {"forward_cosine": 2.0}):
        with pytest.raises(ValueError):
            R.Config(**bad)
