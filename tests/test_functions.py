"""Worked values of the scalar functions and names."""

import pytest
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(("form", "want"), [("WWDLW", 10 / 15), ("", 0.5), ("-----", 0.5), (None, 0.5), ("LLL", 0.0)])
def test_form_score(spark, form, want):
    assert value(spark, X.form_score(F.lit(form).cast("string"))) == pytest.approx(want)


def test_market_arithmetic(spark):
    h, d, a = lit(1.85, 3.50, 4.20)
    assert value(spark, X.overround(h, d, a)) == pytest.approx(1.064350, abs=1e-6)
    fair = [value(spark, X.fair_probability(o, h, d, a)) for o in (h, d, a)]
    assert fair == pytest.approx([0.507860, 0.268440, 0.223700], abs=1e-6)
    edges = [value(spark, X.edge(F.lit(p), F.lit(f))) for p, f in zip((0.5, 0.3, 0.2), fair, strict=True)]
    assert edges == pytest.approx([-0.0079, 0.0316, -0.0237])
    assert value(spark, X.recommended(*lit(0.5, 0.3, 0.2), *lit(*edges))) is None
    assert value(spark, X.value_rating(*lit(0.5, 0.3, 0.2), h, d, a)) == pytest.approx(0.05)
    assert value(spark, X.implied_probability(F.lit(0.0))) == 0.33


def test_scores_of_predictions(spark):
    p = lit(0.5, 0.3, 0.2)
    assert value(spark, X.brier(*p, F.lit("HOME"))) == pytest.approx(0.38)
    assert value(spark, X.brier(*p, F.lit("AWAY"))) == pytest.approx(0.98)
    assert value(spark, X.log_loss(*p, F.lit("HOME"))) == pytest.approx(0.693147, abs=1e-6)
    assert value(spark, X.log_loss(*p, F.lit("AWAY"))) == pytest.approx(1.609438, abs=1e-6)


def test_poisson_grid(spark):
    r = value(spark, X.poisson_outcomes(F.lit(3.15), F.lit(0.88)))
    got = [r["home"], r["draw"], r["away"]]
    assert got == pytest.approx([0.8001, 0.1137, 0.0707], abs=1e-4)


def test_argmax_ties(spark):
    tied = lit(0.4, 0.4, 0.4)
    assert value(spark, X.argmax_outcome(*tied)) == "HOME"
    assert value(spark, X.argmax_outcome(*lit(0.3, 0.35, 0.35))) == "DRAW"
    assert value(spark, X.argmax_outcome(*lit(0.3, 0.35, 0.35), "HAD")) == "AWAY"


@pytest.mark.parametrize(("text", "want"), [("2024-2025", 2024), ("2024", 2024), ("2024-08-16", 2024), ("2425", 2024), ("x", None)])
def test_season_start(spark, text, want):
    assert value(spark, X.season_start(F.lit(text))) == want


def test_parsing(spark):
    assert str(value(spark, X.match_time(F.lit("16/08/2024"), F.lit("20:00")))) == "2024-08-16 20:00:00"
    assert str(value(spark, X.match_time(F.lit("16/08/24"), F.lit(None).cast("string")))) == "2024-08-16 15:00:00"
    assert value(spark, X.lenient_int(F.lit(" 3.0 "))) == 3
    assert value(spark, X.lenient_int(F.lit("-"))) is None
    assert value(spark, X.lenient_float(F.lit("1.857"))) == 1.86
    assert value(spark, X.normal_outcome(F.lit("Home Win"))) == "HOME"
    assert value(spark, X.normal_outcome(F.lit("away_win"))) == "AWAY"
    assert value(spark, X.normal_status(F.lit("AET"))) == "FINISHED"
    assert value(spark, X.league_code(F.lit("English Premier League"))) == "PL"
    assert value(spark, X.strip_html(F.lit("<b>a &amp; b</b>"))).strip() == "a & b"
    assert value(spark, X.deeplink("https://x/event", F.lit(7), F.lit("A.C. B - D"))) == "https://x/event/7/ac-b---d"


@pytest.mark.parametrize(
    ("name", "want"),
    [("FC Barcelona", "barcelona"), ("Arsenal FC", "arsenal"), ("Paris Saint-Germain FC", "psg"), ("FC Bayern München", "bayern"), ("Borussia Dortmund", "dortmund")],
)
def test_bookmaker_names(spark, name, want):
    assert value(spark, N.bookmaker_name(F.lit(name))) == want


def test_names(spark):
    both = [value(spark, N.split_teams(F.lit("Arsenal FC - Chelsea FC"), i)) for i in (0, 1)]
    assert both == ["Arsenal FC", "Chelsea FC"]
    assert value(spark, N.canonical_name(F.lit("Man Utd"))) == "manchester united"
    assert value(spark, N.canonical_name(F.lit("FC Bayern"))) == "bayern munich"
    assert value(spark, N.legacy_name(F.lit("Manchester City"))) == "manchester"
    assert value(spark, N.match_key(F.lit(""), F.lit("x"))) is None
    assert value(spark, N.merge_name(F.lit("1. FC Köln"))) == "1 fc koln"
    same = lambda a, b: value(spark, N.same_team(N.canonical_name(F.lit(a)), N.canonical_name(F.lit(b)), N.legacy_name(F.lit(a)), N.legacy_name(F.lit(b))))
    assert same("Wolves", "Wolverhampton Wanderers FC")
    assert not same("Unknown Team", "Arsenal")
    assert not same("", "Arsenal")
