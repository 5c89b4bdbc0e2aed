"""Column functions of the scalar operators; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("HOME", "DRAW", "AWAY")


def form_score(form: Column) -> Column:
    """W/D/L string to 0..1: three points a win, one a draw; empty or all dashes give 0.5."""
    n = F.length(form)
    points = 3 * F.length(F.regexp_replace(form, "[^W]", "")) + F.length(F.regexp_replace(form, "[^D]", ""))
    return F.when(form.isNull() | (n == 0) | (form == "-----"), 0.5).otherwise(points / (n * 3.0))


def safe_pct(part: Column, total: Column) -> Column:
    """part / total to four decimals, 0 where total isn't positive."""
    return F.when(total > 0, F.round(part / total, 4)).otherwise(0.0)


def implied_probability(odds: Column, default: float = 0.33) -> Column:
    return F.when(odds > 0, F.round(1 / odds, 4)).otherwise(default)


def _inverse(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds)


def overround(home: Column, draw: Column, away: Column) -> Column:
    """Sum of inverse odds; null unless all three are positive."""
    return _inverse(home) + _inverse(draw) + _inverse(away)


def fair_probability(odds: Column, home: Column, draw: Column, away: Column) -> Column:
    """Margin-free market probability of one outcome."""
    return _inverse(odds) / overround(home, draw, away)


def has_real_odds(home: Column, draw: Column, away: Column) -> Column:
    return F.coalesce((home > 1) & (draw > 1) & (away > 1), F.lit(False))


def normalised(part: Column, home: Column, draw: Column, away: Column, default: float) -> Column:
    """Share of a percentage in the sum of three, nulls as 0; the default where the sum is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = zero(home) + zero(draw) + zero(away)
    return F.when(total > 0, zero(part) / total).otherwise(default)


def tip_probability(tip: Column, outcome: str) -> Column:
    """Fixed probabilities of a bare tip 1, X or 2."""
    # Home, draw, away per tip.
    table = {"1": (0.55, 0.25, 0.20), "2": (0.20, 0.25, 0.55), "X": (0.30, 0.40, 0.30)}
    at = OUTCOMES.index(outcome)
    out = F.lit(None).cast("double")
    for key, values in table.items():
        out = F.when(tip == key, values[at]).otherwise(out)
    return out


def outcome_of_score(home: Column, away: Column) -> Column:
    return F.when(home > away, "HOME").when(home == away, "DRAW").when(home < away, "AWAY")


def argmax_outcome(home: Column, draw: Column, away: Column, order: str = "HDA") -> Column:
    """Outcome of the largest value; ties go to the first in the given order."""
    value = {"H": (home, "HOME"), "D": (draw, "DRAW"), "A": (away, "AWAY")}
    best = F.greatest(home, draw, away)
    out = F.lit(None).cast("string")
    for k in reversed(order):
        out = F.when(value[k][0] == best, value[k][1]).otherwise(out)
    return out


def of_outcome(outcome: Column, home: Column, draw: Column, away: Column) -> Column:
    return F.when(outcome == "HOME", home).when(outcome == "DRAW", draw).when(outcome == "AWAY", away)


def edge(probability: Column, fair: Column) -> Column:
    return F.round(probability - fair, 4)


def value_rating(hp: Column, dp: Column, ap: Column, ho: Column, do: Column, ao: Column) -> Column:
    """Largest (p - 1/o) * o over the outcomes with odds, at least 0."""
    part = lambda p, o: F.when(o > 0, (p - 1 / o) * o)
    return F.greatest(F.lit(0.0), part(hp, ho), part(dp, do), part(ap, ao))


def settled(p: Column, digits: int = 4) -> Column:
    """A probability with so many digits, halves up; the small term settles halves that binary numbers miss."""
    return F.floor(p * 10**digits + 0.5000001) / 10.0**digits


def recommended(hp: Column, dp: Column, ap: Column, he: Column, de: Column, ae: Column, least_edge: float = 0.03, least_p: float = 0.5) -> Column:
    """The outcome of the best edge if its edge and probability pass."""
    best = argmax_outcome(he, de, ae)
    good = (of_outcome(best, he, de, ae) > least_edge) & (of_outcome(best, hp, dp, ap) > least_p)
    return F.when(good, best)


def _whole_percent(x: Column) -> Column:
    return F.concat(F.round(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def _cents(x: Column) -> Column:
    """Two decimals, halves up; the small term settles halves that binary numbers miss."""
    return F.format_string("%.2f", F.floor(x * 100 + 0.5000001) / 100.0)


def suggestion(hp, dp, ap, ho, do, ao, home: Column, away: Column, confidence: Column) -> Column:
    """Up to three parts: high confidence first, then value bets, or a lean if there is nothing else."""
    def bet(p, o, who, least_ev, least_p, mark):
        text = F.concat(F.lit(f"{mark} VALUE: "), who, F.lit(" @ "), _cents(o), F.lit(" (EV: "), _cents(p * o), F.lit(")"))
        return F.when((o > 0) & (p * o > least_ev) & (p > least_p), text)

    best = argmax_outcome(hp, dp, ap)
    # Marks and wording of the parts.
    sure = F.when(
        confidence > 0.6,
        F.concat(
            F.lit("🎯 HIGH CONFIDENCE: "),
            of_outcome(best, F.concat(home, F.lit(" Win")), F.lit("Draw"), F.concat(away, F.lit(" Win"))),
            F.lit(" ("), _whole_percent(confidence), F.lit(")"),
        ),
    )
    parts = F.array_compact(
        F.array(
            sure,
            bet(hp, ho, F.concat(home, F.lit(" to win")), 1.0, 0.4, "💚"),
            bet(dp, do, F.lit("Draw"), 1.1, 0.28, "🟡"),
            bet(ap, ao, F.concat(away, F.lit(" to win")), 1.0, 0.35, "💚"),
        )
    )
    lean = F.concat(F.lit("📊 Lean: "), of_outcome(best, home, F.lit("Draw"), away), F.lit(" ("), _whole_percent(F.greatest(hp, dp, ap)), F.lit(")"))
    return F.when(F.size(parts) == 0, lean).otherwise(F.array_join(F.slice(parts, 1, 3), " | "))


def consensus_value_text(hp, dp, ap, ho, do, ao, home: Column, away: Column) -> Column:
    """Value parts of a consensus; percentages over 1 are divided by 100. Null without a part."""
    h, d, a = to_fraction(hp), F.coalesce(to_fraction(dp), F.lit(0.0)), to_fraction(ap)

    def part(p, o, who, least, mark):
        return F.when((o > 0) & (p * o > least), F.concat(F.lit(mark + " "), who, F.lit(" VALUE (EV: "), _cents(p * o), F.lit(")")))

    parts = F.array_compact(F.array(part(h, ho, home, 1.05, "💚"), part(d, do, F.lit("Draw"), 1.10, "🟡"), part(a, ao, away, 1.05, "💚")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " | "))


def season_start(text: Column) -> Column:
    """2024-2025, 2024, 2024-08-16 or the code 2425 to 2024."""
    digits = F.regexp_extract(text, r"^(\d{4})", 1)
    code = digits.rlike("^[0-9]{4}$") & (F.try_to_number(F.substring(digits, 3, 2), F.lit("99")) == F.try_to_number(F.substring(digits, 1, 2), F.lit("99")) + 1)
    short = (F.length(F.trim(text)) == 4) & code
    return F.when(short, F.lit(2000) + F.substring(digits, 1, 2).try_cast("int")).otherwise(digits.try_cast("int"))


def match_time(date: Column, time: Column, default: str = "15:00") -> Column:
    """dd/MM/yyyy, dd/MM/yy or ISO date with an optional HH:mm."""
    full = F.concat_ws(" ", F.trim(date), F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit(default)))
    formats = ("dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm", "yyyy-MM-dd HH:mm")
    return F.coalesce(*[F.try_to_timestamp(full, F.lit(f)) for f in formats])


def lenient_int(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double").cast("int")


def lenient_float(text: Column, digits: int = 2) -> Column:
    return F.round(F.nullif(F.trim(text), F.lit("")).try_cast("double"), digits)


def first_nonzero(*odds: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit(0.0)) for o in odds])


def normal_outcome(text: Column) -> Column:
    """Every spelling of an outcome to HOME, DRAW or AWAY; others give null."""
    # The spellings in use.
    spellings = {"HOME": ["HOME", "HOME_WIN", "HOME WIN", "1"], "DRAW": ["DRAW", "X"], "AWAY": ["AWAY", "AWAY_WIN", "AWAY WIN", "2"]}
    out = F.lit(None).cast("string")
    for name, forms in spellings.items():
        out = F.when(F.upper(F.trim(text)).isin(forms), name).otherwise(out)
    return out


def normal_status(code: Column) -> Column:
    """Status codes of all feeds to one domain; unknown ones stay."""
    # Codes of the feeds.
    table = {
        "SCHEDULED": ["NS", "TBD", "1", "pre", "TIMED", "NOT_STARTED"],
        "IN_PLAY": ["1H", "2H", "ET", "P", "in", "STARTED"],
        "HALFTIME": ["HT"],
        "LIVE": ["LIVE", "2", "6"],
        "FINISHED": ["FT", "AET", "PEN", "3", "8", "9", "post"],
        "POSTPONED": ["PST", "4"],
        "CANCELLED": ["CANC", "5"],
        "SUSPENDED": ["SUSP", "INT"],
    }
    out = code
    for name, codes in table.items():
        out = F.when(code.isin(codes), name).otherwise(out)
    return out


def to_fraction(x: Column) -> Column:
    return F.when(x > 1, x / 100).otherwise(x)


def brier(hp: Column, dp: Column, ap: Column, actual: Column) -> Column:
    one = lambda p, k: (p - F.when(actual == k, 1.0).otherwise(0.0)) ** 2
    return one(hp, "HOME") + one(dp, "DRAW") + one(ap, "AWAY")


def log_loss(hp: Column, dp: Column, ap: Column, actual: Column) -> Column:
    return -F.log(F.greatest(F.coalesce(of_outcome(actual, hp, dp, ap), F.lit(0.33)), F.lit(1e-15)))


def flat_roi(predicted: Column, actual: Column, price: Column) -> Column:
    """Return of a stake of one at a price; -1 if the pick lost."""
    return F.when(predicted == actual, price - 1).otherwise(-1.0)


def value_tier(x: Column) -> Column:
    return F.when(x > 0.5, "high").when(x > 0.2, "medium").otherwise("low")


def accuracy_tier(percent: Column) -> Column:
    return F.when(percent >= 50, "green").when(percent >= 35, "yellow").otherwise("red")


def disagreement(h_spread: Column, d_spread: Column, a_spread: Column, limit: float = 0.15) -> Column:
    return F.greatest(h_spread, d_spread, a_spread) > limit


def price_from_probability(p: Column) -> Column:
    return F.round(100 / F.greatest(p * 100, F.lit(1.0)), 2)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), " ", "-"), "\\.", "")


def deeplink(base: str, event_id: Column, name: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), event_id.cast("string"), F.lit("/"), slug(name))


def strip_html(html: Column) -> Column:
    """Tags to blanks and the common entities unescaped."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return out


def surrogate_id(*parts: Column) -> Column:
    """A stable id of 60 bits: the beginning of the MD5 of the parts, each with its length, - for null."""
    text = [p.cast("string") for p in map(lambda p: F.col(p) if isinstance(p, str) else p, parts)]
    joined = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def exact_mean(x: Column) -> Column:
    """Mean by the first twelve decimals of each value: the order of rows, which moves the last bits of a sum of doubles, doesn't matter.

    If a value is no such decimal (not finite, or too large), it is the plain mean.
    """
    exact = x.try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.nullif(F.count(x), F.lit(0))).otherwise(F.avg(x))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up by its first twelve decimals, so that noise in the last bits of a double doesn't decide a half."""
    return F.round(x.cast("decimal(28,12)"), digits).cast("double")


# The first keyword that a league's name holds gives its code.
LEAGUE_KEYWORDS = (
    ("premier league", "PL"), ("la liga", "PD"), ("laliga", "PD"), ("primera", "PD"), ("bundesliga", "BL1"), ("serie a", "SA"),
    ("ligue 1", "FL1"), ("champions", "CL"), ("europa league", "EL"), ("eredivisie", "DED"), ("primeira liga", "PPL"),
    ("série a", "BSA"), ("superligaen", "DK_SL"), ("1st division", "DK_1D"),
)


def league_code(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("")
    for word, code in reversed(LEAGUE_KEYWORDS):
        out = F.when(F.contains(low, F.lit(word)), code).otherwise(out)
    return out


def poisson_terms(rate: Column, most: int = 7) -> Column:
    """Poisson probabilities of 0..most goals as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.pow(rate, i) * F.exp(-rate) / F.factorial(i))


def poisson_outcomes(home_rate: Column, away_rate: Column, most: int = 7) -> Column:
    """Probabilities (home, draw, away) on a grid of goals, without a tail.

    Both arrays of terms are built once, and one pass carries their running
    sums: a side wins with n goals if the other has fewer.
    """
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("h", "a", "home", "draw", "away")])

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            (s["h"] + x["h"]).alias("h"), (s["a"] + x["a"]).alias("a"), (s["home"] + x["h"] * s["a"]).alias("home"), (s["draw"] + x["h"] * x["a"]).alias("draw"), (s["away"] + x["a"] * s["h"]).alias("away"),
        )

    terms = F.arrays_zip(poisson_terms(home_rate, most).alias("h"), poisson_terms(away_rate, most).alias("a"))
    return F.aggregate(terms, zero, step)
