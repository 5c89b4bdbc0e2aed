"""Team-name normalisers and the same-team predicate, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias -> canonical name, one table per scope.
CANONICAL_ALIASES = {
    "psg": "paris saint germain",
    "paris saint-germain": "paris saint germain",
    "man utd": "manchester united",
    "man city": "manchester city",
    "wolves": "wolverhampton wanderers",
    "wolverhampton": "wolverhampton wanderers",
    "spurs": "tottenham hotspur",
    "tottenham": "tottenham hotspur",
    "newcastle utd": "newcastle united",
    "leeds utd": "leeds united",
    "west ham utd": "west ham united",
    "sheff utd": "sheffield united",
    "nott'm forest": "nottingham forest",
    "nottingham": "nottingham forest",
    "atletico madrid": "atletico de madrid",
    "atletico": "atletico de madrid",
    "atl. madrid": "atletico de madrid",
    "atlético madrid": "atletico de madrid",
    "atlético de madrid": "atletico de madrid",
    "athletic bilbao": "athletic club",
    "real sociedad": "real sociedad",
    "betis": "real betis",
    "celta vigo": "celta de vigo",
    "cadiz": "cadiz cf",
    "deportivo alaves": "alaves",
    "inter": "inter milan",
    "internazionale": "inter milan",
    "inter milan": "inter milan",
    "ac milan": "milan",
    "napoli": "ssc napoli",
    "hellas verona": "verona",
    "monza": "ac monza",
    "rb leipzig": "rasenballsport leipzig",
    "leipzig": "rasenballsport leipzig",
    "leverkusen": "bayer leverkusen",
    "bayer 04 leverkusen": "bayer leverkusen",
    "gladbach": "borussia monchengladbach",
    "b. monchengladbach": "borussia monchengladbach",
    "dortmund": "borussia dortmund",
    "b. dortmund": "borussia dortmund",
    "bayern": "bayern munich",
    "bayern munchen": "bayern munich",
    "fc bayern münchen": "bayern munich",
    "st. pauli": "fc st pauli",
    "mainz 05": "mainz",
    "freiburg": "sc freiburg",
    "augsburg": "fc augsburg",
    "heidenheim": "1. fc heidenheim",
    "lens": "rc lens",
    "lyon": "olympique lyonnais",
    "marseille": "olympique de marseille",
    "om": "olympique de marseille",
    "ol": "olympique lyonnais",
    "monaco": "as monaco",
    "saint etienne": "as saint-etienne",
    "st. etienne": "as saint-etienne",
    "psv": "psv eindhoven",
    "ajax": "afc ajax",
    "feyenoord": "feyenoord rotterdam",
    "az": "az alkmaar",
    "porto": "fc porto",
    "sporting": "sporting cp",
    "sporting lisbon": "sporting cp",
    "benfica": "sl benfica",
}
BOOKMAKER_ALIASES = {
    "as roma": "roma",
    "ac milan": "milan",
    "fc barcelona": "barcelona",
    "fc porto": "porto",
    "sporting cp": "sporting",
    "atalanta bc": "atalanta",
    "atalanta bergamo": "atalanta",
    "villarreal cf": "villarreal",
    "rb leipzig": "leipzig",
    "rasenballsport leipzig": "leipzig",
    "bayern munich": "bayern",
    "bayern münchen": "bayern",
    "fc bayern münchen": "bayern",
    "fc bayern munich": "bayern",
    "bayern munchen": "bayern",
    "borussia dortmund": "dortmund",
    "bor. dortmund": "dortmund",
    "borussia mönchengladbach": "gladbach",
    "bor. m'gladbach": "gladbach",
    "borussia monchengladbach": "gladbach",
    "tsg 1899 hoffenheim": "hoffenheim",
    "tsg hoffenheim": "hoffenheim",
    "1899 hoffenheim": "hoffenheim",
    "paris saint-germain": "psg",
    "paris sg": "psg",
    "paris saint germain": "psg",
    "atletico madrid": "atletico",
    "atlético de madrid": "atletico",
    "atlético madrid": "atletico",
    "atletico de madrid": "atletico",
    "inter milan": "inter",
    "inter milano": "inter",
    "internazionale": "inter",
    "ssc napoli": "napoli",
    "ssc neapel": "napoli",
    "manchester united": "man united",
    "manchester city": "man city",
    "tottenham hotspur": "tottenham",
    "wolverhampton wanderers": "wolves",
    "wolverhampton": "wolves",
    "brighton & hove albion": "brighton",
    "brighton and hove albion": "brighton",
    "sheffield utd": "sheffield united",
    "sheff utd": "sheffield united",
    "newcastle united": "newcastle",
    "west ham united": "west ham",
    "nottingham forest": "nott forest",
    "real sociedad de fútbol": "real sociedad",
    "real betis balompié": "real betis",
}
SITE_ALIASES = {
    "as roma": "roma",
    "ac milan": "milan",
    "fc barcelona": "barcelona",
    "fc porto": "porto",
    "sporting cp": "sporting",
    "atalanta bc": "atalanta",
    "atalanta bergamo": "atalanta",
    "us cremonese": "cremonese",
    "cagliari calcio": "cagliari",
    "rcd espanyol barcelona": "espanyol",
    "rcd espanyol": "espanyol",
    "villarreal cf": "villarreal",
    "middlesbrough fc": "middlesbrough",
    "sheffield utd": "sheffield united",
    "sheff utd": "sheffield united",
    "clermont foot 63": "clermont",
    "clermont foot": "clermont",
    "amiens sc": "amiens",
    "fenerbahce sk": "fenerbahce",
    "kasimpasa sk": "kasimpasa",
    "genclerbirligi sk": "genclerbirligi",
    "vejle boldklub": "vejle",
    "fc fredericia": "fredericia",
    "odense boldklub": "odense",
    "aarhus gf": "aarhus",
    "agf": "aarhus",
    "fc famalicao": "famalicao",
    "cd mirandes": "mirandes",
    "avs futebol": "avs",
    "avs futebol sad": "avs",
    "racing santander": "racing santander",
    "tsg 1899 hoffenheim": "hoffenheim",
    "tsg hoffenheim": "hoffenheim",
    "1899 hoffenheim": "hoffenheim",
    "rb leipzig": "leipzig",
    "rasenballsport leipzig": "leipzig",
    "bayern munich": "bayern",
    "bayern münchen": "bayern",
    "borussia dortmund": "dortmund",
    "bor. dortmund": "dortmund",
    "borussia mönchengladbach": "gladbach",
    "bor. m'gladbach": "gladbach",
}
# Suffixes and prefixes are stripped in this order, blanks are part of them.
MERGE_SUFFIXES = (" fc", " sc", " cf", " bc", " fk", " sk")
SITE_SUFFIXES = (" fc", " sc", " cf", " bc", " fk", " sk", " afc", " calcio", " sad", " sfc", " ssd", " kv", " sc braga", " bk", " if", " ff", " gf", " boldklub")
BOOKMAKER_SUFFIXES = (" fc", " sc", " cf", " bc", " fk", " sk", " afc", " calcio", " sad", " sfc", " ssd", " kv", " bk", " if", " ff", " gf", " boldklub", " 1846", " 1848", " 1909")
LEGACY_SUFFIXES = (" fc", " cf", " sc", " ac", " united", " city")
MERGE_PREFIXES = ("fc ", "sc ", "fk ", "sk ", "ac ", "as ")
SITE_PREFIXES = ("fc ", "sc ", "fk ", "sk ", "ac ", "as ", "us ", "ca ", "cd ", "rcd ", "tsg ", "1899 ")
BOOKMAKER_PREFIXES = ("fc ", "sc ", "fk ", "sk ", "ac ", "as ", "us ", "ca ", "cd ", "rcd ", "tsg ", "1899 ", "1. ")
LEGACY_PREFIXES = ("fc ", "cf ", "ac ", "as ", "ss ", "us ", "sc ", "afc ", "rcd ", "real ", "sporting ", "atletico ")
CANONICAL_PREFIXES = ("fc ", "cf ", "ac ", "as ", "ss ", "us ", "sc ", "afc ", "rcd ", "sl ", "ssc ")
NOISE = ("fc", "cf", "ac", "as", "ss", "us", "sc", "afc", "sl", "ssc", "de", "la", "le", "1.")
MERGE_LETTERS = ("üöéáñç", "uoeanc")
SITE_LETTERS = ("çãéüşıöëñ", "caeusioen")
BOOKMAKER_LETTERS = ("çãéüşıöëñáíóúý", "caeusioenaiouy")


def _looked_up(name: Column, aliases: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def _plain(name: Column) -> Column:
    """Punctuation dropped and blanks collapsed; letters with accents stay letters."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def _stepwise(name: Column, suffixes: tuple, prefixes: tuple) -> Column:
    """The strips as one pass of pattern replacements, in order."""
    out = F.lower(F.trim(name))
    for s in suffixes:
        out = F.trim(F.regexp_replace(out, s.replace(".", r"\.") + "$", ""))
    for p in prefixes:
        out = F.trim(F.regexp_replace(out, "^" + p.replace(".", r"\."), ""))
    return out


def merge_name(name: Column) -> Column:
    return _plain(F.translate(_stepwise(name, MERGE_SUFFIXES, MERGE_PREFIXES), *MERGE_LETTERS))


def site_name(name: Column) -> Column:
    return _plain(_looked_up(F.translate(_stepwise(name, SITE_SUFFIXES, SITE_PREFIXES), *SITE_LETTERS), SITE_ALIASES))


def bookmaker_name(name: Column) -> Column:
    aliases = BOOKMAKER_ALIASES
    out = _looked_up(_stepwise(name, BOOKMAKER_SUFFIXES, BOOKMAKER_PREFIXES), aliases)
    return _plain(_looked_up(F.translate(out, *BOOKMAKER_LETTERS), aliases))


def legacy_name(name: Column) -> Column:
    """Id form: joins teams that differ in a dropped word only, kept for old ids."""
    out = F.lower(F.trim(name))
    for p in LEGACY_PREFIXES:
        out = F.regexp_replace(out, "^" + p, "")
    for s in LEGACY_SUFFIXES:
        out = F.regexp_replace(out, s + "$", "")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), "[^a-z0-9]", "_"), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def canonical_name(name: Column) -> Column:
    """Alias looked up, and once more after one dropped prefix if that gives an alias."""
    aliases = CANONICAL_ALIASES
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    first = _looked_up(F.lower(F.trim(name)), aliases)
    # Every prefix ends with a blank, so a name starts with one of them at most.
    rest = F.regexp_replace(first, "^(" + "|".join(p.strip() for p in CANONICAL_PREFIXES) + ") ", "")
    return F.coalesce(F.when(rest != first, F.try_element_at(pairs, rest)), first)


def match_key(home: Column, away: Column) -> Column:
    """Pair key of normalised names; null if one is empty."""
    return F.when((F.length(home) > 0) & (F.length(away) > 0), F.concat(home, F.lit("_vs_"), away))


def match_id(date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), legacy_name(home), legacy_name(away))


def split_teams(name: Column, part: int) -> Column:
    """Home (0) or away (1) of 'Home - Away', else ' vs ', else ' v '."""
    out = F.lit("")
    for sep in (" v ", " vs ", " - "):
        out = F.when(F.contains(name, F.lit(sep)), F.trim(F.split(name, sep, 2)[part])).otherwise(out)
    return out


def long_words(name: Column, over: int = 3) -> Column:
    return F.filter(F.split(name, " "), lambda w: F.length(w) > over)


def common_long_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(long_words(a), long_words(b))


def contained(a: Column, b: Column) -> Column:
    """One non-empty name holds the other."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def side_score(a: Column, b: Column) -> Column:
    """2 for equal names, 1 for containment or a common long word, else 0."""
    return F.when(a == b, 2).when(contained(a, b) | common_long_word(a, b), 1).otherwise(0)


def team_words(name: Column) -> Column:
    """The set of a canonical name's words without noise."""
    return F.array_except(F.array_distinct(F.split(name, " ")), F.array(*[F.lit(x) for x in (*NOISE, "")]))


def half_shared(a: Column, b: Column) -> Column:
    """Two sets of words share at least half of the smaller one."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller >= 0.5).otherwise(False)


def same_team(a: Column, b: Column, legacy_a: Column, legacy_b: Column) -> Column:
    """Equal or contained, also in the id form, or half of the smaller set of words shared; a and b are canonical."""
    return contained(a, b) | contained(legacy_a, legacy_b) | half_shared(team_words(a), team_words(b))
