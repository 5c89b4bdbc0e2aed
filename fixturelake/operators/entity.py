"""Name resolution: fuzzy joins by signatures.

Candidates come from equi-joins on distinct names only; the predicates and scores
of ``functions.names`` then decide. A name inside another is looked for by its
rarest piece of three characters, so a frequent beginning meets few names. Names
that share half of their words are found by a prefix filter: words are ordered
by how many names hold them, and only the rare ones that an overlap of one half
needs are joined; noise words are no words. No pair that a predicate accepts is
lost, and no nested-loop join is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.streaming.live import job_path

#: Left and right rows of a pair of names that meet in one task, and rows of a result that a task makes.
SHARES, TASK_ROWS = (32768, 2048), 2**26
#: Values of an array; a divisor of 504, the values of a packed run in Parquet, so that a repeated array repeats the same bytes.
BLOCK = 168


def pieces(name: Column) -> Column:
    """All pieces of up to three characters of a name, and the empty one."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.array(*[F.substr(name, i, F.lit(k)) for k in (1, 2, 3)]))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(each)))


def signatures(name: Column) -> Column:
    """Pieces that any name holding this one has: itself if it is short, else its pieces of three characters."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substr(name, i, F.lit(3)))
    return F.array_distinct(each)


def rarest_pieces(needles: DataFrame, hays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(needle, piece, n): each needle's piece that fewest hays have, n > 0 of them; and (hay, piece) of all hays.

    needles: needle; hays: hay, both distinct. A needle with a piece that no hay has is in none and left out.
    """
    listed = hays.select("hay", F.explode(pieces(F.col("hay"))).alias("piece"))
    number = listed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = needles.select("needle", F.explode(signatures(F.col("needle"))).alias("piece")).join(number, "piece", "left")
    rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    return rarest.select("needle", "r.piece", "r.n").where(F.col("n") > 0), listed


def containing(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): which names hold which, each pair once; a needle meets only the hays that have its rarest piece."""
    rarest, listed = rarest_pieces(needles.distinct(), hays.distinct())
    return rarest.join(listed, "piece").where(F.contains(F.col("hay"), F.col("needle"))).select("needle", "hay")


def _distinct(df: DataFrame, column: str, as_name: str) -> DataFrame:
    return df.select(F.col(column).alias(as_name)).where(F.length(as_name) > 0).distinct()


def contained_either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct non-empty names (left: a, right: b) of which one holds the other; equal names come twice."""
    inside = containing(_distinct(left, "a", "needle"), _distinct(right, "b", "hay")).select(F.col("needle").alias("a"), F.col("hay").alias("b"))
    around = containing(_distinct(right, "b", "needle"), _distinct(left, "a", "hay")).select(F.col("hay").alias("a"), F.col("needle").alias("b"))
    return inside.unionByName(around)


def ordered_words(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """(name, size, words) with a name's words from the rarest to the most frequent; names: name, words."""
    each = names.select("name", F.size("words").alias("size"), F.explode("words").alias("word")).join(frequency, "word")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    return each.groupBy("name", "size").agg(listed.alias("words"))


def overlap_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b), some of them more than once: names that may share half of the smaller one's words.

    left and right: name, words (a set). Of the smaller name's words, ordered by frequency, one of the rarest half and
    one more must be shared, and in the larger name at least half of the smaller one's number must follow it.
    """
    frequency = left.unionByName(right).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def placed(df: DataFrame, name: str) -> DataFrame:
        return ordered_words(df, frequency).select(F.col("name").alias(name), F.col("size").alias(f"size_{name}"), F.posexplode("words").alias(f"place_{name}", "word"))

    a, b = placed(left, "a"), placed(right, "b")
    found = []
    for small, large in (("a", "b"), ("b", "a")):
        rare = {"a": a, "b": b}[small].where(F.col(f"place_{small}") <= F.floor(F.col(f"size_{small}") / 2))
        size_s, size_l = F.col(f"size_{small}"), F.col(f"size_{large}")
        longer = (size_l >= size_s) if small == "a" else (size_l > size_s)
        met = rare.join({"a": a, "b": b}[large], "word").where(longer & (F.col(f"place_{large}") <= size_l - F.ceil(size_s / 2)))
        found.append(met.select("a", "b"))
    return found[0].unionByName(found[1])


def same_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct names (left: a, right: b) that share at least half of the smaller one's words; noise words don't count."""
    words = lambda df, c: _distinct(df, c, "name").select("name", N.team_words(F.col("name")).alias("words")).where(F.size("words") > 0)
    met = overlap_candidates(words(left, "a"), words(right, "b")).distinct()
    return met.where(N.half_shared(N.team_words(F.col("a")), N.team_words(F.col("b"))))


def same_teams(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names that likely mean one team; each distinct name is normalised once."""
    def resolved(df: DataFrame, tag: str) -> DataFrame:
        names = df.select(F.col("name").alias(tag)).distinct()
        return names.select(tag, N.canonical_name(F.col(tag)).alias(f"c{tag}"), N.legacy_name(F.col(tag)).alias(f"l{tag}"))

    a, b = resolved(left, "a"), resolved(right, "b")
    form = lambda k: (a.select(F.col(f"{k}a").alias("a")), b.select(F.col(f"{k}b").alias("b")))
    canonical = contained_either_way(*form("c")).unionByName(same_words(*form("c"))).distinct()
    legacy = contained_either_way(*form("l")).distinct()
    back = lambda pairs, k: a.join(pairs.withColumnsRenamed({"a": f"{k}a", "b": f"{k}b"}), f"{k}a").join(b, f"{k}b").select("a", "b")
    return back(canonical, "c").unionByName(back(legacy, "l")).distinct()


def stored(df: DataFrame, name: str = "pairs") -> DataFrame:
    """A table of distinct names or pairs, written once and read back: later steps neither compute it again nor guess its size."""
    spark = df.sparkSession
    path = job_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def matching_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(home, away, r_home, r_away) of distinct pairs of names that mean the same two teams; left and right have home and away.

    Each side is read once, for its distinct pairs; names are resolved from these.
    """
    l = stored(left.select("home", "away").distinct())  # noqa: E741
    r = stored(right.select("home", "away").distinct())
    names = lambda df: stored(df.select(F.explode(F.array("home", "away")).alias("name")).distinct(), "names")
    same = stored(same_teams(names(l), names(r)), "same-teams")
    h = same.select(F.col("a").alias("home"), F.col("b").alias("r_home"))
    w = same.select(F.col("a").alias("away"), F.col("b").alias("r_away"))
    return stored(l.join(h, "home").join(w, "away").join(r.withColumnsRenamed({"home": "r_home", "away": "r_away"}), ["r_home", "r_away"]))


def all_fuzzy_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, pos) of all right matches with the teams of each left match; left: id, home, away; right: pos, home, away.

    The result of a pair of names is the product of its rows, so no task gets a
    pair whole: rows are dealt by hash to shares of about ``SHARES``, and two
    shares that meet are a cell, which lies in one task. In a cell arrays of
    ``BLOCK`` rows meet: one side stays while the other repeats in order, so a
    file of the result takes a fraction of a byte per row.
    """
    counts = lambda df, share: stored(df.groupBy("home", "away").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / share)), "counts")
    l, r = counts(left, SHARES[0]), counts(right, SHARES[1])
    met = matching_pairs(l, r).join(l, ["home", "away"]).join(r.withColumnsRenamed({c: f"r_{c}" for c in r.columns}), ["r_home", "r_away"])
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = (F.col("n") / F.col("shares")) * (F.col("r_n") / F.col("r_shares"))
    cells = met.withColumn("share", each("shares")).withColumn("r_share", each("r_shares"))
    cells = stored(cells.select("home", "away", "share", "r_home", "r_away", "r_share", rows.alias("rows"), F.monotonically_increasing_id().alias("cell")), "cells")
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((cells.agg(F.sum("rows")).first()[0] or 0) / TASK_ROWS))
    known = cells.select(F.col("r_home").alias("home"), F.col("r_away").alias("away"), F.col("r_share").alias("share"), "cell")
    a = _blocks(left, "id", l).join(cells, ["home", "away", "share"]).select("cell", F.col("block").alias("a")).repartition(tasks, "cell")
    b = _blocks(right, "pos", r).join(known, ["home", "away", "share"]).select("cell", F.col("block").alias("b")).repartition(tasks, "cell")
    # The engine merges no operator across a coalesce, of which there are as many partitions as before: else the join
    # would hold the exploded rows of all blocks that meet one block before it hands on the first.
    met = b.join(a.hint("merge"), "cell").select("a", "b").coalesce(tasks)
    return met.select(F.explode("a").alias("id"), "b").select("id", F.explode("b").alias("pos"))


def _blocks(df: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """(home, away, share, block): a column of each pair of names as arrays of at most ``BLOCK`` values, nulls among them; counts: home, away, shares."""
    dealt = df.select(column, "home", "away").join(counts.select("home", "away", "shares"), ["home", "away"]).withColumn("share", F.pmod(F.xxhash64(column), "shares"))
    place = F.row_number().over(W.partitionBy("home", "away", "share").orderBy(column)) - 1
    listed = F.transform(F.collect_list(F.struct(column)), lambda x: x[column])
    return dealt.withColumn("place", F.floor(place / BLOCK)).groupBy("home", "away", "share", "place").agg(listed.alias("block")).drop("place")


def first_fuzzy_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left match the first right match (by position) with the same teams.

    left: id, home, away; right: pos, home, away. Both sides of a pair must be
    the same team. Names are resolved for distinct pairs, and the first position
    of each pair is taken before the rows are joined.
    """
    return left.select("id", "home", "away").join(first_of_pairs(left, right), ["home", "away"]).select("id", "home", "away", "pos", "r_home", "r_away")


def first_of_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(home, away, pos, r_home, r_away): the first right match of each distinct pair of names of left."""
    firsts = stored(right.groupBy("home", "away").agg(F.min("pos").alias("pos")))
    known = firsts.withColumnsRenamed({"home": "r_home", "away": "r_away"})
    best = matching_pairs(left, firsts).join(known, ["r_home", "r_away"]).groupBy("home", "away").agg(F.min(F.struct("pos", "r_home", "r_away")).alias("f"))
    return stored(best.select("home", "away", "f.*"))


def scored_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) of distinct names (left: a, right: b) with a resemblance: 2 if equal, 1 if one holds the other or a long word is common."""
    words = lambda df, c: _distinct(df, c, c).select(c, F.explode(F.array_distinct(N.long_words(F.col(c)))).alias("word"))
    equal = left.select("a").distinct().join(right.select("b").distinct(), F.col("a") == F.col("b")).select("a", "b")
    common = words(left, "a").join(words(right, "b"), "word").select("a", "b")
    met = equal.unionByName(contained_either_way(left, right)).unionByName(common).distinct()
    return met.withColumn("score", N.side_score(F.col("a"), F.col("b")))


def best_scored_match(left: DataFrame, right: DataFrame, least: int = 2, not_itself: bool = False) -> DataFrame:
    """Best right pair of each left pair by the two sides' scores, first position on ties.

    left: id, home, away; right: pos, home, away; names are normalised. Names are
    scored per side for distinct names and pairs are met for distinct pairs, of
    which two first positions are kept; rows are joined at the end. With
    not_itself a right match whose pos is the left one's id doesn't count.
    """
    side = lambda c: scored_names(left.select(F.col(c).alias("a")), right.select(F.col(c).alias("b"))).select(F.col("a").alias(c), F.col("b").alias(f"r_{c}"), F.col("score").alias(f"{c}_score"))
    home, away = side("home"), side("away")
    l = left.select("home", "away").distinct()  # noqa: E741
    lowest = right.groupBy("home", "away").agg(F.min("pos").alias("p"))
    if not_itself:
        later = right.join(lowest, ["home", "away"]).where(F.col("pos") > F.col("p")).groupBy("home", "away").agg(F.min("pos").alias("p"))
        lowest = lowest.unionByName(later)
    r = lowest.select(F.col("home").alias("r_home"), F.col("away").alias("r_away"), F.col("p").alias("pos"))
    # Both sides resemble, or one alone is enough.
    both = l.join(home, "home").join(away, "away").join(r, ["r_home", "r_away"])
    one_home = l.join(home.where(F.col("home_score") >= least), "home").join(r, "r_home").join(away, ["away", "r_away"], "left")
    one_away = l.join(away.where(F.col("away_score") >= least), "away").join(r, "r_away").join(home, ["home", "r_home"], "left")
    score = (F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))).alias("score")
    columns = ["home", "away", score, "pos"]
    met = both.select(*columns).unionByName(one_home.select(*columns)).unionByName(one_away.select(*columns)).where(F.col("score") >= least).distinct()
    best = W.partitionBy("home", "away").orderBy(F.desc("score"), "pos")
    ranked = met.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= (2 if not_itself else 1))
    rows = left.select("id", "home", "away").join(ranked, ["home", "away"])
    if not_itself:
        rows = rows.where(F.col("id") != F.col("pos"))
    found = rows.groupBy("id").agg(F.min(F.struct("rn", "pos", "score")).alias("b"))
    return found.select("id", F.col("b.pos").alias("pos"), F.col("b.score").cast("long").alias("score"))


def attach_odds(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Left join of predictions (id, home, away) with odds events (pos, home, away, odds...): exact key, else best scored match.

    The last event of each pair of names is taken before rows are joined, so a
    prediction never meets all events of its teams.
    """
    last = events.groupBy("home", "away").agg(F.max("pos").alias("pos"))
    exact = predictions.join(last, ["home", "away"]).groupBy("id").agg(F.max("pos").alias("pos"))
    rest = predictions.join(exact.select("id"), "id", "left_anti")
    matched = exact.unionByName(best_scored_match(rest, events.select("pos", "home", "away")).select("id", "pos"))
    odds = events.select("pos", F.struct(*[c for c in events.columns if c not in ("pos", "home", "away")]).alias("odds"))
    return predictions.join(matched, "id", "left").join(odds, "pos", "left").withColumn("available", F.col("odds").isNotNull())


def keep_new_matches(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of other (id, home, away) whose teams match no pair of base (pos, home, away)."""
    return other.join(first_of_pairs(other, base), ["home", "away"], "left_anti")


def pair_lookup(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Value of each pair of names by tier: 0 equal names, 1 equal first words, 2 one name inside the other, else none.

    queries: id, home, away; stored: home, away, value. Of several values of a
    tier the smallest is taken.
    """
    low = lambda df: df.select(*[c for c in df.columns if c not in ("home", "away")], F.lower("home").alias("h"), F.lower("away").alias("w"))
    q, s = low(queries.select("id", "home", "away")), low(stored).groupBy("h", "w").agg(F.min("value").alias("value"))
    first = lambda c: F.split(c, " ")[0]
    exact = q.join(s, ["h", "w"]).select("id", F.lit(0).alias("tier"), "value")
    word = lambda df: df.select(*[c for c in df.columns if c not in ("h", "w")], first("h").alias("fh"), first("w").alias("fw"))
    by_word = word(q).join(word(s).groupBy("fh", "fw").agg(F.min("value").alias("value")), ["fh", "fw"]).select("id", F.lit(1).alias("tier"), "value")
    open_pairs = q.join(exact.unionByName(by_word).select("id").distinct(), "id", "left_anti")
    hit = contained_names(open_pairs.select(F.explode(F.array("h", "w")).alias("name")), s.select(F.explode(F.array("h", "w")).alias("name")))
    inside = open_pairs.join(hit.select(F.col("a").alias("h"), F.col("b").alias("sh")), "h").join(hit.select(F.col("a").alias("w"), F.col("b").alias("sw")), "w")
    inside = inside.join(s.withColumnsRenamed({"h": "sh", "w": "sw"}), ["sh", "sw"]).select("id", F.lit(2).alias("tier"), "value")
    best = exact.unionByName(by_word).unionByName(inside).groupBy("id").agg(F.min(F.struct("tier", "value")).alias("b"))
    return queries.join(best, "id", "left").select(*queries.columns, F.col("b.tier").cast("long").alias("tier"), "b.value")


def contained_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct names of which one holds the other."""
    return contained_either_way(left.select(F.col("name").alias("a")), right.select(F.col("name").alias("b"))).distinct()


def tiered_lookup(left: DataFrame, *tiers: tuple[DataFrame, list[str]]) -> DataFrame:
    """Value of each left row from the first tier that has its keys; a tier is (table with value, keys)."""
    found = None
    for number, (rows, keys) in enumerate(tiers):
        hit = left.join(rows, keys).select("id", F.lit(number).alias("tier"), "value")
        found = hit if found is None else found.unionByName(hit)
    first = found.groupBy("id").agg(F.min(F.struct("tier", "value")).alias("best"))
    return left.join(first, "id", "left").select(*left.columns, F.col("best.tier").cast("long").alias("tier"), F.col("best.value").alias("value"))


def exact_then_partial(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Case-insensitive names, and only where none is found partial ones: first word, or the stored name inside the query."""
    q, s = queries.withColumn("key", F.lower("name")), stored.select(F.lower("name").alias("stored"))
    exact = q.join(s, F.col("key") == F.col("stored")).select("id", "stored", F.lit("exact").alias("how"))
    rest = q.join(exact.select("id").distinct(), "id", "left_anti")
    keys = rest.select("id", "key", F.split("key", " ")[0].alias("first"))
    # Names without a piece in common are never met; an empty first word is in all of them.
    inside = keys.join(containing(keys.select(F.col("first").alias("needle")), s.select(F.col("stored").alias("hay"))), F.col("first") == F.col("needle")).select("id", F.col("hay").alias("stored"))
    around = keys.join(containing(s.select(F.col("stored").alias("needle")), keys.select(F.col("key").alias("hay"))), F.col("key") == F.col("hay")).select("id", F.col("needle").alias("stored"))
    partial = inside.unionByName(around)
    return exact.unionByName(partial.select("id", "stored", F.lit("partial").alias("how")).distinct())
