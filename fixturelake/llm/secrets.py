"""Secret scans by a trigram inverted index.

Each rule's regex is turned into a Boolean trigram query: an OR of
alternatives, each an AND of the trigrams that any match must hold. The index
holds, as rows (trigram, document), the postings of every trigram that some
query asks for; others could never be looked up. Postings are intersected per
alternative by an equi-join with the queries and a count per document. Only
documents in the result of a rule's query are verified with its regex. Rules
without a mandatory trigram scan all texts.

Scale: postings of one document come from one task, so the count is combined
before the shuffle and no posting list is gathered in one place. The result of
the intersection, pairs of a document's 64-bit key (id and text) and a rule, is
sent to the texts as a table of bits: a document's slot is its key modulo the
number of slots, with a bit for each rule. ``MOST_SLOTS`` bounds the table, so
it can be broadcast; no text is moved or joined with its key. Documents that
share a slot only add candidates, which verification settles: a full table
costs time, never a result.

Defined results: a null text counts as empty; a null id is a valid id; repeated
rows give repeated results; columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as _c
from re import _parser as _p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import let, materialise


@dataclass(frozen=True)
class Rule:
    """``measured``: the group whose length must reach ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    measured: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # Runs of under 16 can never count, so the bound may stand in the pattern.
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: Alternatives that a pattern may be expanded to before its literals are given up.
MOST_ALTERNATIVES = 64

#: Bytes of one bitmap, as bitmap_construct_agg makes them.
MAP_BYTES = 4096
SLOTS_PER_CANDIDATE = 16
#: Slots of the table of candidates that is broadcast: 64 MB with up to eight rules.
MOST_SLOTS = 1 << 26


def _pieces(node) -> list[tuple]:
    """Alternatives of a parsed pattern; each is a tuple of literals, None where anything may stand."""
    out: list[tuple] = [()]
    for op, value in node:
        if op is _c.LITERAL:
            here = [(chr(value),)]
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in value) and len(value) <= 8:
            here = [(chr(v),) for _, v in value]
        elif op is _c.SUBPATTERN:
            here = _pieces(value[-1])
        elif op is _c.BRANCH:
            here = [x for branch in value[1] for x in _pieces(branch)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = value
            once = _pieces(inner)
            here = [()] + once if (low, high) == (0, 1) else [(None,)] if low == 0 else [x + (None,) * (high != 1) for x in once]
        elif op is _c.AT:
            continue
        else:
            here = [(None,)]
        if len(out) * len(here) > MOST_ALTERNATIVES:
            here = [(None,)]
        out = [a + b for a in out for b in here]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; empty if some match needs no trigram at all."""
    found = set()
    for alternative in _pieces(_p.parse(pattern)):
        runs = "".join("\0" if x is None else x for x in alternative).lower().split("\0")
        found.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in found:
        return []
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (trigram, doc) of the index: which asked-for trigrams each document holds."""
    asked = sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})
    listed = F.split(F.lit("\n".join(asked)), "\n")
    held = let(F.lower(F.coalesce("text", F.lit(""))), lambda low: F.filter(listed, lambda t: F.contains(low, t)))
    return docs.select(F.explode(held).alias("trigram"), _key().alias("doc"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc, rule): the rule's trigram query holds for the document; one row at least per such pair."""
    spark = docs.sparkSession
    asked = [(i, n, len(a), t) for i, r in enumerate(rules) for n, a in enumerate(trigram_query(r.pattern)) for t in sorted(a)]
    if not asked:
        return spark.createDataFrame([], "doc long, rule int")
    listed = F.split(F.lit("\n".join(f"{i},{n},{k},{t}" for i, n, k, t in asked)), "\n")
    query = spark.range(1).select(F.explode(listed).alias("q")).select(
        F.split("q", ",", 4)[0].cast("int").alias("rule"),
        F.split("q", ",", 4)[1].cast("int").alias("part"),
        F.split("q", ",", 4)[2].cast("int").alias("needed"),
        F.split("q", ",", 4)[3].alias("trigram"),
    )
    # As many rows as the rules have trigrams: a fixed bound.
    return (
        postings(docs, rules)
        .join(F.broadcast(query), "trigram")
        .groupBy("doc", "rule", "part", "needed")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") >= F.col("needed"))
        .select("doc", "rule")
    )


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, in code points.

    Starts are running sums over the gaps and matches, worked out in stretches of about the square root of their
    number: the sums of stretches first, then those inside each, so no long array grows match by match.
    """
    gaps = F.split(text, rule.pattern)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))
    each = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(part, F.length).alias("part")
    )
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    width = lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))

    def inside(stretch: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + width(x)).alias("at"),
            F.when(
                x["part"] >= max(rule.least, 1),
                F.concat(a["found"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end")))),
            )
            .otherwise(a["found"])
            .alias("found"),
        )
        return F.aggregate(stretch, F.struct(start.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def from_all(every: Column) -> Column:
        long = F.ceil(F.sqrt(F.size(every))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(every), long), lambda i: F.slice(every, i, long)), from_stretches)

    def from_stretches(stretches: Column) -> Column:
        total = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + width(x))
        sums = F.aggregate(
            stretches,
            F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("starts")),
            lambda a, s: F.struct((a["at"] + total(s)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
            lambda a: a["starts"],
        )
        return F.flatten(F.zip_with(stretches, sums, inside))

    return let(each, from_all)


def slot_table(found: DataFrame, slots: int, width: int) -> DataFrame:
    """Rows (place, bits): bitmaps of ``MAP_BYTES`` bytes, in which each slot has ``width`` bytes with a bit per rule; found: doc, rule."""
    bit = F.pmod("doc", F.lit(slots).cast("long")) * (8 * width) + F.col("rule")
    each = found.select((bit / (8 * MAP_BYTES)).cast("long").alias("place"), F.pmod(bit, F.lit(8 * MAP_BYTES)).alias("bit"))
    return each.groupBy("place").agg(F.bitmap_construct_agg("bit").alias("bits"))


def slot_bits(bits: Column, at: Column, width: int) -> Column:
    """The bits of a slot that begins at a byte (from 0) of a bitmap; 0 without a bitmap."""
    one = lambda k: F.coalesce(F.conv(F.hex(F.substring(bits, at + (k + 1), F.lit(1))), 16, 10).cast("long"), F.lit(0).cast("long"))
    return reduce(Column.bitwiseOR, [F.shiftleft(one(k), 8 * k) for k in range(width)])


def flagged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_slots: int = MOST_SLOTS) -> DataFrame:
    """docs with the column bits: the rules to verify on each text; at most 64 rules."""
    full = F.lit(sum(1 << i for i, r in enumerate(rules) if not trigram_query(r.pattern))).cast("long")
    width = 1 << max(0, (-(-len(rules) // 8) - 1).bit_length())  # a power of two, so that no slot lies in two bitmaps
    found = materialise(candidates(docs.select("doc_id", "text"), rules), "candidates")
    slots = min(most_slots, max(MAP_BYTES, 1 << (SLOTS_PER_CANDIDATE * found.count()).bit_length()))
    own = F.pmod(_key(), F.lit(slots).cast("long")) * width
    placed = docs.withColumn("_own", own).withColumn("place", (F.col("_own") / MAP_BYTES).cast("long"))
    # At most most_slots * width / MAP_BYTES rows of MAP_BYTES bytes: a fixed bound.
    joined = placed.join(F.broadcast(slot_table(found, slots, width).withColumnRenamed("bits", "_map")), "place", "left")
    at = F.pmod("_own", F.lit(MAP_BYTES)).cast("int")
    return joined.withColumn("bits", slot_bits(F.col("_map"), at, width).bitwiseOR(full)).drop("_own", "place", "_map")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, text and an array of (kind, start, end) for each rule, named as the rule."""
    marked = flagged(docs.select("doc_id", "text"), rules)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    text = F.coalesce("text", F.lit(""))
    found = [
        F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, _spans(text, r)).otherwise(none).alias(r.kind)
        for i, r in enumerate(rules)
    ]
    return marked.select("doc_id", "text", *found)


def _joined(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then rule order, joined by commas."""

    def named(i: int, kind: str) -> Column:
        return F.transform(
            F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    each = [named(i, r.kind) for i, r in enumerate(rules)]
    return F.array_join(
        F.transform(
            F.sort_array(F.concat(*each)),
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def _masked(rule: Rule, mask: str) -> Column:
    """The column text with the rule's matches replaced."""
    parts = F.arrays_zip(
        F.split("text", rule.pattern).alias("gap"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.measured)).alias("part"),
    )
    put = lambda x: F.when(F.length(x["part"]) >= max(rule.least, 1), F.lit(mask)).otherwise(F.coalesce(x["all"], F.lit("")))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], put(x))), "")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mask, rule after rule; n_chars, if there, follows the new text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = flagged(docs.select("doc_id", "text", row.alias("row")), rules)
    for i, r in enumerate(rules):
        hit = F.col("text").isNotNull() & (F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0)
        out = out.withColumn("text", F.when(hit, _masked(r, mask)).otherwise(F.col("text")))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withField("n_chars", F.coalesce(F.length("text").cast(kind), F.col("row.n_chars")))
    return out.select(new.alias("row")).select("row.*")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_spans(docs).select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(RULES).alias("spans"),
    )
