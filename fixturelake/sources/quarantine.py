"""Broken payloads: good records kept, the others with a reason.

A payload is first cut into its records, so one cut, mistyped or wrongly
delimited record costs itself only. Every record comes out once, with reason null
or with its text and one of the reasons ``cut``, ``type``, ``delimiter`` and
``missing <field>``; a payload without any record comes out as ``empty``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _missing(record: Column, required: tuple[str, ...]) -> Column:
    """'missing <field>' of the first required field without a value, else null."""
    return F.coalesce(*[F.when(record[c].isNull(), F.lit(f"missing {c}")) for c in required], F.lit(None).cast("string"))


def json_records(bodies: DataFrame, schema: T.StructType | str, start: str, required: tuple[str, ...] = (), body: str = "body") -> DataFrame:
    """The columns of bodies but the text itself, with number, record, raw and reason of each record.

    ``start`` is the text that every record begins with, such as ``{"id":``. Records are parsed one by one and leniently:
    a field of another type makes the record bad, not the feed.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    text = F.coalesce(F.col(body), F.lit(""))
    cut = F.filter(F.split(text, "(?=" + _quoted(start) + ")"), lambda x: F.startswith(x, F.lit(start)))
    rest = [c for c in bodies.columns if c != body]
    each = bodies.select(*rest, text.alias("_body"), F.posexplode_outer(cut).alias("number", "raw"))
    parsed = F.from_json("raw", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = each.withColumn("_r", parsed)
    unbalanced = F.size(F.split("raw", r"\{")) > F.size(F.split("raw", r"\}"))
    reason = (
        F.when(F.col("raw").isNull(), "empty")
        .when(F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull(), F.when(unbalanced, "cut").otherwise("type"))
        .otherwise(_missing(F.col("_r"), required))
    )
    out = out.withColumn("reason", reason)
    record = F.when(F.col("reason").isNull(), F.struct(*[F.col(f"_r.{f.name}") for f in fields])).alias("record")
    return out.select(*rest, "number", record, F.when(F.col("reason").isNotNull(), F.coalesce("raw", "_body")).alias("raw"), "reason")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


def delimited_records(feeds: DataFrame, required: tuple[str, ...], numbers: tuple[str, ...] = (), raw: str = "raw", record: str = "~", field: str = "¬", value: str = "÷") -> DataFrame:
    """Records of delimited feeds: the columns of feeds but the text, with number, record (a map), raw and reason.

    ``required`` keys must be there and ``numbers`` hold whole numbers, where they are.
    """
    rest = [c for c in feeds.columns if c != raw]
    text = F.coalesce(F.col(raw), F.lit(""))
    cut = F.filter(F.split(text, record), lambda x: x != "")
    each = feeds.select(*rest, text.alias("_body"), F.posexplode_outer(cut).alias("number", "_text"))
    pairs = F.filter(F.transform(F.split("_text", field), lambda x: F.split(x, value, 2)), lambda x: F.size(x) == 2)
    # The last one of a repeated key counts.
    known = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x[0])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda x: x[0] == k), -1)[1])))
    out = each.withColumn("_r", known)
    wrong = F.coalesce(*[F.when(F.try_element_at("_r", F.lit(c)).isNotNull() & ~F.rlike(F.try_element_at("_r", F.lit(c)), F.lit(r"^-?\d+$")), F.lit("type")) for c in numbers], F.lit(None).cast("string"))
    missing = F.coalesce(*[F.when(F.try_element_at("_r", F.lit(c)).isNull(), F.lit(f"missing {c}")) for c in required], F.lit(None).cast("string"))
    reason = F.when(F.col("_text").isNull(), "empty").when(F.size("_r") == 0, "delimiter").otherwise(F.coalesce(missing, wrong))
    out = out.withColumn("reason", reason)
    return out.select(*rest, "number", F.when(F.col("reason").isNull(), F.col("_r")).alias("record"), F.when(F.col("reason").isNotNull(), F.coalesce("_text", "_body")).alias("raw"), "reason")


def good(records: DataFrame) -> DataFrame:
    """The good records' fields beside the payload's columns."""
    return records.where(F.col("reason").isNull()).drop("raw", "reason")


def write_bad(records: DataFrame, path: str) -> None:
    """Append the bad records, one folder per reason."""
    records.where(F.col("reason").isNotNull()).drop("record").write.mode("append").partitionBy("reason").parquet(path)
