"""Compiling lists of query parameters to strip from published records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkquarry.functions import whatwg


def _ordered(records: DataFrame, values: str) -> DataFrame:
    """First occurrences, case folded, of a list column's values, newest record first and then by id."""
    rows = records.filter(~F.coalesce("deleted", F.lit(False))).select("id", "last_modified", F.posexplode(values).alias("pos", "raw")).withColumn("value", F.lower("raw"))
    order = (F.desc("last_modified"), F.asc("id"), F.asc("pos"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("value").orderBy(*order))).filter("k = 1")
    # A published list is a few hundred values, so one window numbers it.
    return first.select("value", F.row_number().over(Window.orderBy(*order)).alias("position"))


def compile_parameters(records: DataFrame) -> DataFrame:
    """(value, position) of parameters to strip."""
    return _ordered(records, "stripList")


def compile_domains(records: DataFrame) -> DataFrame:
    """(value, position) of spared base domains; ``check_domain`` vets them on the driver."""
    return _ordered(records, "allowList")


def check_domain(value: str) -> str:
    """The lower-case domain, or ValueError where it isn't its own serialised host."""
    low = value.lower()
    try:
        sound = "@" not in low and whatwg.parse(f"https://{low}/").host == low
    except whatwg.InvalidUrl:
        sound = False
    if not sound:
        raise ValueError(f"allowList contains invalid domain {value!r}")
    return low


def compile_rules(records: DataFrame) -> dict[str, list[str]]:
    """Both lists; no active record or no parameter is an error."""
    if records.limit(1).count() == 0:
        raise ValueError("there are no records")
    strip = [r["value"] for r in compile_parameters(records).orderBy("position").collect()]
    if not strip:
        raise ValueError("there are no parameters to strip")
    return {"strip_parameters": strip, "allow_base_domains": [check_domain(r["value"]) for r in compile_domains(records).orderBy("position").collect()]}
