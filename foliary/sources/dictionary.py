"""Dictionary files as frames: affix rules and stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_affixes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(flag, kind, cross, strip, affix, cont, cond) of a Hunspell affix file.

    Flags are single characters. `0` stands for nothing to strip or add.
    """
    fields = F.split(F.regexp_replace(F.btrim("value"), r"\s+", " "), " ")
    lines = (
        spark.read.option("encoding", encoding)
        .text(path)
        .filter(F.col("value").rlike(r"^\s*(SFX|PFX)\s"))
        .select(fields.alias("f"))
    )
    heads = lines.filter(F.get("f", F.lit(2)).isin("Y", "N") & (F.size("f") == 4)).select(
        F.get("f", F.lit(0)).alias("kind"),
        F.get("f", F.lit(1)).alias("flag"),
        (F.get("f", F.lit(2)) == "Y").alias("cross"),
    )
    added = F.split(F.get("f", F.lit(3)), "/")
    bare = F.get(added, F.lit(0))
    strip = F.get("f", F.lit(2))
    rules = lines.filter(F.size("f") > 4).select(
        F.get("f", F.lit(0)).alias("kind"),
        F.get("f", F.lit(1)).alias("flag"),
        F.when(strip == "0", "").otherwise(strip).alias("strip"),
        F.when(bare == "0", "").otherwise(bare).alias("affix"),
        F.coalesce(
            F.split(F.get(added, F.lit(1)), ""), F.array().cast("array<string>")
        ).alias("cont"),
        F.get("f", F.lit(4)).alias("cond"),
    )
    return rules.join(heads, ["kind", "flag"])


def read_stems(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(stem, flags) of a Hunspell word list; its first line, the word count, is left out."""
    parts = F.split(F.regexp_extract("value", r"^\s*(\S+)", 1), "/")
    flags = F.split(F.get(parts, F.lit(1)), "")
    return (
        spark.read.option("encoding", encoding)
        .text(path)
        .filter(~F.col("value").rlike(r"^\s*[0-9]*\s*$"))
        .select(
            F.get(parts, F.lit(0)).alias("stem"),
            F.coalesce(flags, F.array().cast("array<string>")).alias("flags"),
        )
    )
