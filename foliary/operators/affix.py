"""Dictionary expansion: stems and affix rules to surface forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import rows_within
from foliary.settings import DEFAULTS, Settings


def _applied(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Words (surface, flag, ...) with every rule of their flag that fits, as new surfaces."""
    surface, strip, affix = F.col("surface"), F.col("strip"), F.col("affix")
    keep = F.length(surface) - F.length(strip)
    suffixed = F.concat(F.substring(surface, F.lit(1), keep), affix)
    prefixed = F.concat(affix, F.substring(surface, F.length(strip) + 1, F.length(surface)))
    at_end = surface.endswith(strip) & F.rlike(surface, F.concat("cond", F.lit("$")))
    at_start = surface.startswith(strip) & F.rlike(surface, F.concat(F.lit("^"), "cond"))
    is_suffix = F.col("kind") == "SFX"
    return (
        words.join(rules, "flag")
        .filter(F.when(is_suffix, at_end).otherwise(at_start))
        .withColumn("surface", F.when(is_suffix, suffixed).otherwise(prefixed))
    )


def expand_dictionary(
    stems: DataFrame,
    affixes: DataFrame,
    forbidden: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(surface, lemma): every form the rules derive from the stems, and the stems themselves.

    `stems` has stem and flags (array); `affixes` has flag, kind (SFX or PFX), cross, strip,
    affix, cont (array of flags the new form takes on) and cond. A form takes up to two
    suffixes, the second by a continuation flag, and one prefix, by a flag of the stem if both
    rules combine (`cross`) or by a continuation flag. Stems with the forbidden flag are left
    out.
    """
    if forbidden:
        stems = stems.filter(~F.array_contains("flags", forbidden))
    if rows_within(affixes, settings.broadcast_rows):
        affixes = F.broadcast(affixes)
    suffixes, prefixes = affixes.filter("kind = 'SFX'"), affixes.filter("kind = 'PFX'")
    none = F.array().cast("array<string>")

    def form(surface: Column, stem_flags: Column, own_flags: Column) -> list[Column]:
        # stem_flags reach a form only through cross rules, own_flags directly.
        return [
            F.col("lemma"),
            surface.alias("surface"),
            stem_flags.alias("stem_flags"),
            own_flags.alias("own_flags"),
        ]

    words = stems.select(F.col("stem").alias("lemma"), F.col("stem").alias("surface"), "flags")
    bare = words.select(*form(F.col("surface"), none, F.col("flags")))
    once = _applied(words.withColumn("flag", F.explode("flags")), suffixes).select(
        *form(F.col("surface"), F.when(F.col("cross"), F.col("flags")).otherwise(none), F.col("cont"))
    )
    twice = _applied(once.withColumn("flag", F.explode("own_flags")), suffixes).select(
        *form(
            F.col("surface"),
            F.when(F.col("cross"), F.col("stem_flags")).otherwise(none),
            F.col("cont"),
        )
    )
    forms = bare.unionByName(once).unionByName(twice)
    flags = F.concat(
        F.transform("own_flags", lambda f: F.struct(f.alias("flag"), F.lit(False).alias("far"))),
        F.transform("stem_flags", lambda f: F.struct(f.alias("flag"), F.lit(True).alias("far"))),
    )
    with_flag = forms.select("lemma", "surface", F.explode(flags).alias("_flag")).select(
        "lemma", "surface", "_flag.flag", "_flag.far"
    )
    prefixed = _applied(with_flag, prefixes).filter("cross OR NOT far")
    both = forms.select("surface", "lemma").unionByName(prefixed.select("surface", "lemma"))
    return both.distinct()
