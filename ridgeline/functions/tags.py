"""Way tags: highway classes and hiking difficulty, as array expressions.

Tags are arrays of strings. A null array means untagged; an empty one has no class and no rank.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highway values that make a way a trail, or a road that may connect trails.
TRAIL_HIGHWAYS = ("path", "footway", "track", "steps", "bridleway")
ROAD_HIGHWAYS = ("residential", "unclassified", "service", "living_street", "tertiary")

#: Difficulty names by rank, T1 to T6.
SAC_RANKS = (
    "hiking",
    "mountain_hiking",
    "demanding_mountain_hiking",
    "alpine_hiking",
    "demanding_alpine_hiking",
    "difficult_alpine_hiking",
)


def has_trail(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.trim(t).isin(*TRAIL_HIGHWAYS)), F.lit(False))


def has_road(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.trim(t).isin(*ROAD_HIGHWAYS)), F.lit(False))


def highway_class(tags: Column, had_non_string: Column | None = None) -> Column:
    """'trail' if any tag is one; else 'connector' if all are roads and none was not a string; else null."""
    pure = F.coalesce((F.size(tags) > 0) & F.forall(tags, lambda t: F.trim(t).isin(*ROAD_HIGHWAYS)), F.lit(False))
    if had_non_string is not None:
        pure &= ~F.coalesce(had_non_string, F.lit(False))
    return F.when(has_trail(tags), "trail").when(pure, "connector")


def sac_rank(tags: Column) -> Column:
    """Largest rank 1 to 6; null if untagged, empty, or any member is unknown."""
    names = F.array(*[F.lit(name) for name in SAC_RANKS])
    ranks = F.transform(tags, lambda t: F.array_position(names, F.trim(t)).cast("int"))
    known = (F.size(tags) > 0) & F.forall(ranks, lambda r: F.coalesce(r > 0, F.lit(False)))
    return F.when(known, F.array_max(ranks))


def sac_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in SAC_RANKS]), rank - 1)


def difficulty_cap(text: str) -> int:
    """Rank of a cap such as ' t4 '."""
    hit = re.fullmatch(r"T([1-6])", text.strip().upper())
    if not hit:
        raise ValueError(f"unknown difficulty cap {text!r}: T1 to T6 are allowed")
    return int(hit[1])


def cap_rank(text: Column) -> Column:
    """The same as a column; null where the text is no cap."""
    return F.regexp_extract(F.upper(F.trim(text)), "^T([1-6])$", 1).try_cast("int")


def keep_way(highway: Column, sac: Column, cap: int, keep_untagged: bool, had_non_string: Column | None = None) -> Column:
    """Whether a way stays in the network under a difficulty cap.

    Trails need a known rank up to the cap (or, untagged, the policy's leave);
    connectors are dropped only for a known rank over it.
    """
    kind, rank = highway_class(highway, had_non_string), sac_rank(sac)
    trail = F.when(sac.isNull(), F.lit(keep_untagged)).otherwise(F.coalesce(rank <= cap, F.lit(False)))
    return F.when(kind == "trail", trail).when(kind == "connector", rank.isNull() | (rank <= cap)).otherwise(F.lit(False))


def descends_over(cap: float | None, d_plus: Column, d_minus: Column, grade: Column) -> Column:
    """Whether a traversal loses height on balance and is steeper than the cap (none: never)."""
    if cap is None:
        return F.lit(False)
    return F.coalesce((d_minus > d_plus) & (F.coalesce(grade, F.lit(0.0)) > cap), F.lit(False))


def tag_list(raw: Column) -> Column:
    """A tag's texts, from JSON that holds one value or a list: (values, had_non_string). Values that aren't texts go and are told; null has none."""
    parsed = F.try_parse_json(raw)
    items = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.when(parsed.isNotNull(), F.array(parsed)))
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    values = F.transform(F.filter(items, is_text), lambda x: F.try_variant_get(x, "$", "string"))
    return F.struct(F.coalesce(values, F.array().cast("array<string>")).alias("values"), F.coalesce(F.exists(items, lambda x: ~is_text(x)), F.lit(False)).alias("had_non_string"))
