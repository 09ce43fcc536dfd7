"""Names of soils and rocks: cleaning, display detail, modelling group, colour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that must read as the same soil, in the vocabulary of the logs.
SOIL_DETAIL = {
    "토사": "토사", "표토": "토사", "토층": "토사",
    "매립층": "매립토", "매립토": "매립토", "되메움": "매립토",
    "퇴적층": "퇴적토", "퇴적토": "퇴적토",
    "충적층": "충적토", "충적토": "충적토",
    "붕적층": "붕적토", "붕적토": "붕적토",
    "풍화토": "풍화토", "잔류토": "풍화토",
    "퇴적점토": "퇴적점토", "퇴적모래": "퇴적모래", "퇴적자갈": "퇴적자갈",
    "점성토": "점토", "점토": "점토", "실트": "실트",
    "사질토": "모래", "모래": "모래", "역질토": "자갈", "자갈": "자갈",
    "유기질토": "유기질토", "이탄": "유기질토", "부식토": "유기질토",
    "사질점토": "사질점토", "점토질모래": "점토질모래",
    "CL": "점토", "CH": "점토", "ML": "실트", "MH": "실트",
    "SW": "모래", "SP": "모래", "SM": "모래", "SC": "모래",
    "GW": "자갈", "GP": "자갈", "GM": "자갈", "GC": "자갈",
    "OL": "유기질토", "OH": "유기질토", "PT": "유기질토",
}
# Rocks, groups, labels and colours.
ROCKS = {
    "풍화암": "weathered_rock", "풍화대": "weathered_rock", "풍화기반암": "weathered_rock",
    "연암": "soft_rock", "리핑암": "soft_rock", "보통암": "normal_rock",
    "경암": "hard_rock", "발파암": "hard_rock", "극경암": "hard_rock", "화강암": "hard_rock",
}
GROUPS = ("soil", "weathered_rock", "soft_rock", "normal_rock", "hard_rock", "unknown")
GROUP_LABELS = {"soil": "토사", "weathered_rock": "풍화암", "soft_rock": "연암", "normal_rock": "보통암", "hard_rock": "경암"}
UNCLASSIFIED = "미분류"
COLORS = {"soil": "#8B7355", "weathered_rock": "#C4A57B", "soft_rock": "#6B8E5A", "normal_rock": "#5F6552", "hard_rock": "#3D3D3D", "unknown": "#B4B4B4"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """A map literal's value, or null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def longest_contained(table: dict[str, str], text: Column) -> Column:
    """The value of the longest key that text contains; of equal lengths, the first in the table."""
    by_length = sorted(table.items(), key=lambda item: -len(item[0]))
    return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in by_length]) if by_length else F.lit(None).cast("string")


def cleaned(raw: Column) -> Column:
    """Without white space and what stands in round brackets; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", ""), r"\(.*?\)", "")


def soil_detail(raw: Column) -> Column:
    """Display name of a soil, or null for what isn't one."""
    text = cleaned(raw)
    beyond_ascii = {k: v for k, v in SOIL_DETAIL.items() if not k.isascii()}
    return F.coalesce(lookup(SOIL_DETAIL, F.upper(text)), lookup(SOIL_DETAIL, text), longest_contained(beyond_ascii, text))


def strata_group(raw: Column) -> Column:
    """Modelling group; a group's own code passes, soils come before rocks."""
    code = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(code.isin(*GROUPS), code).when(soil_detail(raw).isNotNull(), F.lit("soil")).otherwise(F.coalesce(longest_contained(ROCKS, cleaned(raw)), F.lit("unknown")))


def display_name(raw: Column) -> Column:
    """Soil detail, else the group's label, else the text itself, else a label for nothing."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(soil_detail(raw), lookup(GROUP_LABELS, strata_group(raw)), F.when(text != "", text), F.lit(UNCLASSIFIED))


def color(raw: Column) -> Column:
    return lookup(COLORS, strata_group(raw))


def duplicate_key(name: Column) -> Column:
    """Upper-case A-Z and 0-9 alone. Names in other scripts have an empty key and so agree with each other."""
    return F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]", "")


def survey_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "))


def same_survey(a: Column, b: Column, allow_missing: bool = False) -> Column:
    same = survey_key(a) == survey_key(b)
    return same | (survey_key(a) == "") | (survey_key(b) == "") if allow_missing else same


def natural_key(name: Column, width: int = 12) -> Column:
    """A key whose order reads runs of digits as numbers: each run is padded to `width` digits."""
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "")


def source_path(path: Column, root: str, mounted: str) -> Column:
    """A path below a foreign root, with either slash, as one below `mounted`."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    at = root.replace("\\", "/").rstrip("/")
    return F.when(F.lower(plain).startswith(at.lower()), F.concat(F.lit(mounted), F.substring(plain, len(at) + 1, 1 << 30))).otherwise(plain)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
