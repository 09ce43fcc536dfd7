"""How well texts of one box of a page read, as numbers or as names, and which of several readings to take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrakern.functions.geodesy import let
from terrakern.functions.text import read_name

# Fields of numbers, of soils and of other names; the names that count in a soil's text, a longer one before what it holds.
NUMBERS = ("depth", "bottom_depth", "top_depth", "x_coord", "y_coord", "tm_x", "tm_y", "elevation", "water_level_gl", "water_level_el")
SOILS, NAMES = ("stratum_name", "soil_type"), ("project_name", "borehole_name", "crs", "coordinates")
TOKENS = "유기질토|점토질모래|사질점토|매립층|매립토|퇴적층|퇴적토|충적층|충적토|풍화토|잔류토|점성토|점토|실트|사질토|모래|역질토|자갈|풍화암|보통암|리핑암|발파암|화강암|연암|경암|토사"
_SPACE = r"(?U)\s+"


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def _lines(text: Column) -> Column:
    """Lines that aren't blank, trimmed; a carriage return ends a line too."""
    return F.filter(F.transform(F.split(text, r"[\r\n]"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda v: v != "")


def numeric_score(text: Column) -> Column:
    """10 for each number and 1 for each of the first 20 characters, 5 less where a number goes on in the next line."""
    numbers = F.regexp_count(text, F.lit(r"(?U)[-+]?\d+(?:[,.]\d+)?"))
    return numbers * 10 + F.least(F.length(text), F.lit(20)) - F.when(text.rlike(r"(?U)\d\s*\n\s*\d"), 5).otherwise(0)


def soil_score(text: Column) -> Column:
    """20 for each known name, 10 for each line that is one, 1 for each line that isn't the common name and for each of the first 30
    characters, 3 less for each line of one character. White space doesn't count."""
    return let(F.struct(_tight(text).alias("tight"), _lines(text).alias("lines")), lambda v: _soil_score(v["tight"], v["lines"]))


def _soil_score(tight: Column, lines: Column) -> Column:
    whole = F.size(F.filter(lines, lambda v: _tight(v).rlike(f"^({TOKENS})$")))
    single = F.size(F.filter(lines, lambda v: F.length(_tight(v)) == 1))
    return F.regexp_count(tight, F.lit(f"({TOKENS})")) * 20 + whole * 10 + _named(lines) - single * 3 + F.least(F.length(tight), F.lit(30))


def _named(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda v: read_name(v, compatible_already=True) != "토사"))


def general_score(text: Column) -> Column:
    """A point a character that isn't white space, 10 for a letter or digit, 20 less for a character that couldn't be read."""
    known = F.when(text.rlike("[가-힣A-Za-z0-9]"), 10).otherwise(0)
    return F.length(_tight(text)) + known - F.when(text.contains("�"), 20).otherwise(0)


def best_text(readings: list[Column], field: Column) -> Column:
    """The best of several readings of a box by the kind of its field, of equal ones the first; blank ones don't count, and without any
    the text is empty. For a field of no known kind the first reading is taken, or what is the only one."""
    kind = F.lower(field)
    score = lambda t: F.when(kind.isin(*NUMBERS), numeric_score(t)).when(kind.isin(*SOILS), soil_score(t)).when(kind.isin(*NAMES), general_score(t))
    trimmed = F.transform(F.array(*readings), lambda r: F.regexp_replace(F.coalesce(r, F.lit("")), r"(?U)^\s+|\s+$", ""))
    scored = F.transform(trimmed, lambda t, n: F.struct(score(t).alias("score"), (-n).alias("first"), t.alias("text")))

    def best(all_: Column) -> Column:
        some = F.filter(all_, lambda r: r["text"] != "")
        known = F.coalesce(kind.isin(*NUMBERS, *SOILS, *NAMES), F.lit(False))
        return F.when(known | (F.size(some) < 2), F.array_max(some)["text"]).otherwise(F.get(all_, F.lit(0))["text"])

    return F.coalesce(let(scored, best), F.lit(""))
