"""Reading numbers, coordinate systems and roles out of cells of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING = ("", "-", "—", "N/A", "na", "NA")
EPSG_CODES = ("5186", "5187", "5181", "5183", "5174", "5176", "4326")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(cell: Column) -> Column:
    """A finite number, thousands' commas allowed; null for blanks, dashes and text."""
    text = F.trim(cell)
    return F.when(~text.isin(*MISSING), finite(F.replace(text, F.lit(","), F.lit("")).try_cast("double")))


def last_depth(cell: Column) -> Column:
    """The last number of a depth cell such as 0.0~2.5: what stands right of the mark."""
    right = F.element_at(F.split(F.coalesce(cell, F.lit("")), "~"), -1)
    found = F.regexp_extract_all(right, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).try_cast("double"))


# How depths are written in a cell, a comma being a point and the letter O a zero.
DEPTHS = r"[-+]?(?:[0-9]+(?:[,.][0-9]+)?|[,.]\s*[0-9]+)"


def depth_values(cell: Column) -> Column:
    """All numbers of a depth cell, in order, such as those of 25 and 30.5 on two lines of it; none of a null cell."""
    found = F.regexp_extract_all(F.translate(F.coalesce(cell, F.lit("")), "Oo", "00"), F.lit(DEPTHS), F.lit(0))
    numbers = F.transform(found, lambda t: F.regexp_replace(F.replace(F.regexp_replace(t, r"\s+", ""), F.lit(","), F.lit(".")), r"^\+", "").try_cast("double"))
    return F.array_compact(numbers)


def tm_scale(value: Column) -> tuple[Column, Column]:
    """A grid coordinate whose point is a place off, and whether it was: only if a tenth lands in the supported range."""
    tenth = value / 10.0
    off = (F.abs(value) >= 1_000_000) & F.abs(tenth).between(50_000, 800_000)
    return F.when(off, tenth).otherwise(value), F.coalesce(off, F.lit(False))


def crs_of_remark(remark: Column, year: Column | None = None) -> Column:
    """EPSG code of a belt and false northing written in a remark, or null.

    The later datum has one code for a belt. The earlier northing was used with two datums: a word for either decides, then
    the year of the survey (2003 brought the new one), then the new one.
    """
    # The words and patterns below are how remarks name belts, northings and datums.
    t = F.lower(F.replace(F.coalesce(remark, F.lit("")), F.lit(" "), F.lit("")))
    east = ~t.contains("중부") & t.contains("동부")
    known = t.contains("중부") | t.contains("동부")
    late, early = t.rlike("60만|600,?000"), t.rlike("50만|500,?000")
    old, new = t.rlike("bessel|베셀|지적|동경|tokyo|1985"), t.rlike("grs80|세계측지계|kgd|2000|2002")
    y = F.trim(year.cast("string")).try_cast("double") if year is not None else F.lit(None).cast("double")
    bessel = (old & ~new) | (~(new & ~old) & F.coalesce(F.floor(y) < 2003, F.lit(False)))

    def pick(central: str, eastern: str) -> Column:
        return F.when(east, F.lit(f"EPSG:{eastern}")).otherwise(F.lit(f"EPSG:{central}"))

    return F.when(known & late, pick("5186", "5187")).when(known & early & bessel, pick("5174", "5176")).when(known & early, pick("5181", "5183"))


def crs_hint(value: Column, year: Column | None = None) -> Column:
    """EPSG code of a cell: a supported code, WGS84 by name, or a remark. A year in a remark is no code."""
    text = F.trim(F.coalesce(value, F.lit("")))
    code = F.regexp_extract(text, "(" + "|".join(EPSG_CODES) + ")", 1)
    wgs = F.upper(text).contains("WGS84") | text.contains("경위도")
    return F.when(code != "", F.concat(F.lit("EPSG:"), code)).when(wgs, F.lit("EPSG:4326")).otherwise(crs_of_remark(text, year))


def file_key(kind: str, value: Column) -> Column:
    """Key of an observation: by job and hole, or by the digest of its source."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(value, 256) if kind == "source" else value)


def box_of(text: Column, point: bool = False) -> Column:
    """struct<box, reason> of a written box, "west,south,east,north": box is array<double>, or null with the reason: numbers where there aren't
    four, order where a first isn't less than its second. With `point` equal ones pass, and blank text is no box and no fault."""
    parts = F.transform(F.split(text, ","), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "").try_cast("double"))
    sound = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull())
    west, south, east, north = (F.try_element_at(parts, F.lit(n)) for n in (1, 2, 3, 4))
    turned = (west > east) | (south > north) if point else (west >= east) | (south >= north)
    reason = F.when(F.coalesce(text, F.lit("")) == "", None if point else F.lit("numbers")).when(~F.coalesce(sound, F.lit(False)), F.lit("numbers")).when(turned, F.lit("order"))
    return F.struct(F.when(sound & ~turned, parts).alias("box"), reason.cast("string").alias("reason"))
