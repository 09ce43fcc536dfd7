"""Cleaning text that pages and files hold: cells, hole names, missing values, coordinate systems, rival vocabularies."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrakern.functions.geodesy import let
from terrakern.functions.names import GROUPS, SOIL_DETAIL, longest_contained, lookup

# How nothing is written, prefixes of hole names, supported systems.
NOTHING = ("", "N/A")
NO_SYSTEM = ("", "N/A", "UNKNOWN", "NONE", "NULL")
PREFIXES = ("BH", "SBH", "NH", "CH", "H")
SYSTEMS = ("EPSG:5186", "EPSG:5187", "EPSG:5181", "EPSG:5183", "EPSG:5174", "EPSG:5176")
#: Vocabularies that differ on purpose, each with what it gives for an unknown word.
VARIANTS: dict[str, tuple[dict[str, str], str]] = {
    "import": (
        {"매립층": "soil", "퇴적토": "soil", "실트질모래": "soil", "풍화토": "soil", "풍화암": "weathered_rock", "연암": "soft_rock", "보통암": "hard_rock", "경암": "hard_rock"},
        "soil",
    ),
    "shared": (
        {
            "토사": "soil", "매립토": "soil", "매립층": "soil", "퇴적토": "soil", "퇴적층": "soil", "충적층": "soil", "붕적층": "soil", "풍화토": "soil", "잔류토": "soil",
            "풍화암": "weathered_rock", "풍화대": "weathered_rock", "풍화기반암": "weathered_rock", "연암": "soft_rock", "리핑암": "soft_rock", "보통암": "normal_rock",
            "경암": "hard_rock", "발파암": "hard_rock", "극경암": "hard_rock",
        },
        "unknown",
    ),
    "viewer": (
        {
            "토사": "TOPSOIL", "매립층": "TOPSOIL", "퇴적층": "TOPSOIL", "충적층": "TOPSOIL", "붕적층": "TOPSOIL", "풍화토": "TOPSOIL",
            "풍화암": "WEATHERED", "풍화대": "WEATHERED", "연암": "SOFT_ROCK", "경암": "HARD_ROCK", "보통암": "HARD_ROCK",
        },
        "UNKNOWN",
    ),
}


#: Fixed value: what texts hold that compatibility composition may change, anything but ASCII and whole syllables of Hangul.
COMPOSED = r"[^\x00-\x7F가-힣]"


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Compatibility composition (NFKC), which no built-in function gives. Texts that it leaves as they are don't go to Python."""
    changes = text.rlike(COMPOSED)
    return F.coalesce(_compatible(F.when(changes, text)), text)


def clean_cell(raw: Column) -> Column:
    """A table cell on one line, without control characters and repeated blanks; null counts as empty."""
    text = F.regexp_replace(F.coalesce(compatible(raw), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+|\s{2,}", " "), r"^\s+|\s+$|(?<=\s)\s+", "")


def hole_id(raw: Column) -> Column:
    """Upper-case letters A-Z, digits and single hyphens inside; zeros before a number stay."""
    kept = F.regexp_replace(F.upper(clean_cell(raw)), "[^A-Z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def is_hole_id(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^({'|'.join(PREFIXES)})-?[0-9]+[A-Z0-9-]*$"), F.lit(False))


def hole_name(raw: Column) -> Column:
    """The hole that a text names, or null: a prefix and a number anywhere in a line, a syllable that reads as the prefix, or
    a whole line that is an id and not a level. Of several lines the first that names one counts."""

    def of(line: Column) -> Column:
        upper, tight = F.upper(line), F.regexp_replace(line, r"\s+", "")
        latin = r"\b(B\s*H|CH|NH|H)\s*-?\s*([0-9][A-Z0-9-]*)\b"
        found = F.when(upper.rlike(latin), F.concat(F.regexp_replace(F.regexp_extract(upper, latin, 1), r"\s+", ""), F.lit("-"), F.regexp_extract(upper, latin, 2)))
        syllable = r"[바배버비]-?([0-9][A-Za-z0-9-]*)"
        spoken = F.when(tight.rlike(syllable), F.concat(F.lit("BH-"), F.upper(F.regexp_extract(tight, syllable, 1))))
        level = line.rlike(r"(?i)표고|지반고|EL\.?|ELEV|GROUND\s*LEVEL") | line.rlike(r"^\s*[-+]?[0-9]+([.,][0-9]+)?\s*[mM]?\s*$")
        tidy = lambda c: F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-|-$", "")
        whole = tidy(F.regexp_replace(upper, "[^A-Z0-9-]", ""))
        return F.coalesce(tidy(found), tidy(spoken), F.when(~level & is_hole_id(whole), whole))

    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), r"[\r\n]+"), lambda s: F.trim(s) != "")
    return F.get(F.array_compact(F.transform(lines, of)), F.lit(0))


def text_or_null(cell: Column) -> Column:
    """Trimmed text; null for what says that there is none."""
    text = F.trim(cell)
    return F.when(~F.upper(text).isin(*NOTHING), text)


def float_or_null(cell: Column) -> Column:
    return F.replace(text_or_null(cell), F.lit(","), F.lit("")).try_cast("double")


def supported_crs(raw: Column, placed: Column) -> Column:
    """A supported system that a text names, or null. A datum without a false northing is taken as the later one only where
    there are coordinates (placed)."""
    text = F.trim(raw)
    tight = F.replace(F.upper(text), F.lit(" "), F.lit(""))
    code = F.coalesce(*[F.nullif(F.regexp_extract(tight, p, 1), F.lit("")) for p in (r"EPSG[:\s-]*([0-9]{4})", r"\b([0-9]{4})\b")])
    known = F.when(F.concat(F.lit("EPSG:"), code).isin(*SYSTEMS), F.concat(F.lit("EPSG:"), code))
    new = tight.contains("GRS80") | tight.contains("GRS-80") | text.contains("한국측지계2000")
    old = tight.contains("BESSEL") | text.contains("베셀")
    east = text.contains("동부")
    belt = lambda central, eastern: F.when(east, F.lit(f"EPSG:{eastern}")).otherwise(F.lit(f"EPSG:{central}"))
    datum = F.when(old, belt("5174", "5176")).when(text.rlike("60만|600,?000"), belt("5186", "5187")).when(text.rlike("50만|500,?000"), belt("5181", "5183")).when(placed, belt("5186", "5187"))
    by_datum = F.when((new | old) & ~text.rlike("서부|동해"), datum)
    wgs = tight.isin("EPSG:4326", "EPSG4326", "4326")
    named = tight.contains("WGS84") | tight.contains("WGS-84") | text.contains("경위도")
    return F.when(F.upper(text).isin(*NO_SYSTEM), F.lit(None)).when(wgs, F.lit("WGS84")).when(code.isNotNull(), known).when(named, F.lit("WGS84")).otherwise(by_datum)


def variant_group(raw: Column, variant: str) -> Column:
    """Group of a name in one of VARIANTS. `import` takes the first word that the name holds; the others look at Hangul alone,
    the whole name before the longest word in it; `shared` lets its own codes pass."""
    table, unknown = VARIANTS[variant]
    text = F.coalesce(raw, F.lit(""))
    if variant == "import":
        return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in table.items()], F.lit(unknown))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"\(.*?\)", ""), "[^가-힣]", "")
    found = F.coalesce(lookup(table, plain), longest_contained(table, plain), F.lit(unknown))
    code = F.lower(F.trim(text))
    return F.when(code.isin(*GROUPS), code).otherwise(found) if variant == "shared" else found


# What a page's name of a soil is read by, in this order; colours and endings that are left out; words that hint at a soil or a rock.
PAGE_NAMES = (
    "유기질토", "점토질모래", "사질점토", "매립토", "매립층", "퇴적토", "퇴적층", "충적토", "충적층", "풍화토", "잔류토", "점성토", "점토", "실트", "사질토", "모래", "역질토", "자갈",
    "풍화암", "보통암", "발파암", "리핑암", "화강암", "연암", "경암", "토사",
)
PAGE_COLOURS = ("암갈색", "회갈색", "황갈색", "회색", "청회색", "담회색", "적갈색", "갈색", "흑색", "백색", "층색", "표")
PAGE_HINTS = {
    "점토": "점토", "점성": "점토", "실트": "실트", "모래": "모래", "사질": "사질토", "자갈": "자갈", "역질": "자갈", "퇴적": "퇴적토", "충적": "충적토", "붕적": "붕적토",
    "유기": "유기질토", "이탄": "유기질토", "부식": "유기질토", "토": "토사",
}
HARD_HINTS, SOFT_HINTS = ("경", "단단", "견고"), ("연", "약", "무른")
#: The group that a table of pages shows for a name; other names stay.
PAGE_GROUPS = {
    "매립층": "매립토", "퇴적층": "퇴적토", "충적층": "충적토", "잔류토": "풍화토", "점성토": "점토", "사질토": "모래", "역질토": "자갈", "이탄": "유기질토", "부식토": "유기질토",
    "리핑암": "연암", "발파암": "경암", "화강암": "경암",
}
#: Names as scanners misread them.
MISREAD = {"풍화앙": "풍화암", "연앙": "연암", "연임": "연암"}


def _first_held(words, text: Column, value=lambda w: w) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(value(w))) for w in words])


def page_name(raw: Column, compatible_already: bool = False) -> Column:
    """A soil's name as a page says it: the first of PAGE_NAMES that it holds, else by a class code that stands alone, else by hints, else the
    common name. Brackets, colours and white space don't count; null and blank text have the common name. With `compatible_already`
    the text has its compatible form and the whole is one expression."""
    text = F.coalesce(raw, F.lit(""))
    plain = F.regexp_replace(text if compatible_already else compatible(text), r"\(.*?\)", "")
    for word in PAGE_COLOURS:
        plain = F.replace(plain, F.lit(word), F.lit(""))

    def by_codes(tight: Column) -> Column:
        return F.coalesce(*[F.when(F.upper(tight).rlike(f"(^|[^A-Z]){k}([^A-Z]|$)"), F.lit(v)) for k, v in SOIL_DETAIL.items() if k.isascii()])

    def by_hints(rest: Column) -> Column:
        held = lambda *words: reduce(lambda a, b: a | b, [rest.contains(w) for w in words])
        rock = F.when(held("암"), F.when(held(*HARD_HINTS), F.lit("경암")).when(held(*SOFT_HINTS), F.lit("연암")).otherwise(F.lit("보통암")))
        weathered = F.when(held("풍화") & held("암"), F.lit("풍화암"))
        return F.coalesce(weathered, _first_held(PAGE_HINTS, rest, PAGE_HINTS.get), rock, F.lit("토사"))

    def named(tight: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(tight, "[a-zA-Z]", ""), r"(?U)[^\w\s]", "")
        return F.coalesce(_first_held(PAGE_NAMES, tight), by_codes(tight), let(rest, by_hints))

    return let(F.regexp_replace(plain, r"(?U)\s+", ""), named)


def table_name(raw: Column) -> Column:
    """The name that a table of pages shows for a soil's name, itself if there is none; null counts as the common name."""
    return let(F.coalesce(raw, F.lit("토사")), lambda name: F.coalesce(lookup(PAGE_GROUPS, name), name))


def read_name(raw: Column, compatible_already: bool = False) -> Column:
    """A name in a text of a page's box: a rival spelling or a misreading that it holds, else `page_name` as a table shows it."""
    rivals = PAGE_GROUPS | MISREAD
    known = let(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", ""), lambda tight: _first_held(rivals, tight, rivals.get))
    return F.coalesce(known, table_name(page_name(raw, compatible_already)))
