"""Reading spreadsheets of unknown layout: cells first, meaning after.

A file is decoded where it lies, one file to a task, into rows of text cells. What the columns mean is inferred from its first
rows, as a proposal; turning cells into holes and strata is column work.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.functions import geodesy, names, parse
from terrakern.operators.intervals import filled_down, merge_adjacent, stacked

ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
DELIMITERS = ",;\t|"
MOST_UNPACKED = 100 << 20
#: Rows of a file that a task gives out at a time.
AT_ONCE = 4096
CELLS = "path string, row_no long, cells array<string>"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def csv_rows(data: bytes) -> Iterator[list[str]]:
    text = decode(data)
    head = re.sub(r'"[^"]*"', "", "\n".join(text.splitlines()[:20]))  # marks inside quotes don't part cells
    delimiter = max(DELIMITERS, key=head.count)
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if any(c.strip() for c in row):
            yield row


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _first_sheet(z: zipfile.ZipFile, inside: set[str]) -> str:
    """The part of the sheet that the workbook lists first; without a list, the one of the least number."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= inside:
        listed = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_SHEET}sheets/{_SHEET}sheet")
        wanted = next((v for k, v in (listed.items() if listed is not None else ()) if k.endswith("}id")), None)
        for part in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = (part.get("Target") or "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if wanted and part.get("Id") == wanted and target in inside:
                return target
    return min((n for n in inside if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: (len(n), n))


def xlsx_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet; a file that unpacks to more than MOST_UNPACKED is refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
            raise ValueError("the workbook is too large when unpacked")
        inside = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in inside:
            strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = _first_sheet(z, inside)
        held = None  # the element that rows lie in lets go of those read
        for event, row in ElementTree.iterparse(z.open(sheet), ("start", "end")):
            if event == "start":
                held = row if row.tag == f"{_SHEET}sheetData" else held
            if event == "start" or row.tag != f"{_SHEET}row":
                continue
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                value = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
                cells += [""] * (at - len(cells)) + [strings[int(text)] if c.get("t") == "s" and text else text or ""]
            if held is not None:
                held.clear()
            if any(c.strip() for c in cells):
                yield cells


def cells_of(files: DataFrame) -> DataFrame:
    """CELLS of files (path, content): a workbook by its name, else a table of text. A file is read in one task, and its rows go out
    some at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = enumerate(xlsx_rows(data) if name.lower().endswith(".xlsx") else csv_rows(data))
                while some := list(islice(rows, AT_ONCE)):
                    yield pd.DataFrame({"path": [name] * len(some), "row_no": [n for n, _ in some], "cells": [c for _, c in some]})

    return files.select("path", "content").mapInPandas(run, CELLS)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """CELLS of every .csv, .txt or .xlsx file of a path."""
    return cells_of(spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(csv|txt|xlsx)$")))


# What headers say, the first role that fits counts.
ROLES = {
    "project_name": (r"프로젝트\s*명", r"조사\s*명", r"사업\s*명", r"project\s*name", r"survey\s*name"),
    "name": (r"공번", r"시추공", r"공\s*명", r"\bbh\b", r"hole", r"^명칭$"),
    "lon": (r"경도", r"\blon", r"longitude"),
    "lat": (r"위도", r"\blat", r"latitude"),
    "x": (r"^x$", r"x\s*좌표", r"easting", r"tm_?x"),
    "y": (r"^y$", r"y\s*좌표", r"northing", r"tm_?y"),
    "elevation": (r"표고", r"^el\b", r"고도", r"elevation", r"^z$"),
    "depth_top": (r"상심도", r"시작\s*심도", r"상단", r"top", r"from", r"_top"),
    "depth_bottom": (r"하심도", r"종료\s*심도", r"하단", r"bottom", r"\bto\b", r"_bot"),
    "soil_type": (r"지층명", r"^지층$", r"토질", r"soil", r"layer\s*name"),
    "total_depth": (r"시추\s*심도", r"전체\s*심도", r"공\s*심도"),
    "water_gl": (r"수위.*gl", r"지하수위.*gl", r"gl.*수위"),
    "water_el": (r"수위.*el", r"지하수위.*el", r"el.*수위"),
    "water_level": (r"수위", r"지하수위"),
    "crs": (r"좌표계", r"원점", r"\bcrs\b", r"datum"),
    "ignore": (r"연번", r"일련", r"연도", r"비고", r"remark", r"note", r"^no$"),
}
REMARK = r"(?i)비고|좌표계|원점|좌표|remark|note|crs|datum"


def role_of(header: str) -> str | None:
    text = (header or "").strip().lower()
    return next((role for role, patterns in ROLES.items() if text and any(re.search(p, text) for p in patterns)), None)


def is_layer(header: str) -> bool:
    text = re.sub(r"\(.*?\)", "", re.sub(r"\s+", "", header or ""))
    words = [*(k for k in names.SOIL_DETAIL if not k.isascii()), *names.ROCKS]
    return text.upper() in names.SOIL_DETAIL or any(w in text for w in words)


@dataclass
class Layout:
    """A proposal: which row is the header, what each column is, and which columns are layers from the top down."""

    header_row: int
    headers: list[str]
    roles: dict[str, int] = field(default_factory=dict)
    layers: list[int] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def form(self) -> str:
        if {"depth_top", "depth_bottom", "soil_type"} <= set(self.roles):
            return "long"
        return "wide" if len(self.layers) >= 2 else "ambiguous"

    @property
    def confidence(self) -> float:
        placed = "lon" in self.roles or {"x", "y"} <= set(self.roles)
        score = 0.65 * (self.form != "ambiguous") + 0.15 * ("name" in self.roles) + 0.2 * placed - 0.1 * len(self.warnings)
        return round(max(0.0, score), 2)


def infer(first_rows: list[list[str]], crs: str | None = None) -> Layout:
    """The layout of a table from its first five rows."""
    some = first_rows[:5]
    known = [sum(bool(role_of(c) or is_layer(c)) for c in row) for row in some]
    best = known.index(max(known))
    out = Layout(best, [c or "" for c in some[best]])
    for n, header in enumerate(out.headers):
        role = role_of(header)
        if is_layer(header) and role not in ("soil_type", "depth_top", "depth_bottom"):
            out.layers.append(n)
        elif role and role != "ignore":
            out.roles[role] = n
    if out.form == "ambiguous":
        out.warnings.append("the form can't be told: roles must be given")
    if "lon" not in out.roles and not {"x", "y"} <= set(out.roles):
        out.warnings.append("no columns of coordinates")
    if "name" not in out.roles:
        out.warnings.append("no column of names: rows are numbered")
    if {"x", "y"} <= set(out.roles) and not {"lon", "crs"} & set(out.roles) and not crs:
        out.warnings.append("grid coordinates without a coordinate system")
    return out


def holes_of(cells: DataFrame, layout: Layout, crs: str | None = None) -> DataFrame:
    """Rows below the header with their hole's identity, place and levels; `crs` stands above what the rows say, which is else
    carried down from the row that says it."""
    cell = lambda role: F.trim(F.get("cells", F.lit(layout.roles[role]))) if role in layout.roles else F.lit(None).cast("string")
    number = lambda role: parse.number(cell(role))
    remarks = [n for n, h in enumerate(layout.headers) if re.search(REMARK[4:], h, re.IGNORECASE)]
    years = [n for n, h in enumerate(layout.headers) if "연도" in h or "year" in h.lower()]
    year = F.get("cells", F.lit(years[0])) if years else None
    said = F.coalesce(*[parse.crs_hint(F.get("cells", F.lit(n)), year) for n in remarks], F.lit(None).cast("string"))
    rows = cells.where(F.col("row_no") > layout.header_row).withColumn("crs", F.lit(crs) if crs else said)
    rows = filled_down(rows, ["path"], ["row_no"], ["crs"])
    x, y = parse.tm_scale(number("x"))[0], parse.tm_scale(number("y"))[0]
    # In these tables X is the easting and Y the northing.
    lat, lon = geodesy.grid_to_wgs84(y, x, F.col("crs"))
    return rows.select(
        "path", "row_no", "cells", "crs",
        F.coalesce(F.when(cell("name") != "", cell("name")), F.concat(F.lit("ROW-"), (F.col("row_no") - layout.header_row).cast("string"))).alias("name"),
        F.when(cell("project_name") != "", cell("project_name")).alias("project_name"),
        F.coalesce(number("lon"), lon).alias("longitude"), F.coalesce(number("lat"), lat).alias("latitude"),
        number("elevation").alias("elevation"), number("water_gl").alias("water_level_gl"), number("water_el").alias("water_level_el"), number("total_depth").alias("total_depth"),
    )


def wide_strata(holes: DataFrame, layout: Layout) -> DataFrame:
    """Strata of a table with a thickness column for each layer, equal neighbours merged."""
    columns = [F.struct(F.lit(n).alias("ord"), parse.number(F.get("cells", F.lit(i))).alias("thickness"), names.display_name(F.lit(layout.headers[i])).alias("soil_type")) for n, i in enumerate(layout.layers)]
    rows = holes.select("path", "row_no", "name", F.explode(F.array(*columns)).alias("_c")).select("path", "row_no", "name", "_c.*")
    piled = stacked(rows, ["path", "row_no", "name"], ["ord"], "thickness")
    return merge_adjacent(piled, ["path", "row_no", "name"], ["depth_top"], "soil_type")


def long_strata(holes: DataFrame, layout: Layout) -> DataFrame:
    """Strata of a table with a row for each; a hole is a name at a place in a survey."""
    cell = lambda role: F.get("cells", F.lit(layout.roles[role]))
    rows = holes.withColumns({"depth_top": parse.number(cell("depth_top")), "depth_bottom": parse.number(cell("depth_bottom")), "soil_type": names.display_name(cell("soil_type"))})
    key = ["path", "project_name", "name", "longitude", "latitude"]
    sound = rows.where((F.col("depth_bottom") > F.col("depth_top")) & F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    return merge_adjacent(sound, key, ["row_no"], "soil_type")


def headered(cells: DataFrame, columns: dict[str, str], zero: tuple[str, ...] = ("elevation",)) -> DataFrame:
    """Rows below the first of each file (path), by the names in that row and with the types of `columns`. A blank is null, and 0
    in the columns of `zero`; a value that isn't of its type is null."""
    heads = cells.where("row_no = 0").select("path", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("_h"))
    rows = cells.where("row_no > 0").join(heads, "path")
    found = {c: F.get("cells", (F.array_position("_h", c) - 1).cast("int")) for c in columns}
    typed = {c: F.nullif(F.trim(v), F.lit("")).try_cast(columns[c]) for c, v in found.items()}
    return rows.select("path", "row_no", *[(F.coalesce(v, F.lit(0.0)) if c in zero else v).alias(c) for c, v in typed.items()])


def quarantined(holes: DataFrame, west: float = 124, east: float = 132, south: float = 33, north: float = 39) -> tuple[DataFrame, DataFrame]:
    """Holes within the country's bounds, and the others."""
    inside = F.coalesce(F.col("longitude").between(west, east) & F.col("latitude").between(south, north), F.lit(False))
    return holes.where(inside), holes.where(~inside)


def read_nested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Holes and strata of JSON files of projects, each with boreholes, each with strata."""
    stratum = "array<struct<depth_top:double,depth_bottom:double,soil_type:string,raw_text:string>>"
    hole = f"array<struct<name:string,longitude:double,latitude:double,elevation:double,strata:{stratum}>>"
    files = spark.read.schema(f"projects array<struct<name:string,boreholes:{hole}>>").option("multiLine", True).json(path)
    holes = files.select(F.explode("projects").alias("p")).select(F.col("p.name").alias("project"), F.explode("p.boreholes").alias("b")).select("project", "b.*")
    strata = holes.select("project", "name", "longitude", "latitude", F.explode("strata").alias("s")).select("project", "name", "longitude", "latitude", "s.*")
    return holes.drop("strata"), strata.withColumn("strata_group", names.strata_group(F.col("soil_type")))


def polygon_status(configured: bool, texts: DataFrame) -> str:
    """not_configured, missing (no file), invalid (no file has features) or ok."""
    if not configured:
        return "not_configured"
    row = texts.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(F.from_json("value", "features array<string>")["features"]) >= 0, 1)).alias("good")).first()
    return "missing" if not row["n"] else "ok" if row["good"] else "invalid"


def _cut(ring: Column, axis: str, bound: float, sign: float) -> Column:
    """A ring's points on one side of a line, and where its edges cross it."""
    other = "y" if axis == "x" else "x"

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, F.size(ring)))
        a, b = (p[axis] - bound) * sign, (q[axis] - bound) * sign
        met = {axis: F.lit(bound), other: p[other] + (q[other] - p[other]) * a / (a - b)}
        cross = F.struct(met["x"].alias("x"), met["y"].alias("y"))
        return F.array_compact(F.array(F.when(a >= 0, p), F.when((a >= 0) != (b >= 0), cross)))

    return F.flatten(F.transform(ring, edge))


def _area(ring: Column) -> Column:
    turn = F.transform(ring, lambda p, i: p["x"] * F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] * p["y"])
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, v: s + v)) / 2


def clipped_rings(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings (..., points: array<array<double>>) cut by a box, those without area left out. The ring is cut by one side of the box
    after the other: points inside stay, and where an edge crosses the side a point is put."""
    x0, y0, x1, y1 = map(float, box)
    sides = (("x", x0, 1.0), ("x", x1, -1.0), ("y", y0, 1.0), ("y", y1, -1.0))

    def cut_from(n: int) -> Callable[[Column], Column]:
        if n == len(sides):
            return lambda ring: F.struct(F.transform(ring, lambda p: F.array(p["x"], p["y"])).alias("points"), _area(ring).alias("area"))
        return lambda ring: geodesy.let(_cut(ring, *sides[n]), cut_from(n + 1))

    points = F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    out = rings.withColumn("_c", geodesy.let(points, cut_from(0)))
    return out.withColumns({"points": F.col("_c.points"), "area": F.col("_c.area")}).drop("_c").where("area > 0")


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """(feature, ring, points) of polygon and multi-polygon features."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<geometry:struct<type:string,coordinates:string>>>").alias("f"))
    flat = files.select(F.posexplode("f.features.geometry").alias("feature", "g"))
    many = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", "array<array<array<array<double>>>>"))
    return flat.select("feature", F.explode(many).alias("p")).select("feature", F.posexplode("p").alias("ring", "points"))
