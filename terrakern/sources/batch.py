"""Many spreadsheets of different layouts in one job: a layout for each file, rows by their file's layout, a report for each file.

A layout is a row of a table and meets its file's rows by an equi-join, so files of any number and form are read together. What is wrong
with one file is a line of its report and takes no other file along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions import geodesy, names, parse
from terrakern.operators.intervals import filled_down, merge_adjacent, stacked
from terrakern.operators.materialise import cut
from terrakern.sources.tables import REMARK, Layout, csv_rows, infer, xlsx_rows

#: Rows of a table and bytes of a file that are read at the most; what is larger is refused with a reason.
MOST_ROWS, MOST_BYTES, CHUNK = 100_000, 25 << 20, 10_000
LAYOUT = "path string, form string, header_row int, headers array<string>, roles map<string,int>, layers array<int>, remarks array<int>, years array<int>, confidence double, warnings array<string>"
HOLE = ["path", "project_name", "name", "longitude", "latitude"]


def cells_and_errors(files: DataFrame, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cells (path, row_no, cells) of files (path, content), and the files that can't be read (path, error). A file is read in one task and
    handed on in chunks of rows. Both are read from one table in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    if data is None or len(data) > MOST_BYTES:
                        raise ValueError("no content" if data is None else f"more than {MOST_BYTES} bytes")
                    rows = []
                    for row in xlsx_rows(data) if path.lower().endswith(".xlsx") else csv_rows(data):
                        rows.append(row)
                        if len(rows) > most_rows:
                            raise ValueError(f"more than {most_rows} rows")
                    if not rows:
                        raise ValueError("no rows")
                except Exception as e:  # noqa: BLE001  any file may be broken in any way
                    yield pd.DataFrame({"path": [path], "row_no": [-1], "cells": [[]], "error": [f"{type(e).__name__}: {e}"[:500]]})
                    continue
                for lo in range(0, len(rows), CHUNK):
                    part = rows[lo : lo + CHUNK]
                    yield pd.DataFrame({"path": path, "row_no": range(lo, lo + len(part)), "cells": part, "error": None})

    both = cut(files.select("path", "content").mapInPandas(run, "path string, row_no long, cells array<string>, error string"))
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("path", "error")


def layouts(cells: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """LAYOUT of each file of cells (path, row_no, cells), from its first five rows. `given` (path, header, role) corrects what is inferred:
    a column of that header takes the role, `stratum` for a layer and `ignore` for none."""
    first = cells.where("row_no < 5").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    told = F.map_from_entries(F.collect_list(F.struct("header", "role")))
    first = first.join(given.dropDuplicates(["path", "header"]).groupBy("path").agg(told.alias("given")), "path", "left") if given is not None else first.withColumn("given", F.lit(None).cast("map<string,string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rows, roles in zip(batch["path"], batch["rows"], batch["given"], strict=True):
                layout = infer([list(r["cells"]) for r in rows])
                if roles:
                    layout = _corrected(layout, dict(roles))
                h = layout.headers
                remarks = [n for n, c in enumerate(h) if re.search(REMARK[4:], c, re.IGNORECASE)]
                years = [n for n, c in enumerate(h) if "연도" in c or "year" in c.lower()]
                out.append((path, layout.form, layout.header_row, h, layout.roles, layout.layers, remarks, years, layout.confidence, layout.warnings))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LAYOUT.split(", ")])

    return first.mapInPandas(run, LAYOUT)


def _corrected(layout: Layout, given: dict[str, str]) -> Layout:
    at = {h: n for n, h in enumerate(layout.headers)}
    roles, layers = dict(layout.roles), set(layout.layers)
    for header, role in given.items():
        if (n := at.get(header)) is None:
            continue
        roles, layers = {r: k for r, k in roles.items() if k != n}, layers - {n}
        if role == "stratum":
            layers.add(n)
        elif role != "ignore":
            roles[role] = n
    out = Layout(layout.header_row, layout.headers, roles, sorted(layers))
    out.warnings = [w for w in layout.warnings if not (w.startswith("the form") and out.form != "ambiguous") and not (w.startswith("no column of names") and "name" in roles) and not (w.startswith("no columns of coordinates") and ("lon" in roles or {"x", "y"} <= set(roles)))]
    return out


def _said(row: str) -> Column:
    """EPSG code that a row's cells of remarks name: the first that names one."""
    year = F.get("cells", F.get("years", F.lit(0)))
    hints = F.filter(F.transform("remarks", lambda n: parse.crs_hint(F.get(F.col(row), n), year)), lambda c: c.isNotNull())
    return F.get(hints, F.lit(0))


def holes_by_layout(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Rows below their file's header with the identity, place and levels of their hole, and their file's layout. A coordinate system is
    what the row's remarks say, or those of the last row before that says any."""
    laid = cells.join(known, "path").where("row_no > header_row")
    laid = filled_down(laid.withColumn("crs", _said("cells")), ["path"], ["row_no"], ["crs"])
    cell = lambda role: F.trim(F.get("cells", F.try_element_at("roles", F.lit(role))))
    number = lambda role: parse.number(cell(role))
    lat, lon = geodesy.grid_to_wgs84(parse.tm_scale(number("y"))[0], parse.tm_scale(number("x"))[0], F.col("crs"))
    return laid.select(
        *known.columns, "row_no", "cells", "crs", F.coalesce(F.when(cell("name") != "", cell("name")), F.concat(F.lit("ROW-"), (F.col("row_no") - F.col("header_row")).cast("string"))).alias("name"),
        F.when(cell("project_name") != "", cell("project_name")).alias("project_name"), F.coalesce(number("lon"), lon).alias("longitude"), F.coalesce(number("lat"), lat).alias("latitude"),
        number("elevation").alias("elevation"), F.coalesce(number("water_gl"), number("water_level")).alias("water_level_gl"), number("water_el").alias("water_level_el"),
        number("depth_top").alias("depth_top"), number("depth_bottom").alias("depth_bottom"), names.display_name(cell("soil_type")).alias("soil_type"),
    )


def strata_by_layout(rows: DataFrame) -> DataFrame:
    """(path, project_name, name, longitude, latitude, depth_top, depth_bottom, soil_type) of holes_by_layout() rows: thicknesses of the layers'
    columns one below the other in wide files, a row for each in long ones; equal neighbours are one. Rows without a place have none."""
    placed = rows.where("longitude IS NOT NULL AND latitude IS NOT NULL")
    wide = placed.where("form = 'wide'").select(*HOLE, "row_no", F.posexplode(F.transform("layers", lambda n: F.struct(F.get("cells", n).alias("cell"), F.get("headers", n).alias("header")))).alias("ord", "c"))
    wide = wide.select(*HOLE, "row_no", "ord", parse.number(F.col("c.cell")).alias("thickness"), names.display_name(F.col("c.header")).alias("soil_type"))
    piled = merge_adjacent(stacked(wide, [*HOLE, "row_no"], ["ord"], "thickness"), [*HOLE, "row_no"], ["depth_top"], "soil_type")
    long = merge_adjacent(placed.where("form = 'long' AND depth_bottom > depth_top"), HOLE, ["row_no"], "soil_type")
    columns = [*HOLE, "depth_top", "depth_bottom", "soil_type"]
    return piled.select(*columns).unionByName(long.select(*columns))


def holes_and_refused(rows: DataFrame, bounds: tuple[float, float, float, float] = (124, 33, 132, 39)) -> tuple[DataFrame, DataFrame]:
    """One row for each hole (path, project_name, name, longitude, latitude) with its first row's levels, and rows set apart (path, row_no, name,
    reason): no_place, or out_of_bounds (west, south, east, north)."""
    west, south, east, north = bounds
    inside = F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    reason = F.when(F.col("longitude").isNull() | F.col("latitude").isNull(), F.lit("no_place")).when(~inside, F.lit("out_of_bounds"))
    judged = rows.withColumn("reason", reason)
    first = [F.min_by(c, "row_no").alias(c) for c in ("elevation", "water_level_gl", "water_level_el", "crs")]
    return judged.where("reason IS NULL").groupBy(*HOLE).agg(*first, F.min("row_no").alias("row_no")), judged.where("reason IS NOT NULL").select("path", "row_no", "name", "reason")


def reports(wanted: DataFrame, errors: DataFrame, known: DataFrame, holes: DataFrame, strata: DataFrame, refused: DataFrame) -> DataFrame:
    """One row for each file of a batch (path): status, reason, form, confidence, warnings, boreholes, strata, refused and soils (how many strata of
    each name). A file is skipped where it isn't there, failed where it can't be read, its form can't be told or it has no hole with
    strata, else ok."""
    count = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    soils = strata.groupBy("path", "soil_type").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("soil_type", "n")))).alias("soils"))
    out = wanted.select("path").distinct().join(errors, "path", "left").join(known.select("path", "form", "confidence", "warnings"), "path", "left")
    for part in (count(holes, "boreholes"), count(strata, "strata"), count(refused, "refused"), soils):
        out = out.join(part, "path", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("boreholes", "strata", "refused")}
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("form").isNull(), F.lit("not found")).when(F.col("form") == "ambiguous", F.lit("ambiguous form")).when((n["boreholes"] == 0) | (n["strata"] == 0), F.lit("nothing to store"))
    status = F.when(reason.isNull(), F.lit("ok")).when(F.col("error").isNull() & F.col("form").isNull(), F.lit("skipped")).otherwise(F.lit("failed"))
    return out.select("path", status.alias("status"), reason.alias("reason"), "form", "confidence", "warnings", *[c.alias(k) for k, c in n.items()], "soils")


def read_batch(wanted: DataFrame, files: DataFrame, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Holes, strata, rows set apart and reports of the files (path, content) of a batch (path)."""
    cells, errors = cells_and_errors(files.join(wanted.select("path").distinct(), "path", "left_semi"))
    known = cut(layouts(cells, given))
    rows = cut(holes_by_layout(cells, known))
    holes, refused = holes_and_refused(rows)
    strata = strata_by_layout(rows).join(holes.select(*[F.col(c).alias(f"_{c}") for c in HOLE]), _same_hole(), "left_semi")
    holes, strata = cut(holes), cut(strata)
    return holes, strata, refused, reports(wanted, errors, known, holes, strata, refused)


def _same_hole() -> Column:
    met = F.lit(True)
    for c in HOLE:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return met
