"""Text exports: rows of text with the order that they take in the file, written as one file for each layer or drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakern.functions import geodesy
from terrakern.operators.ordering import running

CRS = "EPSG:5186"


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c)


def tin(grids: DataFrame, size: int, lon: str = "x", lat: str = "y") -> tuple[DataFrame, DataFrame]:
    """Points and faces of a size x size grid (layer, j, i, ...): northing, easting and level as text, and two triangles a cell."""
    north, east = geodesy.to_grid(F.col(lat), F.col(lon), CRS)
    number = (F.col("j") * size + F.col("i") + 1).cast("long")
    points = grids.select("layer", number.alias("point"), F.concat(F.lit('<P id="'), number.cast("string"), F.lit('">'), F.concat_ws(" ", _fixed(north, 3), _fixed(east, 3), _fixed(F.col("z"), 4)), F.lit("</P>")).alias("line"))
    cells = grids.where((F.col("j") < size - 1) & (F.col("i") < size - 1)).select("layer", number.alias("a"))
    a, b, c, d = F.col("a"), F.col("a") + 1, F.col("a") + size, F.col("a") + size + 1
    two = F.array(F.concat_ws(" ", a.cast("string"), b.cast("string"), d.cast("string")), F.concat_ws(" ", a.cast("string"), d.cast("string"), c.cast("string")))
    faces = cells.select("layer", "a", F.posexplode(two).alias("half", "face")).select("layer", (F.col("a") * 2 + F.col("half")).alias("face_no"), F.concat(F.lit("<F>"), "face", F.lit("</F>")).alias("line"))
    return points, faces


def observed_points(contacts: DataFrame, lon: str = "x", lat: str = "y") -> DataFrame:
    """A layer's observed points (layer, id, ...), of those within a centimetre's cell the least id, with their text."""
    north, east = geodesy.to_grid(F.col(lat), F.col(lon), CRS)
    at = contacts.withColumns({"north": north, "east": east})
    first = at.groupBy("layer", F.round(F.col("east") * 100).alias("_e"), F.round(F.col("north") * 100).alias("_n")).agg(F.min_by(F.struct("id", "north", "east", "z"), "id").alias("p"))
    return first.select("layer", F.col("p.id").alias("id"), F.concat_ws(" ", _fixed(F.col("p.north"), 3), _fixed(F.col("p.east"), 3), _fixed(F.col("p.z"), 4)).alias("line"))


def drawing(holes: DataFrame, strata: DataFrame, deepest: float = 300.0, label_height: float = 2.0) -> DataFrame:
    """(hole, part, entity) of a drawing: an upright line for each stratum, then a label over each hole."""
    north, east = geodesy.to_grid(F.col("latitude"), F.col("longitude"), CRS)
    placed = holes.where("longitude IS NOT NULL AND latitude IS NOT NULL AND elevation IS NOT NULL").select(F.col("id").alias("hole"), "name", "elevation", north.alias("north"), east.alias("east"))
    sound = strata.where((F.col("depth_bottom") > F.col("depth_top")) & (F.col("depth_bottom") <= deepest)).withColumnRenamed("borehole_id", "hole")
    text = lambda *pairs: F.concat_ws("\n", *[x for code, value in pairs for x in (F.lit(code), value)])
    xy = lambda a, b: ((a, _fixed(F.col("east"), 4)), (b, _fixed(F.col("north"), 4)))
    lines = sound.join(placed, "hole").select(
        "hole", F.col("depth_top").alias("part"),
        text(("0", F.lit("LINE")), ("8", F.upper("strata_group")), *xy("10", "20"), ("30", _fixed(F.col("elevation") - F.col("depth_bottom"), 4)), *xy("11", "21"), ("31", _fixed(F.col("elevation") - F.col("depth_top"), 4))).alias("entity"),
    )
    label = text(("0", F.lit("TEXT")), ("8", F.lit("LABEL")), *xy("10", "20"), ("30", _fixed(F.col("elevation") + label_height * 0.5, 4)), ("40", F.lit(f"{label_height:.3f}")), ("1", F.col("name")))
    return lines.unionByName(placed.select("hole", F.lit(float("inf")).alias("part"), label.alias("entity")))


# Labels and codes of layers in exported documents, colour numbers of drawing layers.
LABELS = {"ground_surface": "지표면", "soil": "토사", "weathered_rock": "풍화암", "soft_rock": "연암", "normal_rock": "보통암", "hard_rock": "경암"}
DRAWING_COLOURS = {"soil": 34, "weathered_rock": 40, "soft_rock": 80, "normal_rock": 8, "hard_rock": 250, "unknown": 9}
_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<LandXML version="1.2" xmlns="http://www.landxml.org/schema/LandXML-1.2"',
    '  date="{date}" time="{time}" language="Korean" readOnly="false">',
    "  <Units>",
    '    <Metric linearUnit="meter" areaUnit="squareMeter" volumeUnit="cubicMeter"',
    '      temperatureUnit="celsius" pressureUnit="milliBars"',
    '      angularUnit="decimal dd.mm.ss" directionUnit="decimal dd.mm.ss"/>',
    "  </Units>",
    '  <CoordinateSystem name="Korea 2000 Central Belt 2010" epsgCode="5186"/>',
)


def _listed(spark, lines: list[str], group: int, part: int) -> DataFrame:
    """Fixed lines of a document, before or after its rows."""
    return spark.createDataFrame([(group, part, float(n), 0, x) for n, x in enumerate(lines)], "group int, part long, number double, half int, line string")


def checked_grids(grids: DataFrame, size: int) -> DataFrame:
    """(layer, problem) of layers (layer, j, i, z) that aren't size x size nodes, each with a finite level; one below 2 never is."""
    finite = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs(F.col("z")) < float("inf"))
    inside = F.col("j").between(0, size - 1) & F.col("i").between(0, size - 1)
    seen = grids.groupBy("layer").agg(F.count_distinct(F.when(inside, F.struct("j", "i"))).alias("n"), F.count(F.when(~inside, 1)).alias("out"), F.count(F.when(~finite, 1)).alias("bad"))
    shape = (F.col("n") != size * size) | (F.col("out") > 0) | F.lit(size < 2)
    return seen.where(shape | (F.col("bad") > 0)).select("layer", F.when(shape, "shape").otherwise("level").alias("problem"))


def _numbered_layers(layers: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer")).cast("int")


def surface_document(grids: DataFrame, size: int, layers: list[str], date: str, time: str) -> DataFrame:
    """(group, part, number, half, line): a whole surface document of the layers (layer, j, i, x, y, z), in the order of its first
    four columns. Refuses grids that aren't square and finite."""
    spark, chosen = grids.sparkSession, grids.where(F.col("layer").isin(*layers))
    wrong = checked_grids(chosen, size).limit(1).collect()
    if wrong:
        raise ValueError(f"the grid of {wrong[0]['layer']} has a wrong {wrong[0]['problem']}")
    points, faces = tin(chosen, size)
    indent = lambda df, part, number: df.select(_numbered_layers(layers).alias("group"), F.lit(part).alias("part"), number.cast("double").alias("number"), F.lit(0).alias("half"), F.concat(F.lit(" " * 10), "line").alias("line"))
    out = _listed(spark, [x.format(date=date, time=time) for x in (*_HEAD, "  <Surfaces>")], 0, 0)
    out = out.unionByName(indent(points, 2, F.col("point"))).unionByName(indent(faces, 4, F.col("face_no")))
    for n, layer in enumerate(layers, start=1):
        out = out.unionByName(_listed(spark, [f'    <Surface name="{LABELS.get(layer, layer)}">', '      <Definition surfType="TIN">', "        <Pnts>"], n, 1))
        out = out.unionByName(_listed(spark, ["        </Pnts>", "        <Faces>"], n, 3))
        out = out.unionByName(_listed(spark, ["        </Faces>", "      </Definition>", "    </Surface>"], n, 5))
    return out.unionByName(_listed(spark, ["  </Surfaces>", "</LandXML>"], len(layers) + 1, 0))


def point_document(grids: DataFrame, contacts: DataFrame, size: int, layers: list[str], date: str, time: str) -> DataFrame:
    """(group, part, number, half, line): a whole document of points, for each layer the observed ones, by id, then the nodes."""
    spark, chosen = grids.sparkSession, grids.where(F.col("layer").isin(*layers))
    code = F.upper("layer")
    seen = observed_points(contacts.where(F.col("layer").isin(*layers)))
    seen = running(seen, ["layer"], [F.col("id")], counts={"n": F.lit(True)})
    point = F.concat(F.lit('    <CgPoint name="'), code, F.lit("_OBS_"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit('" code="'), code, F.lit('_OBSERVED" desc="시추공 '), F.col("id").cast("string"), F.lit('">'), F.col("line"), F.lit("</CgPoint>"))
    north, east = geodesy.to_grid(F.col("y"), F.col("x"), CRS)
    name = F.concat(code, F.format_string("_INT_R%03d_C%03d", F.col("j") + 1, F.col("i") + 1))
    node = F.concat(F.lit('    <CgPoint name="'), name, F.lit('" code="'), code, F.lit('_INTERPOLATED">'), F.concat_ws(" ", _fixed(north, 3), _fixed(east, 3), _fixed(F.col("z"), 4)), F.lit("</CgPoint>"))
    row = lambda df, part, number, line: df.select(_numbered_layers(layers).alias("group"), F.lit(part).alias("part"), number.cast("double").alias("number"), F.lit(0).alias("half"), line.alias("line"))
    out = _listed(spark, [x.format(date=date, time=time) for x in _HEAD], 0, 0)
    out = out.unionByName(row(seen, 2, F.col("n"), point)).unionByName(row(chosen, 3, F.col("j") * size + F.col("i"), node))
    for n, layer in enumerate(layers, start=1):
        out = out.unionByName(_listed(spark, [f'  <CgPoints name="{layer.upper()}" desc="{LABELS.get(layer, layer)}; grid={size}x{size}">'], n, 1)).unionByName(_listed(spark, ["  </CgPoints>"], n, 4))
    return out.unionByName(_listed(spark, ["</LandXML>"], len(layers) + 1, 0))


def drawing_document(holes: DataFrame, strata: DataFrame, **options) -> DataFrame:
    """(group, part, number, half, line): a whole drawing: header, a table of the layers used, the entities hole by hole."""
    spark, entities = holes.sparkSession, drawing(holes, strata, **options)
    used = strata.select(F.coalesce("strata_group", F.lit("unknown")).alias("g")).distinct()
    groups = sorted(r["g"] for r in used.where(F.col("g").isin(*DRAWING_COLOURS)).collect())  # of the fixed groups at most
    layers = [(g.upper(), DRAWING_COLOURS[g]) for g in groups] + [("LABEL", 7)]
    head = ["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", "AC1009", "9", "$INSUNITS", "70", "6", "0", "ENDSEC", "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LAYER", "70", str(len(layers))]
    for name, colour in layers:
        head += ["0", "LAYER", "2", name, "70", "0", "62", str(colour), "6", "CONTINUOUS"]
    head += ["0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    body = entities.select(F.lit(1).alias("group"), F.col("hole").cast("long").alias("part"), F.col("part").cast("double").alias("number"), F.lit(0).alias("half"), F.col("entity").alias("line"))
    return _listed(spark, head, 0, 0).unionByName(body).unionByName(_listed(spark, ["0", "ENDSEC", "0", "EOF"], 2, 0))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines in their order over as many files as the data needs; files and lines in them are in order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def snapshot(df: DataFrame, path: str, x: str = "longitude", y: str = "latitude") -> None:
    """A table as JSON lines, its place as well-known text."""
    place = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.concat(F.lit("POINT("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")")))
    df.withColumn("location", place).write.json(path)


def restored(df: DataFrame) -> DataFrame:
    """A snapshot's rows with coordinates read from the text of their place."""
    part = lambda n: F.regexp_extract("location", r"POINT\s*\(\s*(\S+)\s+(\S+)\s*\)", n).try_cast("double")
    return df.withColumns({"longitude": part(1), "latitude": part(2)}).drop("location")
