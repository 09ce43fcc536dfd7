"""Logs of holes read off the lines of a document: which hole a row of a table belongs to, and the intervals that its rows make."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.functions.parse import depth_values
from terrakern.functions.text import compatible, page_name

# Letters that a hole's id begins with, labels before an id, the name of a hole without one, metres by which a new hole is shallower.
ID = r"(?:NH|BH|TP|NX|SB|DB|TB|DH|OW|MW|IW|BX|JB|TH|KP|CB|PB|EB|KB)[-\s]*[0-9]+[A-Z]?"
LABEL = r"(?i)(?:시추번호|시추공번|시추공명|No\.?)[^A-Za-z0-9가-힣/]*([A-Za-z0-9-]{2,15})"
ROW = r"^\|[^|]+\|[^|]+\|[^|]+\|"
NAMELESS, SHALLOWER = "시추-", 2.0
_SIGNS = "doc string, line_no long, place int, id string, label string, depth double, whole boolean"
_FOUND = "doc string, line_no long, hole string, section int, bottom double"


def ids_named(pages: DataFrame) -> DataFrame:
    """(doc, id, place): ids of holes that the text (doc, line_no, text) of a document's pages names, in the order of their first mention."""
    found = F.regexp_extract_all(compatible(F.coalesce("text", F.lit(""))), F.lit(f"({ID})"), F.lit(1))
    each = pages.select("doc", "line_no", F.posexplode(found).alias("at", "id")).withColumn("id", F.regexp_replace(F.upper("id"), r"[-\s]+", "-"))
    first = each.groupBy("doc", "id").agg(F.min(F.struct("line_no", "at")).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("_at"))).select("doc", "id", "place")  # a row for each hole


def signs(lines: DataFrame, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What the lines (doc, line_no, text) say: a label's id, or the depth of a table's row and whether the row is whole, before them the
    document's ids. Lines that hold neither a label nor a digit in a row are left out. Columns of lines in `keep` stay."""
    text = F.trim(compatible(F.coalesce("text", F.lit(""))))
    rows = lines.select("doc", F.col("line_no").cast("long").alias("line_no"), text.alias("_t"), *keep)
    cells = F.split("_t", r"\|")
    is_row, cell = F.col("_t").rlike(ROW), F.trim(F.get(cells, F.lit(1)))
    # a filter is worked out apart from the columns, so it asks less than they do: what it lets pass in vain turns nothing
    rows = rows.where((is_row & cell.rlike("[0-9Oo]")) | F.col("_t").rlike(LABEL))
    depth = F.when(is_row, F.try_element_at(depth_values(cell), F.lit(-1)))
    label = F.nullif(F.upper(F.regexp_extract("_t", LABEL, 1)), F.lit(""))
    said = rows.select("doc", "line_no", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("id"), label.alias("label"), depth.alias("depth"), (F.size(cells) > 5).alias("whole"), *keep)
    given = ids.select("doc", F.lit(None).cast("long").alias("line_no"), F.col("place").cast("int").alias("place"), "id", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("depth", "double"), ("whole", "boolean"), *((c, "string") for c in keep))])
    return given.unionByName(said)


class _Reader:
    """Where the reading of one document stands; a document's ids are kept, its rows aren't."""

    def __init__(self, doc) -> None:
        self.doc, self.ids, self.hole, self.section, self.least, self.before = doc, [], None, 0, -1.0, None

    def turn(self, hole: str) -> None:
        self.hole, self.section, self.least = hole, self.section + 1, -1.0

    def line(self, label, depth, whole) -> bool:
        """Takes a line's signs; whether its depth is one of the hole's."""
        if not self.ids:
            self.ids.append(f"{NAMELESS}1")
        self.hole = self.hole or self.ids[0]
        if label:
            known = next((i for i in self.ids if label in i.replace("-", "").upper() or i.upper() in label), self.hole)
            if known != self.hole:
                self.turn(known)
        if depth != depth:  # no number: a label's line alone
            return False
        if self.before is not None and depth < self.before - SHALLOWER:
            following = self.ids.index(self.hole) + 1
            if following == len(self.ids):
                self.ids.append(f"{NAMELESS}{following + 1}")
            self.turn(self.ids[following])
        if not whole or depth <= self.least:
            return False
        self.least = self.before = depth
        return True


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows taken, of batches of _SIGNS and further columns, which stay with their rows."""
    reader, signs_ = None, len(_SIGNS.split(", "))
    for batch in batches:
        at, holes, sections = [], [], []
        for n, (doc, _, place, id_, label, depth, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(signs_)), strict=True)):
            if reader is None or reader.doc != doc:
                reader = _Reader(doc)
            if place is not None:
                reader.ids.append(id_)
            elif reader.line(label, float("nan") if depth is None else depth, whole):
                at.append(n)
                holes.append(reader.hole)
                sections.append(reader.section)
        taken = batch.take(pa.array(at, pa.int64()))
        rest = {batch.schema.names[c]: taken.column(c) for c in range(signs_, batch.num_columns)}
        yield pa.RecordBatch.from_pydict({"doc": taken.column(0), "line_no": taken.column(1), "hole": pa.array(holes, pa.string()), "section": pa.array(sections, pa.int32()), "bottom": taken.column(5), **rest})


def rows_of_holes(lines: DataFrame, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, line_no, hole, section, bottom): the rows of tables in lines (doc, line_no, text) with the hole they belong to. Columns of lines
    in `keep` (texts) stay.

    A document's reading starts at its first id (ids: doc, id, place); without ids holes are numbered. A label that agrees with an id turns to
    that hole; a row shallower than the last one taken turns to the next id, or to a new number when they are used up. A row that isn't
    deeper than the last of its section, or lacks cells, isn't taken. Null texts say nothing, rows without a document are left
    out, and of two lines of one number the smaller label, then depth, comes first.

    What a line means hangs on all lines before it, so a document is read in order; tasks read sorted documents as a stream and keep the ids of
    one, so a long document takes time but no memory.
    """
    said = signs(lines, ids, keep).where("doc IS NOT NULL").repartition("doc")
    ordered = said.sortWithinPartitions("doc", F.col("place").asc_nulls_last(), "line_no", "label", "depth", "whole")
    return ordered.select("doc", "line_no", "place", "id", "label", "depth", "whole", *keep).mapInArrow(_read, ", ".join([_FOUND, *[f"`{c}` string" for c in keep]]))


def soil_cell(text: Column) -> Column:
    """The fifth cell of a table's row, which names the soil."""
    return F.get(F.split(F.trim(text), r"\|"), F.lit(5))


def soil_of_row(text: Column) -> Column:
    """The soil's name in the fifth cell of a table's row."""
    return soil_of_cell(soil_cell(text))


def soil_of_cell(raw: Column) -> Column:
    cell = F.replace(F.trim(raw), F.lit("<br>"), F.lit(" "))
    whole = F.replace(F.coalesce(compatible(cell), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(whole.contains("풍화암"), F.lit("풍화암")).otherwise(page_name(cell))


def intervals_of_rows(rows: DataFrame) -> DataFrame:
    """Rows with top, the bottom before it in its section, 0 for the first; of equal bottoms the first line counts."""
    order = Window.partitionBy("doc", "hole", "section").orderBy("bottom", "line_no")
    kept = rows.withColumn("_before", F.lag("bottom").over(order)).where("_before IS NULL OR _before <> bottom").drop("_before")
    return kept.withColumn("top", F.coalesce(F.lag("bottom").over(order), F.lit(0.0)))
