"""What follows the reading of pages: trees made flat, pipe tables, depths repaired, best readings, orders from sequences."""

from __future__ import annotations

import ast
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakern.functions import groundwater
from terrakern.operators.graph import components
from terrakern.operators.materialise import cut
from terrakern.operators.ordering import placed as numbered_in_order

ELEMENTS = "doc string, ord long, page int, type string, text string, x0 double, y0 double, x1 double, y1 double, row int, col int"


def elements_of(tree: dict) -> list[tuple]:
    """(page, type, text, x0, y0, x1, y1, row, col) of a layout tree's nodes that have a page, a box and text, in reading order.

    One pass with a stack of its own, so depth isn't bounded. A node's own string is its text; without one it is what its `kids`
    say, line by line. Page, row and column come from the nearest node above that has them; a table's cells take its row.
    """
    slots: list[tuple | None] = []
    texts: list[list[str]] = []
    opened: list[tuple[dict, tuple, list[int]]] = [(tree, (None, None, None), [])]
    while opened:
        node, (page, row, col), listeners = opened.pop()
        page = node.get("page number") or page
        row, col = row or node.get("row number"), col or node.get("column number")
        place = len(slots)
        said = next((node[k] for k in ("content", "text") if node.get(k)), None)
        texts.append([])
        if isinstance(said, str):
            for heard in [place, *listeners]:
                texts[heard].append(said.strip())
            told: list[int] = []
        else:
            told = [place, *listeners]
        box = node.get("bounding box")
        full = page is not None and isinstance(box, list) and len(box) == 4
        slots.append((page, str(node.get("type") or ""), *map(float, box), row, col) if full else None)
        if node.get("type") == "table":
            under = [(c, (page, r.get("row number"), c.get("column number")), []) for r in node.get("rows") or [] for c in r.get("cells") or []]
        else:
            under = [(c, (page, row, col), told if k == "kids" else []) for k in ("kids", "children", "content", "contents") if isinstance(node.get(k), list) for c in node[k] if isinstance(c, dict)]
        opened.extend(reversed(under))
    joined = ["\n".join(t for t in some if t) for some in texts]
    return [(s[0], s[1], t, *s[2:]) for s, t in zip(slots, joined, strict=True) if s and t]


def flattened(trees: DataFrame) -> DataFrame:
    """ELEMENTS of layout trees (doc, json), one document at a time. A text that isn't a JSON object has none."""

    def tree(text: str | None) -> dict:
        try:
            value = json.loads(text or "")
        except (ValueError, RecursionError):
            return {}
        return value if isinstance(value, dict) else {}


    names = [part.split()[0] for part in ELEMENTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, n, *e) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, e in enumerate(elements_of(tree(text)))]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return trees.select("doc", "json").mapInArrow(run, ELEMENTS)


def pipe_rows(lines: DataFrame) -> DataFrame:
    """Cells of the pipe-table lines of (doc, line_no, text), rulers left out."""
    text = F.trim("text")
    inner = F.regexp_replace(text, r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))
    kept = lines.where(text.startswith("|")).withColumn("cells", cells)
    return kept.where(~F.forall("cells", lambda c: c.rlike(r"^:?-*:?$"))).select("doc", "line_no", "cells")


def raw_object(raw: Column) -> Column:
    """map<string, string> of a JSON object; text written as a literal of another language is read by literal_objects."""
    return F.from_json(raw, "map<string,string>")


def literal_objects(df: DataFrame, raw: str, key: str) -> DataFrame:
    """(key, values) of texts that hold an object as JSON or as a Python literal; null for others."""

    def read(text):
        for reader in (json.loads, ast.literal_eval):
            try:
                value = reader(text)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            if isinstance(value, dict):
                return {str(k): None if v is None else str(v) for k, v in value.items()}
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "values": [read(t) for t in batch[raw]]})

    return df.select(key, raw).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, values map<string,string>")


def datum_of(unit: Column) -> Column:
    text = F.upper(F.replace(F.coalesce(unit, F.lit("")), F.lit(" "), F.lit("")))
    return F.when(text.contains("EL"), F.lit("EL")).when(text.contains("GL") | text.contains("-M"), F.lit("GL")).otherwise(F.lit("unknown"))


def label_confidence(row_gap: Column, has_unit: Column, embedded: Column) -> Column:
    """How sure a value beside a label is: by how level they are, by a unit, by how the text was read."""
    score = F.lit(0.75) + F.when(row_gap <= 3, 0.15).otherwise(0.0) + F.when(has_unit, 0.08).otherwise(0.0) + F.when(embedded, 0.02).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 2)


def best_reading(scored: dict[str, tuple[Column, Column]]) -> Column:
    """struct<source, text> of the reading (score, text) with the highest score; of equal ones the first."""
    some = [F.struct(score.alias("score"), F.lit(-n).alias("first"), F.struct(F.lit(name).alias("source"), text.alias("text")).alias("r")) for n, (name, (score, text)) in enumerate(scored.items())]
    return F.array_max(F.array(*some))["r"]


def repaired_depths(df: DataFrame, key: list[str], order: str, depth: str, candidates: DataFrame | None = None) -> DataFrame:
    """Bottoms whose decimal point was lost (12 for 1.2) read as the rest asks.

    A whole number of 10 or more may stand for its tenth or hundredth, or, of three digits led by 1, for the last two as tenths,
    if that is below the last corrected bottom. candidates (key, an array `depths`) are depths that the page shows elsewhere: a
    bottom that is one of them stays, unless it is the first and the next bottom contradicts it (is above the last and below
    this one); else a reading that is one of them is taken, the greatest above the next bottom or else the nearest to the
    tenth. Without such, a contradicted bottom takes its greatest reading above the next. The fold runs along a hole's bottoms.
    """
    if candidates is not None:
        df = df.join(candidates.select(*key, F.col("depths").alias("_known")), key, "left")
    else:
        df = df.withColumn("_known", F.array().cast("array<double>"))
    df = df.withColumn("_known", F.coalesce("_known", F.array().cast("array<double>")))
    lists = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, F.col(depth).alias("_d")))).alias("_rows"), F.first("_known").alias("_known"))

    def step(state: Column, i: Column) -> Column:
        d, at = F.get(rows["_d"], i), state["at"]
        following = F.get(rows["_d"], i + 1)
        whole = (d >= 10) & (F.abs(d - F.round(d)) <= 0.001)
        breaks = F.coalesce((following > at) & (following < d), F.lit(False))
        digits = F.round(d).cast("int").cast("string")
        led = (F.length(digits) == 3) & digits.startswith("1")
        shown = lambda t: F.exists(rows_known, lambda k: F.abs(k - t) <= 0.011)
        tries = F.array(F.round(d / 10, 2), F.when(d >= 100, F.round(d / 100, 2)), F.when(led, F.substring(digits, 2, 2).cast("double") / 10))
        fit = F.filter(tries, lambda t: t.isNotNull() & (t > at + 0.001))
        matched = F.filter(fit, shown)
        before = lambda some: F.array_max(F.filter(some, lambda t: t < following))
        nearest = F.array_min(F.transform(matched, lambda t: F.struct(F.abs(t - d / 10).alias("apart"), t.alias("t"))))["t"]
        stays = ~whole | (F.size(fit) == 0) | (shown(d) & (~breaks | (at > 0)))
        value = F.when(stays, d).when(F.size(matched) > 0, F.coalesce(before(matched), nearest)).when(breaks, F.coalesce(before(fit), d)).otherwise(d)
        return F.struct(value.alias("at"), F.concat(state["out"], F.array(value)).alias("out"))

    rows, rows_known = F.col("_rows"), F.col("_known")
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out"))
    made = lists.withColumn("_out", F.aggregate(F.sequence(F.lit(0), F.size("_rows") - 1), start, step)["out"])
    both = made.select(*key, F.explode(F.arrays_zip(F.col(f"_rows.{order}").alias(order), F.col("_out").alias(depth))).alias("_p"))
    return both.select(*key, F.col(f"_p.{order}").alias(order), F.col(f"_p.{depth}").alias(depth))


def new_hole_by_depth(previous: Column, top: Column, bottom: Column, zero_based: Column) -> Column:
    """Whether a page's first depths say that a new hole begins."""
    margin = F.greatest(F.lit(1.0), previous * 0.1)
    falls = bottom.isNotNull() & (top.isNull() | (top <= 1.0)) & (bottom <= previous - margin)
    return F.coalesce((previous >= 4.0) & (((previous >= 10.0) & zero_based) | falls), F.lit(False))


def sections_by_depth(df: DataFrame, key: list[str], order: list[str], top: str, bottom: str, zero_based: Column) -> DataFrame:
    """Adds section, from 0: rows of a key between the places where a depth says that a new hole begins."""
    w = Window.partitionBy(*key).orderBy(*order)
    begins = new_hole_by_depth(F.lag(bottom).over(w), F.col(top), F.col(bottom), zero_based)
    return df.withColumn("_b", begins.cast("int")).withColumn("section", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def precedence(sequences: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(upper, lower, n): how often a name stands right above another."""
    below = F.lead(name).over(Window.partitionBy(key).orderBy(order))
    return sequences.withColumn("lower", below).where(F.col("lower").isNotNull() & (F.col("lower") != F.col(name))).groupBy(F.col(name).alias("upper"), "lower").agg(F.count(F.lit(1)).alias("n"))


def topological(edges: DataFrame, nodes: DataFrame, rank: str = "rank") -> DataFrame:
    """(name, place): names (name, rank) in an order that all edges (upper, lower) keep, ties by rank and name; names in a cycle
    follow in order of rank.

    Names that edges join, over any number of steps, are walked together with a heap; each such component is a group of its own, and
    names without edges need no walk. Taking the least name that is free in any component is the order of the greatest rank that a
    component has given so far, so the whole is put together by a sort over ranges.
    """
    nodes = cut(nodes.groupBy("name").agg(F.min(F.col(rank).cast("double")).alias("rank")))
    pairs = edges.where("upper <> lower").select(F.col("upper").alias("a"), F.col("lower").alias("b")).distinct()
    pairs = cut(pairs.join(nodes.select(F.col("name").alias("a")), "a", "left_semi").join(nodes.select(F.col("name").alias("b")), "b", "left_semi"))
    parts = components(pairs).select(F.col("node").alias("name"), "component")
    joined = nodes.join(parts, "name").join(pairs.groupBy(F.col("a").alias("name")).agg(F.collect_list("b").alias("below")), "name", "left")

    def kahn(rows: pd.DataFrame) -> pd.DataFrame:
        ranks = {r.name: (r.rank, r.name) for r in rows.itertuples(index=False)}
        below = {r.name: list(r.below) if r.below is not None else [] for r in rows.itertuples(index=False)}
        waits = dict.fromkeys(ranks, 0)
        for some in below.values():
            for b in some:
                waits[b] += 1
        ready = [ranks[n] for n, w in waits.items() if not w]
        heapq.heapify(ready)
        out: list[tuple] = []
        reached = (-float("inf"), "")
        while ready:
            now = heapq.heappop(ready)
            reached = max(reached, now)
            out.append((now[1], False, *reached, len(out)))
            for b in below[now[1]]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, ranks[b])
        done = {o[0] for o in out}
        out += [(n, True, r, n, 0) for r, n in ranks.values() if n not in done]
        return pd.DataFrame(out, columns=["name", "circular", "reached", "by", "nth"])

    walked = joined.groupBy("component").applyInPandas(kahn, "name string, circular boolean, reached double, by string, nth long")
    lone = nodes.join(parts, "name", "left_anti").select("name", F.lit(False).alias("circular"), F.col("rank").alias("reached"), F.col("name").alias("by"), F.lit(0).cast("long").alias("nth"))
    order = [F.col(c) for c in ("circular", "reached", "by", "nth")]
    return numbered_in_order(walked.unionByName(lone), [], order).select("name", F.col("place").cast("int").alias("place"))


def by_upload(holes: DataFrame) -> DataFrame:
    """Adds group and place: holes that aren't new first, then uploads (job), the one first seen (ord) last coming first."""
    group = F.when(F.col("project_role") != "new", F.lit("existing")).otherwise(F.coalesce(F.concat(F.lit("upload-"), F.col("job").cast("string")), F.lit("manual")))
    named = holes.withColumn("group", group)
    first = named.groupBy("group").agg(F.min("ord").alias("_first"))
    order = numbered_in_order(first, [], [(F.col("group") != "existing").cast("int"), F.desc("_first")])
    return named.join(order.select("group", F.col("place").cast("int").alias("place")), "group")


def table_mode(df: DataFrame, mode: str, gap: Column, warned: Column, edited: Column, virtual: Column, new: Column) -> DataFrame:
    """Rows of a listing's mode: all, existing, new, virtual, warn or edited."""
    real = ~F.coalesce(virtual, F.lit(False))
    modes = {"all": real, "existing": real & ~new, "new": real & new, "virtual": ~real, "warn": real & ((gap >= 0.5) | warned), "edited": real & edited}
    return df.where(F.coalesce(modes[mode], F.lit(False)))


def legacy_depths(strata: DataFrame) -> DataFrame:
    """(borehole_id, ord, depth) written in the strata's texts."""
    return strata.select("borehole_id", "ord", groundwater.depth_in_text(F.col("raw_text")).alias("depth")).where("depth IS NOT NULL")
