"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are sets of distinct word n-grams, as hashes of 52 bits; equal rows are one class from the start.

Columns are put in one order for all rows, rarest first as a count sketch of the whole corpus sees it. Of a row of n columns
only the first are multiplied, n - ceil(T * n) + 1 and a few more: what two rows with Jaccard >= T have in common can't lie in
the rest alone. Entries of the product are overlap counts of pairs; a pair below the overlap that its sizes call for is
discarded, and the others' whole rows are intersected.

A group of many near copies would fill the product with all its pairs. So each column first links its members to one of them
only, the one with the fewest columns of its own: an original has none, while each copy begins with those of its edits. What
these links join isn't multiplied among itself any more. Between components, a column of few members gives its pairs as rows;
the columns of many members are taken in blocks, one for each hub, and a block's product of two tiles of rows is a matrix
product inside a task. It returns only pairs whose count, with what the two may share outside the block, meets the bound, so
what leaves a block doesn't grow with the square of a group. No link between two components is lost, and components are all
that is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.llm import textbytes as tb
from terrakern.llm.common import WORD, cut, table
from terrakern.llm.components import components

WORDS = 5
HASH_BITS, SKETCH_BITS, SLICE = 52, 18, 4096
FILTER_BITS = 23
#: Members from which a column is multiplied in a block; rows and entries of a block's tile, on average.
CROWD, TILE_ROWS, TILE_ENTRIES = 9, 2048, 1 << 20
#: Pairs of entries in a column of two tiles above which they are multiplied as a matrix; columns taken at a time.
DENSE, COLUMNS = 4096, 1024
#: Classes that a task remembers, so as not to give their entries again.
REMEMBERED = 1 << 16
#: A text of a slice of texts takes the bits above a hash.
TEXTS = 1 << (64 - HASH_BITS)
_U = np.uint64
_MASK = _U((1 << HASH_BITS) - 1)


def shingle_sets(column: pa.Array, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: their numbers in the column, set sizes, and all their sets' hashes, ascending within each text.

    With `chosen`, a mask, the other texts have empty sets.
    """
    data, offsets = tb.texts(column)
    for lo, hi in tb.slices(offsets):
        for a in range(lo, hi, TEXTS):
            b = min(hi, a + TEXTS)
            if chosen is not None and not chosen[a:b].any():
                continue
            bounds = offsets[a : b + 1] - offsets[a]
            part = tb.LOWER[data[offsets[a] : offsets[b]]]
            starts, ends, text = tb.word_spans(part, bounds)
            if chosen is not None:
                keep = chosen[a:b][text]
                starts, ends, text = starts[keep], ends[keep], text[keep]
            h, owner = tb.shingles(tb.word_hashes(part, starts, ends), text, b - a, WORDS)
            key = (owner.astype(_U) << _U(HASH_BITS)) | (h >> _U(64 - HASH_BITS))
            key.sort()
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            sizes = np.bincount((key >> _U(HASH_BITS)).astype(np.int64), minlength=b - a)
            yield np.arange(a, b), sizes, key & _MASK


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    running = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
    ends = np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def _class_of(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that depends on its members alone."""
    first, second = _sums(tb.mix(h + _U(1)), sizes), _sums(tb.mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), sizes)
    return tb.mix(tb.mix(first + sizes.astype(_U)) ^ second).view(np.int64)


def _classes(docs: DataFrame) -> DataFrame:
    """A row (id, text_hash, n, cls) for each document, and a task's rows (part, counts) of the sketch of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["id", "text_hash", "n", "cls", "part", "counts"]
        for batch in batches:
            for rows, sizes, h in shingle_sets(batch.column(2)):
                sketch += np.bincount((h >> _U(HASH_BITS - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
                given, empty = [batch.column(k).slice(int(rows[0]), len(rows)) for k in (0, 1)], pa.nulls(len(rows))
                made = [*given, pa.array(sizes), pa.array(_class_of(sizes, h)), empty.cast(pa.int32()), empty.cast(pa.list_(pa.int32()))]
                yield pa.record_batch(made, names)
        parts = np.flatnonzero(sketch.reshape(-1, SLICE).any(axis=1)).astype(np.int32)
        if len(parts):
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * SLICE), pa.array(sketch.reshape(-1, SLICE)[parts].ravel()))
            empty = pa.nulls(len(parts)).cast(pa.int64())
            yield pa.record_batch([empty, empty, empty, empty, pa.array(parts), counts], names)

    rows = docs.select("id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "id long, text_hash long, n long, cls long, part int, counts array<int>")


def _ranks(classes: DataFrame) -> np.ndarray:
    """A rank of 0 to 255 for each cell of the sketch, higher for commoner columns: 2 ** SKETCH_BITS numbers, whatever the corpus."""
    cells = classes.where(F.col("part").isNotNull()).select("part", F.posexplode("counts").alias("at", "count")).where("count > 0")
    summed = cells.groupBy("part", "at").agg(F.sum("count").alias("count"))
    rank = F.least(F.floor(F.log2("count") * 8), F.lit(255)).cast("int")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = summed.select((F.col("part") * SLICE + F.col("at")).alias("cell"), rank.alias("rank")).toArrow()
    out[rows["cell"].to_numpy()] = rows["rank"].to_numpy()
    return out


def _suffix(n: np.ndarray | Column, floor) -> np.ndarray | Column:
    """Columns of a row of n that aren't multiplied: ceil(0.8 * n) less the shared columns that are asked of a pair's firsts."""
    return floor((n * 4 + 4) / 5) - 1 - floor(n / 32)


def _entries(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(h, cls, n) for the first columns of each class; a task gives a class once while it remembers it."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for batch in batches:
            for _, sizes, h in shingle_sets(batch.column(0)):
                cls = _class_of(sizes, h)
                fresh = np.zeros(len(cls), bool)
                for k, c in enumerate(cls.tolist()):
                    if sizes[k] and c not in seen:
                        seen[c] = None
                        fresh[k] = True
                        if len(seen) > REMEMBERED:
                            del seen[next(iter(seen))]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                keep = fresh[owner]
                h, owner = h[keep], owner[keep]
                rank = shared.value[(h >> _U(HASH_BITS - SKETCH_BITS)).astype(np.int64)].astype(_U)
                # Ties of the packed key fall back on the hash, by which the rows are sorted already.
                order = np.argsort((owner.astype(_U) << _U(HASH_BITS)) | (rank << _U(HASH_BITS - 8)) | (h >> _U(8)), kind="stable")
                h, owner = h[order], owner[order]
                kept = np.where(fresh, sizes, 0)
                place = np.arange(len(h)) - (np.cumsum(kept) - kept)[owner]
                first = place < (sizes - _suffix(sizes, np.floor).astype(np.int64))[owner]
                h, owner = h[first], owner[first]
                if len(h):
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(cls[owner]), pa.array(sizes[owner].astype(np.int32))], ["h", "cls", "n"])

    return docs.select("text").mapInArrow(run, "h long, cls long, n int")


def _least_overlap(a: str, b: str) -> Column:
    """9 * overlap >= 4 * (n_a + n_b) is Jaccard >= 0.8."""
    return F.ceil((F.col(a) + F.col(b)) * 4 / 9)


def _bounded(pairs: DataFrame, shared: Column) -> DataFrame:
    """Of (a, b, n_a, n_b, ...), those whose sizes allow a link and whose first columns may share, by `shared`, what one needs."""
    sizes = (F.col("n_a") * 5 >= F.col("n_b") * 4) & (F.col("n_b") * 5 >= F.col("n_a") * 4)
    need = _least_overlap("n_a", "n_b") - F.greatest(_suffix(F.col("n_a"), F.floor), _suffix(F.col("n_b"), F.floor))
    return pairs.where(sizes & (shared >= need))


def _sparse_pairs(light: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of rows of different components that meet in a column of few members, the smaller first. light:
    (h, cls, n, c, elsewhere), the last counting a row's columns of many members, where two rows may share more."""
    a, b = light.alias("a"), light.alias("b")
    ordered = F.expr("(a.n < b.n OR (a.n = b.n AND a.cls < b.cls)) AND a.c <> b.c AND a.n * 5 >= b.n * 4")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & ordered)
    more = F.least("a.elsewhere", "b.elsewhere")
    met = met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), more.alias("more"))
    counted = met.groupBy("a", "b", "n_a", "n_b", "more").agg(F.count(F.lit(1)).alias("shared"))
    return _bounded(counted, F.col("shared") + F.col("more")).select("a", "b", "n_a", "n_b")


def _tiled(crowd: DataFrame) -> DataFrame:
    """Rows of blocks, (hub, cls, n, c, cols, elsewhere), dealt to products of two tiles: adds kind, i, j and side.

    A block's rows are those of its largest component and the others. The others meet each other (kind 0) and those of the
    largest (kind 1); the largest don't meet among themselves. Side 0 meets side 1; a tile by itself has side 2.
    """
    sizes = crowd.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.size("cols")).alias("_e"))
    tiles = lambda m, e: F.greatest(F.ceil(m / TILE_ROWS), F.ceil(e / TILE_ENTRIES)).cast("int")
    most = F.max(F.struct("_m", "c", "_e"))
    blocks = sizes.groupBy("hub").agg(most.alias("_most"), F.sum("_m").alias("_all"), F.sum("_e").alias("_all_e"))
    rest, rest_e = F.col("_all") - F.col("_most._m"), F.col("_all_e") - F.col("_most._e")
    blocks = blocks.where(rest > 0).select("hub", F.col("_most.c").alias("_c"), tiles(F.col("_most._m"), F.col("_most._e")).alias("_large"), tiles(rest, rest_e).alias("_rest"))
    rows = crowd.join(blocks, "hub").withColumn("_is_large", F.col("c") == F.col("_c"))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("_is_large"), F.col("_large")).otherwise(F.col("_rest"))).cast("int")
    rows = rows.withColumn("_own", own)

    def task(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("_own")
    among = F.transform(each("_rest"), lambda k: task(0, F.least(mine, k), F.greatest(mine, k), F.when(k == mine, 2).when(mine < k, 0).otherwise(1)))
    against = F.transform(each("_large"), lambda k: task(1, mine, k, F.lit(0)))
    large = F.transform(each("_rest"), lambda k: task(1, k, mine, F.lit(1)))
    rows = rows.withColumn("_task", F.explode(F.when(F.col("_is_large"), large).otherwise(F.concat(among, against))))
    return rows.select("hub", "cls", "n", "c", "cols", "elsewhere", "_task.*")


def _overlaps(row_a: np.ndarray, col_a: np.ndarray, row_b: np.ndarray, col_b: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The product of two sparse 0/1 matrices, given by the places of their entries: how many columns each two rows share."""
    columns = int(max(col_a.max(initial=-1), col_b.max(initial=-1))) + 1
    in_a, in_b = np.bincount(col_a, minlength=columns), np.bincount(col_b, minlength=columns)
    out = np.zeros(shape, np.float32)
    dense = np.flatnonzero(in_a * in_b > DENSE)
    number = np.full(columns, -1)
    for lo in range(0, len(dense), COLUMNS):
        some = dense[lo : lo + COLUMNS]
        number[:] = -1
        number[some] = np.arange(len(some))
        parts = []
        for row, col, n in ((row_a, col_a, shape[0]), (row_b, col_b, shape[1])):
            part, keep = np.zeros((n, len(some)), np.float32), number[col] >= 0
            part[row[keep], number[col[keep]]] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    few = (in_a * in_b > 0) & (in_a * in_b <= DENSE)
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    order_a = order_a[few[col_a[order_a]]]
    first_b, own_col = np.cumsum(in_b) - in_b, col_a[order_a]
    many = in_b[own_col]
    bounds = np.cumsum(many)
    at = 0
    while at < len(order_a):  # some four million pairs of entries at a time
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + (1 << 22), "right")))
        m = many[at:to]
        place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - first_b[own_col[at:to]], m)
        pairs = np.repeat(row_a[order_a[at:to]], m) * shape[1] + row_b[order_b[place]]
        out += np.bincount(pairs, minlength=shape[0] * shape[1]).reshape(shape)
        at = to
    return out


def _multiplied(group: pa.Table) -> pa.Table:
    """Pairs (a, b, n_a, n_b), the smaller first, of two tiles whose counts meet the bound."""
    cls, n, c, side, elsewhere = (group.column(x).to_numpy() for x in ("cls", "n", "c", "side", "elsewhere"))
    cols = group.column("cols").combine_chunks()
    many = cols.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(cls)), many)
    _, col = np.unique(cols.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    alone = bool((side == 2).any())
    a, b = (np.flatnonzero(side == 2),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    place, entries = np.zeros(len(cls), np.int64), []
    for rows in (a, b):
        place[rows] = np.arange(len(rows))
        chosen = np.zeros(len(cls), bool)
        chosen[rows] = True
        keep = chosen[owner]
        entries += [place[owner[keep]], col[keep]]
    shared = _overlaps(*entries, (len(a), len(b)))
    left, right = [], []
    out = elsewhere.astype(np.float32)
    for lo in range(0, len(a), 256):
        x, y = n[a[lo : lo + 256], None].astype(np.int64), n[b][None, :].astype(np.int64)
        need = -(-(x + y) * 4 // 9) - np.maximum(_suffix(x, np.floor), _suffix(y, np.floor))
        fits = (x * 5 >= y * 4) & (y * 5 >= x * 4) & (c[a[lo : lo + 256], None] != c[b][None, :])
        fits &= shared[lo : lo + 256] > 0
        fits &= shared[lo : lo + 256] + np.minimum(out[a[lo : lo + 256], None], out[b][None, :]) >= need
        i, j = np.nonzero(fits)
        if alone:
            i, j = i[i + lo < j], j[i + lo < j]
        left.append(a[i + lo])
        right.append(b[j])
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    swap = (n[left] > n[right]) | ((n[left] == n[right]) & (cls[left] > cls[right]))
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    return pa.table({"a": cls[left], "b": cls[right], "n_a": n[left], "n_b": n[right]})


def _dense_pairs(crowd: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of rows of different components that meet in columns of many members. crowd: (h, hub, cls, n, c, total),
    the last counting all columns in which a row may meet another component."""
    rows = crowd.groupBy("hub", "cls").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.collect_list("h").alias("cols"), F.first("total").alias("total"))
    rows = rows.withColumn("elsewhere", F.col("total") - F.size("cols")).drop("total")
    tiles = ["hub", "kind", "i", "j"]  # dealt by all four, or one task would get all tiles of a hub
    return _tiled(rows).repartition(*tiles).groupBy(*tiles).applyInArrow(_multiplied, "a long, b long, n_a int, n_b int").distinct()


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS bits, whatever the number of ids; more ids only let more strangers through."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {1 << FILTER_BITS}) % 64 AS INT))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _rows_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, members) of the classes in reps (id, cls): one pass over the texts, in which a bit filter passes few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_filter(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(_U)
        for batch in batches:
            bit = batch.column(1).to_numpy(zero_copy_only=False)
            chosen = (bits[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) == 1
            for rows, sizes, h in shingle_sets(batch.column(2), chosen):
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
                some = pa.array(chosen[rows] & (sizes > 0))
                made = pa.record_batch([pa.array(_class_of(sizes, h)), sets], ["cls", "members"])
                yield made.filter(some)

    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    found = docs.select("id", bit.alias("bit"), "text").mapInArrow(run, "cls long, members array<long>")
    return found.join(reps, "cls", "left_semi").groupBy("cls").agg(F.first("members").alias("members"))


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) of the pairs whose whole rows overlap enough."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = cut(_rows_of(docs, cut(reps.join(wanted, "cls", "left_semi"))))
    left, right = (sets.select(F.col("cls").alias(c), F.col("members").alias(f"_{c}")) for c in ("a", "b"))
    whole = pairs.join(left, "a").join(right, "b")
    return whole.where(F.size(F.array_intersect("_a", "_b")) >= _least_overlap("n_a", "n_b")).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text, ...).

    Words are lower-cased by A-Z alone. A text of fewer than five words is one shingle; a null or blank one has none and is
    linked with nothing. Rows of equal sets are linked, and pairs at the bound itself. component_id is the least id that links reach. Rows that repeat an id
    keep a row each; a null id stays null, and a component without any id has a null component_id. Whole texts are read.
    Further columns of docs are left out. An empty table gives an empty one.
    """
    return _placed(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"))).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"
    )


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id and n_shingles of every row of docs (doc_id, text, ...), as groups() has them: its first step alone, without links."""
    told = _classes(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")))
    return told.where(F.col("part").isNull()).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))


def _placed(docs: DataFrame) -> DataFrame:
    """(id, text_hash, n, c, component_id) of every row of docs (id, text); c names the component, null for an empty set."""
    told = cut(_classes(docs))
    rows = told.where(F.col("part").isNull()).select("id", "text_hash", "n", "cls")
    reps = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"))

    column = Window.partitionBy("h")
    entries = _entries(docs, _ranks(told))
    marked = entries.select("*", F.min("cls").over(column).alias("_lo"), F.max("cls").over(column).alias("_hi"))
    marked = cut(marked.where("_lo <> _hi").select("h", "cls", "n").distinct())
    own = marked.groupBy("cls").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("common"))
    own = own.select("cls", (F.col("n") - _suffix(F.col("n"), F.floor) - F.col("common")).alias("own"))
    hubs = marked.join(own, "cls").groupBy("h").agg(F.min(F.struct("own", "n", "cls")).alias("hub"))
    hubs = cut(hubs.select("h", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("n_hub")))
    swap = (F.col("n_hub") > F.col("n")) | ((F.col("n_hub") == F.col("n")) & (F.col("hub") > F.col("cls")))
    ends = {"a": ("hub", "cls"), "b": ("cls", "hub"), "n_a": ("n_hub", "n"), "n_b": ("n", "n_hub")}
    stars = marked.join(hubs, "h").where("cls <> hub").select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(c) for c, (x, y) in ends.items()])
    stars = stars.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    stars = cut(_bounded(stars, F.col("shared")).drop("shared"))
    edges = cut(_linked(stars, docs, reps))

    joined = components(edges).select(F.col("node").alias("cls"), "component")
    placed = marked.join(joined, "cls", "left").select("h", "cls", "n", F.coalesce("component", "cls").alias("c"))
    mixed = placed.groupBy("h").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("members")).where("_lo <> _hi")
    placed = cut(placed.join(mixed.select("h", "members"), "h"))
    crowded = F.col("members") >= CROWD
    totals = placed.groupBy("cls").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(crowded, 1)).alias("elsewhere"))
    sparse = _sparse_pairs(placed.where(~crowded).join(totals, "cls"))
    dense = _dense_pairs(placed.where(crowded).join(hubs.select("h", "hub"), "h").join(totals.select("cls", "total"), "cls"))
    across = cut(sparse.unionByName(dense).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    edges = edges.unionByName(_linked(across, docs, reps))

    joined = components(edges).select(F.col("node").alias("cls"), "component")
    by_class = reps.join(joined, "cls", "left").select("cls", "id", F.coalesce("component", "cls").alias("c"))
    smallest = by_class.groupBy("c").agg(F.min("id").alias("component_id"))
    by_class = by_class.select("cls", "c").join(smallest, "c")
    some = rows.where("n > 0").join(by_class, "cls").select("id", "text_hash", "n", "c", "component_id")
    none = rows.where("n = 0").select("id", "text_hash", "n", F.lit(None).cast("long").alias("c"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each group of linked texts, and every row with an empty set.

    A group's row is one of its least id; a group without ids keeps one row as well. Rows that repeat an id and belong to
    different groups are documents of their own and stay; of rows of one group that repeat the least id, the one with the
    least hash of its text stays, and of equal rows one. Rows with a null or blank text have nothing in common with any
    and all stay. Columns of docs may have any names. An empty table stays empty.
    """
    names = [f"_in_{k}" for k in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")])
    told = _placed(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")))
    key = ["_no_id", "_id", "_text"]
    one = F.struct(F.col("id").isNull().alias("_no_id"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_text"))
    kept = told.where("c IS NOT NULL").groupBy("c").agg(F.min(one).alias("_kept")).select("_kept.*").distinct()
    id_ = F.col(names[docs.columns.index("doc_id")]).cast("long")
    rows = docs.toDF(*names).withColumns({"_no_id": id_.isNull(), "_id": F.coalesce(id_, F.lit(0)), "_text": F.xxhash64(text)})
    words = F.coalesce(text, F.lit("")).rlike(WORD)
    chosen = rows.where(words).join(kept, key, "left_semi")
    chosen = chosen.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("_place = 1")
    return chosen.select(*names).unionByName(rows.where(~words).select(*names)).toDF(*docs.columns)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups() over all documents."""
    return groups(table(spark, sf_dir, "documents"))
