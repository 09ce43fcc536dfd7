"""Near-duplicate embeddings by an exact metric range join.

Cosine at least T is Euclidean distance at most r = sqrt(2 - 2 * T) between unit vectors. Pivots part the vectors into cells,
each vector going home to its nearest pivot. By the triangle inequality a vector y at home with pivot j can only be within r of
some x at home with i if y . (p_j - p_i) <= r * |p_j - p_i|, and if its angle to p_i is at most the widest of cell i plus that of
the range. Where both hold it is copied to cell i; of two cells only the later copies to the earlier, so each pair meets once.
Cells join independently. A large cell is cut into blocks whose pairs are tasks of their own, so a task holds two blocks at
most. A task returns how many links each vector has and a spanning forest of the links, never the links themselves.

Pivots are one for each BLOCK vectors, and beyond BLOCK ** 2 vectors as many as the square root of their number, so neither the
cells nor the distances to pivots grow with the square of the table; they are worked on in slices of bounded size.

Equal vectors are one from the start and count by their number. They are stored once, in blocks of up to BLOCK near ones, a block
being one row. Without structure in the data copies would go to most cells, and the shuffle of them would grow with the square of
the table. The copies are counted first, and where they are more than a few, none is made: each block meets each other in a
cartesian product, whose tasks read the stored blocks and write nothing but links. The work is then that of all pairs, less the
runs of two blocks that are too far apart; that is the price of exactness, not a cap that drops any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm.common import sample, table
from terrakern.llm.components import components
from terrakern.operators.materialise import stored

COSINE = 0.9
BLOCK = 4096
#: Bytes of pivots sent to tasks, and distances to pivots held at a time.
PIVOT_BYTES, NEAR = 64 << 20, 1 << 21
#: Bytes of a block of vectors as doubles, blocks that are put in order together and that a task keeps; rows of a run that is held against others as one.
BLOCK_BYTES, CHUNK, KEPT = 2 << 20, 8, 32
RUN = 256
#: Rows that may be dealt to tasks for each vector.
DEALT = 1.2
_SLACK = 1e-9


def _unit(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    raw = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


@dataclass(frozen=True)
class Cells:
    pivots: np.ndarray
    cosine: float
    widest: np.ndarray | None = None  # angle of each cell
    blocks: np.ndarray | None = None  # of those at home
    guests: np.ndarray | None = None  # blocks of those copied in
    first: np.ndarray | None = None  # number of the first task of each cell
    dealt: int = 0  # rows for tasks

    def slices(self, n: int) -> Iterator[slice]:
        step = max(1, NEAR // len(self.pivots))
        return (slice(lo, lo + step) for lo in range(0, n, step))

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Home and angle of each vector, and the earlier cells that it is copied to: numbers of vectors and of cells."""
        home, angle, guests = np.empty(len(u), np.int64), np.empty(len(u)), [(np.empty(0, np.int64),) * 2]
        reach, number = np.sqrt(2 - 2 * self.cosine), np.arange(len(self.pivots))
        for part in self.slices(len(u)):
            near = u[part] @ self.pivots.T
            own = near.argmax(axis=1)
            best = near[np.arange(len(own)), own]
            homes, which = np.unique(own, return_inverse=True)
            apart = np.sqrt(np.maximum(2 - 2 * self.pivots[homes] @ self.pivots.T, 0))
            guest = (best[:, None] - near <= reach * apart[which] + _SLACK) & (number < own[:, None])
            if self.widest is not None:
                guest &= np.arccos(np.clip(near, -1, 1)) <= self.widest + np.arccos(self.cosine) + 1e-6
            home[part], angle[part] = own, np.arccos(np.clip(best, -1, 1))
            rows, cells = np.nonzero(guest)
            guests.append((rows + part.start, cells))
        return home, angle, tuple(np.concatenate(x) for x in zip(*guests, strict=True))


def _survey(vectors: DataFrame, cells: Cells, dim: int) -> Cells:
    """Counts who is at home in each cell and who is copied to it: one row for each pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    k = len(cells.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home, guests, widest = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            home, angle, guest = shared.value.place(_unit(batch, 0, dim))
            at_home += np.bincount(home, minlength=k)
            guests += np.bincount(guest[1], minlength=k)
            np.maximum.at(widest, home, angle)
        yield pa.record_batch([pa.array(np.arange(k)), pa.array(at_home), pa.array(guests), pa.array(widest)], ["cell", "home", "guests", "widest"])

    rows = vectors.select("v").mapInArrow(run, "cell long, home long, guests long, widest double")
    rows = rows.groupBy("cell").agg(F.sum("home").alias("home"), F.sum("guests").alias("guests"), F.max("widest").alias("widest")).toPandas().set_index("cell").reindex(range(k), fill_value=0)
    blocks, guests = -(-rows["home"].to_numpy() // BLOCK), -(-rows["guests"].to_numpy() // BLOCK)
    tasks = blocks * (blocks + 1) // 2 + blocks * guests
    dealt = int((rows["home"].to_numpy() * (blocks + guests) + rows["guests"].to_numpy() * blocks).sum())
    return Cells(cells.pivots, cells.cosine, rows["widest"].to_numpy(), blocks, guests, np.cumsum(tasks) - tasks, dealt)


def _deal(vectors: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """(task, side, cls, many, v): each vector for each task that needs it. Side 0 meets side 1; a task of one block has side 2."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            home, _, guest = c.place(_unit(batch, 2, dim))
            draw = batch.column(0).to_numpy().view(np.uint64)
            row, task, side = [], [], []
            for cell in np.unique(home):
                rows = np.flatnonzero(home == cell)
                n, m = int(c.blocks[cell]), int(c.guests[cell])
                own = (draw[rows] % np.uint64(n)).astype(np.int64)
                for other in range(n):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    row.append(rows)
                    task.append(c.first[cell] + low * n - low * (low - 1) // 2 + high - low)
                    side.append(np.where(own == other, 2, np.where(own < other, 0, 1)))
                for other in range(m):
                    row.append(rows)
                    task.append(c.first[cell] + n * (n + 1) // 2 + own * m + other)
                    side.append(np.zeros(len(rows), np.int64))
            for cell in np.unique(guest[1]):
                rows = guest[0][guest[1] == cell]
                n, m = int(c.blocks[cell]), int(c.guests[cell])
                own = (draw[rows] % np.uint64(max(m, 1))).astype(np.int64)
                for other in range(n):
                    row.append(rows)
                    task.append(c.first[cell] + n * (n + 1) // 2 + other * m + own)
                    side.append(np.ones(len(rows), np.int64))
            if row:
                at = np.concatenate(row)
                for lo in range(0, len(at), BLOCK):
                    some = pa.array(at[lo : lo + BLOCK])
                    fixed = [pa.array(np.concatenate(x)[lo : lo + BLOCK]) for x in (task, side)]
                    yield pa.record_batch([fixed[0], fixed[1].cast(pa.int8()), *[batch.column(i).take(some) for i in range(3)]], ["task", "side", "cls", "many", "v"])

    return vectors.select("cls", "many", "v").mapInArrow(run, f"task long, side byte, cls long, many long, v {kind}")


def _forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a bipartite 0/1 matrix joins, each row being looked at once."""
    out, open_rows, open_cols = [], hits.any(axis=1), np.ones(hits.shape[1], bool)
    for seed in np.flatnonzero(open_rows).tolist():
        if not open_rows[seed]:
            continue
        open_rows[seed] = False
        rows = np.array([seed])
        while len(rows):
            cols = np.flatnonzero(hits[rows].any(axis=0) & open_cols)
            open_cols[cols] = False
            out += [(int(left[seed]), int(x)) for x in right[cols]]
            rows = np.flatnonzero(hits[:, cols].any(axis=1) & open_rows) if len(cols) else cols
            open_rows[rows] = False
            out += [(int(left[seed]), int(x)) for x in left[rows]]
    return out


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction for each run of RUN rows, and the widest angle of the run's rows to it."""
    starts = np.arange(0, len(u), RUN)
    middle = np.add.reduceat(u, starts, axis=0)
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-300)
    angles = np.arccos(np.clip(np.einsum("ij,ij->i", u, np.repeat(middle, RUN, axis=0)[: len(u)]), -1, 1))
    return middle, np.where(np.linalg.norm(middle, axis=1) > 0.5, np.maximum.reduceat(angles, starts), np.pi)


def _links(cosine: float, u: np.ndarray, v: np.ndarray, cls: tuple[np.ndarray, np.ndarray], many: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cls, n, other: how many links the vectors of two blocks have with the other block, and a forest of these links (n is 0). A block meets
    itself where both are one array. Single precision only says which rows and columns are held against the bound in double precision."""
    alone = u is v
    hits = np.zeros((len(u), len(v)), bool)
    of_u, of_v, weight = np.zeros(len(u)), np.zeros(len(v)), [m.astype(np.float64) for m in many]
    rough, columns = cosine - (u.shape[1] + 8) * 2.0**-22, v.astype(np.float32)
    (at, wide), (to, broad) = _runs(u), _runs(v)
    near = np.arccos(np.clip(at @ to.T, -1, 1)) <= wide[:, None] + broad + np.arccos(cosine) + 1e-6
    for i in np.flatnonzero(near.any(axis=1)):
        rows = np.arange(i * RUN, min((i + 1) * RUN, len(u)))
        met = np.flatnonzero(np.repeat(near[i], RUN)[: len(v)])
        maybe = u[rows].astype(np.float32) @ (columns if len(met) == len(v) else columns[met]).T >= rough
        rows, met = rows[maybe.any(axis=1)], met[maybe.any(axis=0)]
        if not len(rows):
            continue
        some = u[rows] @ v[met].T >= cosine
        if alone:
            some &= rows[:, None] != met
        hits[np.ix_(rows, met)] = some
        count = some.astype(np.float64)
        of_u[rows] += count @ weight[1][met]
        of_v[met] += weight[0][rows] @ count
    rows, met = np.flatnonzero(of_u), np.flatnonzero(of_v)
    edges = np.array(_forest(hits[np.ix_(rows, met)], cls[0][rows], cls[1][met]) if len(rows) else [], np.int64).reshape(-1, 2)
    who, count = ([cls[0][rows]], [of_u[rows]]) if alone else ([cls[0][rows], cls[1][met]], [of_u[rows], of_v[met]])
    who, count = np.concatenate(who), np.concatenate(count).astype(np.int64)
    return np.concatenate((who, edges[:, 0])), np.concatenate((count, np.zeros(len(edges), np.int64))), np.concatenate((who, edges[:, 1]))


def _join(cosine: float, dim: int):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        cls, many = group.column("cls").to_numpy(), group.column("many").to_numpy()
        u = np.concatenate([_unit(b, 0, dim) for b in group.select(["v"]).to_batches()])
        a, b = (np.flatnonzero(side == 2),) * 2 if (side == 2).any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        left = u[a]
        return pa.table(dict(zip(("cls", "n", "other"), _links(cosine, left, left if a is b else u[b], (cls[a], cls[b]), (many[a], many[b])), strict=True)))

    return run


def _kind(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["v"].dataType.simpleString() == "array<float>" else np.float64


def _rows(dim: int) -> int:
    """Of a block."""
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))


def _packed(vectors: DataFrame, dim: int) -> DataFrame:
    """(block, n, cls, many, v): the vectors (cls, many, v) in blocks of rows near each other, a block's columns being one value each."""
    kind, rows = _kind(vectors), _rows(dim)

    def blocks(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        cls, many = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        raw = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) for b in held])
        u = np.concatenate([_unit(b, 2, dim) for b in held]).astype(np.float32)
        pivots = u[:: -(-len(u) // RUN)].T
        home = np.concatenate([(u[lo : lo + RUN] @ pivots).argmax(axis=1) for lo in range(0, len(u), RUN)])
        for at in np.array_split(np.argsort(home, kind="stable"), -(-len(u) // rows)):
            yield pa.record_batch([pa.array([number]), pa.array([len(at)]), *[pa.array([x[at].tobytes()], pa.binary()) for x in (cls, many, raw)]], ["block", "n", "cls", "many", "v"])
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, n = [], TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                held.append(batch.slice(lo, rows))
                n += held[-1].num_rows
                if n >= CHUNK * rows:
                    for block in blocks(held, number):
                        number += 1
                        yield block
                    held, n = [], 0
        if n:
            yield from blocks(held, number)

    return vectors.select("cls", "many", "v").mapInArrow(run, "block long, n long, cls binary, many binary, v binary")


def _unpacked(blocks: DataFrame, dim: int, kind: type) -> DataFrame:
    """(cls, many, v) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *columns in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                cls, many, v = (np.frombuffer(x, t) for x, t in zip(columns, (np.int64, np.int64, kind), strict=True))
                yield pa.record_batch([pa.array(cls), pa.array(many), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(v))], ["cls", "many", "v"])

    return blocks.select("n", "cls", "many", "v").mapInArrow(run, f"cls long, many long, v array<{'float' if kind is np.float32 else 'double'}>")


def _product(blocks: DataFrame, cosine: float, dim: int, kind: type) -> DataFrame:
    """(cls, n, other) of all pairs of blocks: nothing is shuffled, a task reads its blocks where they are stored and keeps KEPT of them or so."""
    n, spread = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    few = blocks.coalesce(max(-(-n // KEPT), min(n, 2 * math.ceil(math.sqrt(spread)))))
    left, right = (few.select(*[F.col(c).alias(f"{c}{side}") for c in ("block", "cls", "many", "v")]) for side in "01")
    even = (F.shiftright("block0", 32) + F.shiftright("block1", 32) + F.col("block0") + F.col("block1")) % 2 == 0
    once = (F.col("block0") == F.col("block1")) | ((F.col("block0") < F.col("block1")) == even)  # of (a, b) and (b, a) one, by turns, so tasks are alike
    pairs = left.join(right, once).select("block0", "cls0", "many0", "v0", "block1", "cls1", "many1", "v1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for first in (0, 4):
                    cls, many, v = (np.frombuffer(batch.column(first + i)[row].as_buffer(), t) for i, t in ((1, np.int64), (2, np.int64), (3, kind)))
                    u = v.reshape(-1, dim).astype(np.float64)
                    sides.append((cls, many, u / np.linalg.norm(u, axis=1, keepdims=True)))
                if batch.column(0)[row] == batch.column(4)[row]:
                    sides[1] = sides[0]
                (cls, many, u), (other, times, v) = sides
                found = _links(cosine, u, v, (cls, other), (many, times))
                if len(found[0]):
                    yield pa.record_batch([pa.array(x) for x in found], ["cls", "n", "other"])

    return pairs.mapInArrow(run, "cls long, n long, other long")


def _meet(blocks: DataFrame, cosine: float, dim: int, kind: type) -> DataFrame:
    """(cls, n, other): for each task, the links of a vector (other is itself), and edges of its forest (n is 0)."""
    spark, vectors = blocks.sparkSession, _unpacked(blocks, dim, kind)
    total = blocks.agg(F.sum("n")).first()[0]
    k = int(min(max(1, -(-total // BLOCK)), max(1, math.ceil(math.sqrt(total))), max(1, PIVOT_BYTES // (8 * dim))))
    chosen = sample(vectors, ["cls"], k).select("v").collect()
    pivots = np.array([r["v"] for r in chosen], np.float64)
    cells = Cells(pivots / np.linalg.norm(pivots, axis=1, keepdims=True), cosine)
    cells = _survey(vectors, cells, dim)
    cells = _survey(vectors, cells, dim)  # again: the widest angles of the first keep more away
    if cells.dealt > DEALT * total:
        return _product(blocks, cosine, dim, kind)
    n = int((cells.blocks * (cells.blocks + 1) // 2 + cells.blocks * cells.guests).sum())
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, 100_000))
    dealt = _deal(vectors, cells, dim).repartition(spread, "task")
    return dealt.groupBy("task").applyInArrow(_join(cosine, dim), "cls long, n long, other long")


def near_duplicates(table_: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of table_ (vec_id, embedding, ...).

    A vector that is null, empty or zero, or holds a null or non-finite component, links with nothing; vectors of different
    lengths don't link. n_links counts other rows, equal vectors included. component_id is the least vec_id that links reach;
    kept says whether it is the row's own. Rows that repeat an id keep a row each. A null id stays null and isn't kept; a
    component without any id has a null component_id. Further columns are left out. A pair at the bound itself is linked; equal
    ids tie, so both rows name the same component. An empty table gives an empty one. table_ is read more than once, so that its
    vectors are stored only in blocks.
    """
    spark, vec, e = table_.sparkSession, F.col("vec_id").cast("long"), F.col("embedding")
    number = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(e.isNotNull() & number & F.exists(e, lambda x: x != 0), F.lit(False))
    cls = F.when(sound, F.xxhash64(e))
    rows = stored(table_.select(vec.alias("vec_id"), cls.alias("cls"), F.when(sound, F.size(e)).alias("dim")))
    met = None
    for (dim, n) in rows.where("dim IS NOT NULL").groupBy("dim").count().orderBy("dim").collect():
        vectors = table_.where(sound & (F.size(e) == dim)).select(cls.alias("cls"), e.alias("v")).groupBy("cls", "v").agg(F.count(F.lit(1)).alias("many"))
        tasks = max(-(-n // (CHUNK * _rows(dim))), min(-(-n // _rows(dim)), spark.sparkContext.defaultParallelism))
        part = _meet(stored(_packed(vectors.coalesce(tasks), dim)), cosine, dim, _kind(vectors))
        met = part if met is None else met.unionByName(part)
    if met is None:
        return table_.select(vec.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), vec.alias("component_id"), vec.isNotNull().alias("kept"))
    met = stored(met)
    joined = components(met.where("n = 0").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    counts = met.where("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"))
    known = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    known = known.select("cls", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "cls").alias("c"))
    smallest = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "c").select("cls", "n_links", "component_id")
    linked = rows.where("cls IS NOT NULL").select("vec_id", "cls").join(known, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() over all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
