"""Hard negatives by a Voronoi-partitioned distributed nearest-neighbour join.

Inner products become distances by one more coordinate: a candidate x is laid at (x, sqrt(M^2 - |x|^2))
with M the largest norm, an anchor a at (a, 0), so |a - x|^2 = |a|^2 + M^2 - 2 a.x and a higher score
is a smaller distance.

1. At most ``MOST_PIVOTS`` rows, chosen by hash, are pivots. Every candidate belongs to the cell of
   its nearest pivot and keeps its distance to it; every anchor belongs to the group of the nearest
   of the first pivots, about ``ANCHORS_PER_GROUP`` anchors a group.
2. The pivots are rows themselves: an anchor's scores with them bound, before any join, the score
   that its last wanted neighbour has at least, so its neighbours lie within a distance of it.
3. By the triangle inequality a candidate at distance r from its pivot p can serve an anchor only if
   r is between near - |a p| or |a p| - far and |a p| + far. The widest such range over a group's
   anchors is the group's bound for the cell; candidates are copied only to the groups whose bound
   for their cell holds their r.
4. What meets in (group, cell, piece) is joined exactly in a task, and the first rows of every task
   are merged by a window.

This runs twice: for the positives with groups of one label, and for the negatives, where near and
far come from the band of scores that the positives allow. Groups of more than ``BLOCK_ANCHORS`` and
cells of more than ``PIECE_ROWS`` rows are split by hash, so no task holds more than one block and one
piece, however many rows share a vector; where the bounds tell nothing apart the join reads every
candidate once for each group, and stays exact.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite,
take no part; rows that repeat an id are one row, that of the least label and then vector; shorter
vectors count as filled up with zeros; scores are exact while they and their parts stay below 2^53;
a positive of negative score has no negatives; empty tables, or none without anchors, give empty
results; other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
MOST_PIVOTS, LEAST_PIVOTS, ROWS_PER_PIVOT = 256, 16, 2048
ANCHORS_PER_GROUP = 128
BLOCK_ANCHORS, PIECE_ROWS = 8192, 32768
CELLS_AT_ONCE = 2_000_000
KEY = ["grp", "part", "split", "cell", "piece"]
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, anchor: Column) -> DataFrame:
    """(vec_id, label, vec, anchor) of the rows that take part, one an id; vec holds doubles."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", "label", F.col("vec").cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").filter(~odd)
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec")
    return one.withColumn("anchor", F.coalesce(anchor, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = flat.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False)))).astype(np.int64)
    if len(values) == len(flat) * size:
        return values.reshape(len(flat), size)
    made = np.zeros((len(flat), size))
    for i in range(len(flat)):
        made[i, : ends[i + 1] - ends[i]] = values[ends[i] : ends[i + 1]]
    return made


def first_of_rows(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``count`` entries of every row by score, then id; -inf takes no part."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if scores.shape[1] > count:
        last = np.partition(scores, scores.shape[1] - count, axis=1)[:, scores.shape[1] - count]
        rows, columns = np.nonzero((scores >= last[:, None]) & (scores > -np.inf))
    else:
        rows, columns = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < count
    return rows[kept], columns[kept]


class Space:
    """Pivots in the space of distances, sent to the tasks; its size is bounded by ``MOST_PIVOTS``."""

    def __init__(self, rows: list, size: int, top: float, groups: int):
        self.size, self.top = size, top
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows])
        self.vectors = np.zeros((len(rows), size))
        for i, r in enumerate(rows):
            self.vectors[i, : len(r.vec)] = r.vec
        centres = np.unique(self.vectors, axis=0, return_index=True)[1]
        self.centres = self.vectors[np.sort(centres)]
        self.rise = np.sqrt(np.maximum(top - (self.centres**2).sum(axis=1), 0))
        self.groups = min(groups, len(self.centres))
        #: Room for rounding: distances are roots of differences of squares.
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def of_candidates(self, vectors: np.ndarray) -> np.ndarray:
        rise = np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (vectors @ self.centres.T + rise[:, None] * self.rise), 0))

    def of_anchors(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((vectors**2).sum(axis=1)[:, None] + self.top - 2 * (vectors @ self.centres.T), 0))

    def reach(self, vectors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a candidate has this score with an anchor."""
        return np.sqrt(np.maximum((vectors**2).sum(axis=1) + self.top - 2 * scores, 0))


def with_cells(rows: DataFrame, space: Space) -> DataFrame:
    """Add each row's cell and its distance to the cell's pivot."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                far = space.of_candidates(matrix(batch.column("vec"), space.size))
                cell = far.argmin(axis=1)
                more = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "r"])

    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(work, f"{kind}, cell int, r double")


def seeded(anchors: DataFrame, space: Space) -> DataFrame:
    """Add group, near and far of anchors that look for ``POSITIVES`` rows of their label."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids = matrix(batch.column("vec"), space.size), batch.column("vec_id").to_numpy(zero_copy_only=False)
            labels = np.array(batch.column("label").to_pylist())
            scores = np.where((labels[:, None] == space.labels) & (ids[:, None] != space.ids), vectors @ space.vectors.T, -np.inf)
            last = np.sort(scores, axis=1)[:, -POSITIVES] if scores.shape[1] >= POSITIVES else np.full(len(ids), -np.inf)
            group = space.of_anchors(vectors)[:, : space.groups].argmin(axis=1)
            more = [pa.array(group.astype(np.int32)), pa.array(np.full(len(ids), -np.inf)), pa.array(space.reach(vectors, last))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "grp", "near", "far"])

    kind = ", ".join(f"`{n}` {t}" for n, t in anchors.dtypes)
    return anchors.mapInArrow(work, f"{kind}, grp int, near double, far double")


def banded(anchors: DataFrame, space: Space) -> DataFrame:
    """near, far and each positive's lowest and highest score of anchors with their positives.

    Positives whose band is empty have a low above their high; anchors without any band are left out.
    """

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, labels = matrix(batch.column("vec"), space.size), np.array(batch.column("label").to_pylist())
            scores = np.where(labels[:, None] != space.labels, vectors @ space.vectors.T, -np.inf)
            lows, highs, near, far = [], [], [], []
            for own, found in zip(scores, batch.column("positive_scores").to_pylist(), strict=True):
                p = np.array(found, np.float64)
                low, high = np.ceil(LOW_PERCENT * p / 100), np.floor(HIGH_PERCENT * p / 100)
                for k in range(len(p)):
                    seen = np.sort(own[(own >= low[k]) & (own <= high[k])])
                    if len(seen) >= NEGATIVES:
                        low[k] = seen[-NEGATIVES]
                held = low <= high
                lows.append(low.tolist())
                highs.append(high.tolist())
                near.append(high[held].max() if held.any() else np.nan)
                far.append(low[held].min() if held.any() else np.nan)
            near, far = np.array(near), np.array(far)
            more = [pa.array(space.reach(vectors, near)), pa.array(space.reach(vectors, far)), pa.array(lows, pa.list_(pa.float64())), pa.array(highs, pa.list_(pa.float64()))]
            made = pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "near", "far", "lows", "highs"])
            yield made.filter(pa.array(~np.isnan(near)))

    kind = ", ".join(f"`{n}` {t}" for n, t in anchors.dtypes)
    return anchors.mapInArrow(work, f"{kind}, near double, far double, lows array<double>, highs array<double>")


def bounds_of(anchors: DataFrame, space: Space) -> DataFrame:
    """(grp, part, split, cell, low, high): distances to a cell's pivot that can serve one of the block's anchors."""
    kinds = dict(anchors.dtypes)

    def work(key, block):
        there = space.of_anchors(matrix(block.column("vec"), space.size))
        near, far = block.column("near").to_numpy()[:, None] - space.slack, block.column("far").to_numpy()[:, None] + space.slack
        low, high = np.maximum(near - there, there - far).min(axis=0), (there + far).max(axis=0)
        cells = np.arange(len(low), dtype=np.int32)
        same = [pa.array([k.as_py()] * len(cells), k.type) for k in key]
        return pa.Table.from_arrays([*same, pa.array(cells), pa.array(low), pa.array(high)], names=["grp", "part", "split", "cell", "low", "high"])

    return anchors.groupBy("grp", "part", "split").applyInArrow(work, f"grp int, part {kinds['part']}, split int, cell int, low double, high double")


def join_cells(anchors: DataFrame, cells: DataFrame, space: Space, local, schema: str) -> DataFrame:
    """Local joins of anchors (grp, part, near, far, vec, ...) with the candidates that can serve them.

    ``local`` joins one block of anchors with one piece of a cell; ``part`` has to be equal on both sides.
    """
    blocks = F.ceil(F.count("*") / BLOCK_ANCHORS).alias("blocks")
    dealt = anchors.join(anchors.groupBy("grp", "part").agg(blocks), ["grp", "part"])
    dealt = materialise(dealt.withColumn("split", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks"), "knn-anchors")
    pieces = materialise(cells.groupBy("cell", "part").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")), "knn-pieces")
    bounds = bounds_of(dealt, space).join(pieces, ["cell", "part"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    bounds = materialise(bounds, "knn-bounds")
    placed = cells.join(pieces, ["cell", "part"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int")).drop("pieces")
    served = placed.join(bounds, ["cell", "part", "piece"]).filter("r BETWEEN low AND high").select(*KEY, "vec_id", "label", "vec")
    asking = dealt.join(bounds.drop("low", "high"), ["grp", "part", "split"])
    return asking.groupBy(*KEY).cogroup(served.groupBy(*KEY)).applyInArrow(local, schema)


def _strips(anchors: pa.Table, candidates: pa.Table, size: int):
    """(first row, scores) of a block of anchors with all candidates, a few anchors at a time."""
    a, c = matrix(anchors.column("vec"), size), matrix(candidates.column("vec"), size)
    step = max(1, CELLS_AT_ONCE // max(len(c), 1))
    for at in range(0, len(a), step):
        yield at, a[at : at + step] @ c.T


def positives_of(anchors: DataFrame, cells: DataFrame, space: Space) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first ``POSITIVES`` other rows of an anchor's label."""

    def local(left, right):
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            owners, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            for at, scores in _strips(left, right, space.size):
                mine = owners[at : at + len(scores)]
                rows, columns = first_of_rows(np.where(mine[:, None] != ids, scores, -np.inf), ids, POSITIVES)
                for kept, values in zip(out, (mine[rows], ids[columns], scores[rows, columns]), strict=True):
                    kept.append(values)
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    asking = seeded(anchors, space).withColumn("part", F.col("label"))
    found = join_cells(asking, cells.withColumn("part", F.col("label")), space, local, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= POSITIVES).drop("n")


def negatives_of(anchors: DataFrame, positives: DataFrame, cells: DataFrame, space: Space) -> DataFrame:
    """The first ``NEGATIVES`` rows of another label within the band of every positive's score, ranked."""

    def local(left, right):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            owners, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            codes: dict = {}
            coded = [np.array([codes.setdefault(x, len(codes)) for x in t.column("label").to_pylist()]) for t in (left, right)]
            lists = [left.column(n).to_pylist() for n in ("positive_ids", "positive_scores", "lows", "highs")]
            most = max(map(len, lists[0]))
            wide = [np.array([[*x, *[fill] * (most - len(x))] for x in rows], kind) for rows, fill, kind in zip(lists, (0, 0, np.inf, -np.inf), (np.int64, np.int64, np.float64, np.float64), strict=True)]
            for at, scores in _strips(left, right, space.size):
                here = slice(at, at + len(scores))
                other = np.where(coded[0][here, None] != coded[1], scores, -np.inf)
                for k in range(most):
                    positive, told, low, high = (w[here, k] for w in wide)
                    rows, columns = first_of_rows(np.where((other >= low[:, None]) & (other <= high[:, None]), other, -np.inf), ids, NEGATIVES)
                    for kept, values in zip(out, (owners[here][rows], positive[rows], told[rows], ids[columns], scores[rows, columns]), strict=True):
                        kept.append(values)
        return _table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    listed = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))
    listed = listed.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    kind = dict(cells.dtypes)["label"]
    asking = banded(anchors.join(listed, "vec_id"), space).withColumn("part", F.lit(0).cast(kind))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = join_cells(asking, cells.withColumn("part", F.lit(0).cast(kind)), space, local, schema)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for n, c in zip(names, columns, strict=True)})


def hard_negatives(vectors: DataFrame, anchor: Column) -> DataFrame:
    """Ranked negatives of every anchor and positive; vectors: vec_id, label, vec, ``anchor`` tells anchors by them."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, anchor), "knn-rows")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    told = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(square).alias("top"), F.max(F.size("vec")).alias("size")).first()
    if not told.anchors:
        return spark.createDataFrame([], RESULT)
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, ceil(told.n / ROWS_PER_PIVOT)))
    pivots = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()  # bounded by MOST_PIVOTS
    space = Space(pivots, max(told["size"], 1), told.top, max(1, ceil(told.anchors / ANCHORS_PER_GROUP)))
    cells = materialise(with_cells(rows, space), "knn-cells")
    anchors = cells.filter("anchor").drop("anchor", "cell", "r")
    cells = cells.drop("anchor")
    positives = materialise(positives_of(anchors, cells, space), "knn-positives")
    grouped = seeded(anchors, space).drop("near", "far")
    return negatives_of(grouped, positives, cells, space)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.floor(x.cast("double") * 256)).cast("double"))
    return hard_negatives(read.select("vec_id", label.alias("label"), scaled.alias("vec")), F.col("vec_id") % 100 == 0)


OP13_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
 n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
 SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
