"""Operator 3: embedding near-dedup by PCA-ordered tiled comparison.

Method: unit vectors are rotated to their principal axes, so that the leading
dimensions carry most of a product.  Tiles of vectors are compared pair by
pair: products over the leading dimensions are accumulated first, what the
remaining ones can add is bounded by the norms of the suffixes, and a pair of
vectors is dropped as soon as its cosine cannot reach the threshold; a pair of
tiles stops when no pair is left.  The leading products are made in single
precision, with the suffix norm as one more dimension, so that one product
gives the bound itself; a margin covers the rounding.  Survivors are verified
by the cosine of the given vectors in double precision, each scaled by a power
of two, which changes no quotient and keeps squares in range.

Equal vectors are one class (128-bit hash) with a count.  Tiles come from a tree of splits on
the leading axes, fitted on a bounded sample (SAMPLE vectors, the smallest by
hash); every vector goes to its own tile and, as a probe, to those other tiles
whose box it can reach (the squared distance to the box, over the split axes,
is at most 2 - 2 * threshold), so no link is lost and none is met twice.  A
tile with more than TILE vectors is compared in blocks, and blocks in squares
of SQUARE vectors a side.  The pairs of a square are folded into link counts and
a spanning forest before the next one; a task returns these, never its pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite numbers
link with nothing, and so do vectors of different lengths; a null id is kept
as a row of its own; repeated rows of one id and vector count as one; empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import stored, table

THRESHOLD = 0.95
SAMPLE, TILE, SQUARE, AXES, STEPS = 8192, 8192, 1024, 16, (16, 16, 32)
#: Added to bounds, against the rounding of rotated products.
MARGIN = 1e-9
#: A square with a larger share of surviving pairs goes on with whole products, as gathers would cost more.
DENSE = 0.02


def with_class(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, class): class is a 128-bit hash of the vector's entries, null where it can link with nothing."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    ok = (F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
          & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    name = F.unhex(F.format_string("%016x%016x", F.xxhash64("v"), F.xxhash64(F.lit("second half"), "v")))
    return vectors.select("vec_id", v.alias("v")).withColumn("class", F.when(F.coalesce(ok, F.lit(False)), name))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, safe against overflow."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest entry to [0.5, 1): cosines stay the same to the last bit."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def axes_of(sample: np.ndarray) -> np.ndarray:
    """Principal axes (columns), the strongest first.  Any rotation is right; this one stops early."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


class Tree:
    """Median splits on the leading axes until a leaf is expected to hold at most TILE vectors."""

    def __init__(self, sample: np.ndarray, total: int):
        self.leaves: list[list[tuple[float, float]]] = []
        whole = [(-np.inf, np.inf)] * min(AXES, sample.shape[1])
        self._split(sample, whole, total / max(1, len(sample)))
        self.low = np.array([[a for a, _ in box] for box in self.leaves])
        self.high = np.array([[b for _, b in box] for box in self.leaves])

    def _split(self, rows, box, weight):
        if len(rows) * weight <= TILE or len(rows) < 16:
            self.leaves.append(box)
            return
        axis = int(np.argmax(np.ptp(rows[:, : len(box)], axis=0)))
        cut = float(np.median(rows[:, axis]))
        below = rows[:, axis] < cut
        if not below.any() or below.all():
            self.leaves.append(box)
            return
        for part, side in ((below, (box[axis][0], cut)), (~below, (cut, box[axis][1]))):
            self._split(rows[part], [side if k == axis else b for k, b in enumerate(box)], weight)

    def reach(self, rows: np.ndarray, radius2: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of every row, and the later leaves whose box lies within the radius."""
        x = rows[:, None, : self.low.shape[1]]
        gap = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        own = ((x >= self.low) & (x < self.high)).all(2).argmax(1)
        near = (gap * gap).sum(2) <= radius2 + MARGIN
        near &= np.arange(len(self.low)) > own[:, None]
        return own, [np.flatnonzero(r) for r in near]


def leading(rows: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``to`` dimensions with the norm of the others as one more, and that norm, in single precision."""
    rest = np.linalg.norm(rows[:, to:], axis=1).astype(np.float32)[:, None]
    return np.hstack([rows[:, :to].astype(np.float32), rest]), rest


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may reach the threshold: leading dimensions first, suffix norms as the bound of the rest."""
    dims = a.shape[1]
    least = np.float32(threshold - (dims + 16) * 2.0 ** -23)  # below what rounding can take from a product
    ends = [e for e in np.cumsum(STEPS).tolist() if e < dims] + [dims]
    dot = None
    for k, to in enumerate(ends):
        (left, rest_a), (right, rest_b) = leading(a, to), leading(b, to)
        if dot is None:
            bound = left @ right.T
        else:
            at = ends[k - 1]
            dot += left[:, at:to] @ right[:, at:to].T
            bound = dot + rest_a * rest_b.T
        alive = bound >= least
        if same:
            alive = np.triu(alive, 1)
        if to == dims or np.count_nonzero(alive) <= DENSE * alive.size:
            break
        dot = bound - rest_a * rest_b.T if dot is None else dot
    i, j = np.nonzero(alive)
    at = 0 if to < dims else dims
    for to in ends[k:]:
        if at == dims or not len(i):
            break
        more = np.einsum("nd,nd->n", a[i, at:to], b[j, at:to])
        sums = more if at == 0 else sums + more
        ok = sums + np.linalg.norm(a[i, to:], axis=1) * np.linalg.norm(b[j, to:], axis=1) >= threshold - MARGIN
        i, j, sums, at = i[ok], j[ok], sums[ok], to
    return i, j


def verified(raw: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs whose cosine of the given vectors reaches the threshold."""
    keep = np.zeros(len(a), bool)
    for z in range(0, len(a), 1 << 14):
        p, q = raw[a[z:z + (1 << 14)]], raw[b[z:z + (1 << 14)]]
        norms = np.sqrt(np.einsum("nd,nd->n", p, p)) * np.sqrt(np.einsum("nd,nd->n", q, q))
        keep[z:z + (1 << 14)] = np.einsum("nd,nd->n", p, q) / norms >= threshold
    return a[keep], b[keep]


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a graph given by index pairs: nodes, and the smallest node of the tree of each."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    k = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[k], nodes[root[k]]


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class, other, n): other null: n vectors of other classes linked with the class; else an edge of a forest."""
    spark = vectors.sparkSession
    reps = stored(vectors.groupBy("class").agg(F.first("v").alias("v"), F.countDistinct("vec_id").alias("n")), "vector-classes")
    sizes = [r[0] for r in reps.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]  # lengths of vectors in use
    parts = [_links_of_size(spark, reps.where(F.size("v") == d), threshold) for d in sizes]
    out = parts[0] if parts else spark.createDataFrame([], "class binary, other binary, n bigint")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _links_of_size(spark: SparkSession, reps: DataFrame, threshold: float) -> DataFrame:
    total = reps.count()
    head = reps.orderBy("class").limit(SAMPLE).select("v").toPandas()["v"]  # classes are hashes: any few are a sample
    sample = unit(np.stack([np.asarray(v, float) for v in head]))
    rotation = axes_of(sample)
    shared = spark.sparkContext.broadcast((rotation, Tree(sample @ rotation, total)))
    radius2 = 2 - 2 * threshold

    def deal(batches):
        rotation, tree = shared.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)
                own, others = tree.reach(unit(rows) @ rotation, radius2)
                n = np.array([1 + len(o) for o in others])
                take = pa.array(np.repeat(np.arange(part.num_rows), n))
                tiles = np.concatenate([np.append(a, o) for a, o in zip(own, others)])
                first = np.zeros(len(tiles), bool)
                first[np.cumsum(n) - n] = True
                yield pa.record_batch([pa.array(tiles, pa.int32()), pa.array(first), part.column("class").take(take),
                                       part.column("v").take(take), part.column("n").take(take)], ["tile", "own", "class", "v", "n"])

    dealt = stored(reps.select("class", "v", "n").mapInArrow(deal, "tile int, own boolean, class binary, v array<double>, n bigint"), "tiles")
    # Blocks of a tile: its own vectors are blocks 0..k-1, its probes go on from there; every pair of blocks is one group.
    counts = stored(dealt.groupBy("tile").agg(F.ceil(F.sum(F.col("own").cast("int")) / TILE).cast("int").alias("k"),
                                              F.ceil(F.sum((~F.col("own")).cast("int")) / TILE).cast("int").alias("m")), "tile-blocks")
    rows = dealt.join(counts, "tile").where("k > 0")
    block = F.when(F.col("own"), F.pmod(F.xxhash64("class"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("class"), F.greatest("m", F.lit(1)))).cast("int")
    rows = rows.withColumn("block", block)
    # Own block i meets the own blocks from i on and all probe blocks; a probe block meets all own blocks.
    partner = F.when(F.col("own"), F.sequence(F.lit(0), F.col("k") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    met = rows.withColumn("with", F.explode(partner)).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))

    square = SQUARE

    def compare(key, rows):
        rotation, _ = shared.value
        block, j = rows.column("block").to_numpy(), key[2].as_py()
        raw = scaled(np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1))
        cls, n = rows.column("class").combine_chunks(), rows.column("n").to_numpy()
        turned = unit(raw) @ rotation
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == j)
        same = key[1].as_py() == j
        linked, trees = np.zeros(len(raw), np.int64), [(np.empty(0, np.int64),) * 2]
        for x in range(0, len(left), square):
            for y in range(x if same else 0, len(right), square):
                l, r = left[x:x + square], right[y:y + square]
                a, b = tile_links(turned[l], turned[r], threshold, same and x == y)
                a, b = verified(raw, l[a], r[b], threshold)
                if len(a):
                    np.add.at(linked, a, n[b])
                    np.add.at(linked, b, n[a])
                    trees.append(forest(a, b))
        nodes, roots = forest(*(np.concatenate(side) for side in zip(*trees)))
        k = np.flatnonzero(linked)
        return pa.table([pa.chunked_array([cls.take(pa.array(k)), cls.take(pa.array(nodes))]),
                         pa.chunked_array([pa.nulls(len(k), pa.binary()), cls.take(pa.array(roots))]),
                         pa.array(np.append(linked[k], np.zeros(len(nodes), np.int64)))], names=["class", "other", "n"])

    return met.select("tile", "i", "j", "block", "class", "v", "n").groupBy("tile", "i", "j").applyInArrow(compare, "class binary, other binary, n bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    classed = with_class(vectors)
    usable = stored(classed.where("class IS NOT NULL"), "vectors")
    found = stored(links(usable, threshold), "links")
    counts = found.where("other IS NULL").groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    classes = usable.groupBy("class").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("own"))
    known = stored(classes.join(counts, "class", "left").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "least", (F.col("own") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")), "class-links")
    ids = stored(known.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    of_class = stored(known.join(ids, "root").select("class", "n_links", "component_id"), "class-components")
    # A vector's class is a function of its row, so nothing is joined on the id.
    out = classed.select("vec_id", "class").join(of_class, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
