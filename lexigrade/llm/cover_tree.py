"""Exact embedding near-duplicates: dual traversal of a cover tree.

Cosine c between unit vectors is the distance sqrt(2 - 2c), so all bounds are metric.
The top level is a net of centres chosen farthest-first from a bounded sample; every
vector belongs to its nearest centre.  A cell's vectors are dealt into blocks of at most
about ``block`` vectors, each with the covering radius that its vectors really have.  A
pair of blocks is visited unless its centres are farther apart than both radii and the
threshold.  Inside a pair the traversal goes on: each block is split by nets of halving
radius for as long as that shrinks the radii, node pairs are pruned by the same bound and
leaves are compared as matrix products in double precision.

Where pairs are at most one and a half for each block, blocks are shuffled to them.  Else
each task reads two files' blocks from the shared folder and meets them in all pairs that
bounds leave, so that the disk taken grows as the vectors and not as the pairs.

A pair, or a task of many, returns how many each vector links with there, and the edges of
a spanning forest; no list of all pairs is ever made.  Equal vectors are one class before
that, and count by their number; rows find their class by 128 bits of a SHA-256.

The sample only shapes the tree; it never decides which pairs link.  For vectors without
low-dimensional structure (uniform ones in 64 dimensions) no bound prunes much, and the
work grows as the square of the vectors, in matrix products of 2,048 x 2,048.  Products in
single precision, with their error allowed for, choose the pairs to compute in double.

Cases: a vector that is null, empty, zero or holds null or non-finite components links
with nothing; vectors of different lengths don't link; a null id has 0 links and null
component; repeated rows are vectors of their own and link with each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrade.llm.components import components
from lexigrade.llm.scratch import Scratch

_LEAF = 256
_LINKS = "u long, v long, links long"
#: Bytes of vectors in a file of blocks, and pairs of blocks that a Python worker gets at once.
_FILE, _PAIRS = 16 << 20, 16


@dataclass
class Node:
    at: np.ndarray
    centre: np.ndarray
    radius: float
    below: list["Node"]


def grow(x: np.ndarray, at: np.ndarray, shrink: float = 0.75, fan: int = 16) -> Node:
    """The node of rows ``at`` of the unit vectors x, split while splitting shrinks radii."""
    some = x[at]
    near = ((some - some[0]) ** 2).sum(1)
    radius = float(np.sqrt(near.max()))
    node = Node(at, some[0], radius, [])
    if len(at) <= _LEAF or radius == 0:
        return node
    owner = np.zeros(len(at), np.int64)
    n_centres = 1
    while n_centres < fan and near.max() > (radius / 2) ** 2:
        far = ((some - some[int(near.argmax())]) ** 2).sum(1)
        closer = far < near
        owner[closer], near[closer] = n_centres, far[closer]
        n_centres += 1
    if np.sqrt(np.average(near)) > shrink * radius:
        return node
    node.below = [grow(x, at[owner == k]) for k in range(n_centres) if (owner == k).any()]
    return node if len(node.below) > 1 else Node(at, node.centre, radius, [])


def visit(a: Node, b: Node, same: bool, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of leaves that the covering radii don't rule out; same: a is b."""
    if not same and np.sqrt(((a.centre - b.centre) ** 2).sum()) > a.radius + b.radius + reach:
        return
    if not a.below and not b.below:
        yield a.at, b.at, same
    elif same:
        for k, x in enumerate(a.below):
            for y in a.below[k:]:
                yield from visit(x, y, x is y, reach)
    elif a.below and (not b.below or a.radius >= b.radius):
        for x in a.below:
            yield from visit(x, b, False, reach)
    else:
        for y in b.below:
            yield from visit(a, y, False, reach)


def _unit(raw: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True)), v


@dataclass
class Block:
    ids: np.ndarray
    sizes: np.ndarray
    x: np.ndarray
    single: np.ndarray
    tree: Node


def _block(ids: bytes, sizes: bytes, vecs: bytes, dim: int, kind: str) -> Block:
    x, _ = _unit(vecs, dim, kind)
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), x, x.astype(np.float32), grow(x, np.arange(len(x))))


def _joined(x: Block, y: Block, cosine: float, parent: dict[int, int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(links of x's vectors, of y's, forest edges) for one pair of blocks; parent has the forest so far."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    same = x is y
    lx, ly = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
    least = np.float32(cosine - 1e-9 - (x.x.shape[1] + 8) * 2.0**-23)  # twice the error of single precision

    def top(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    edges = []
    for a, b, one in visit(x.tree, y.tree, same, reach):
        with_b = y.single[b].T
        for k in range(0, len(a), 512):
            part = a[k : k + 512]
            i, j = np.nonzero(x.single[part] @ with_b >= least)
            i, j = part[i], b[j]
            if one:
                up = i < j
                i, j = i[up], j[up]
            close = np.einsum("ij,ij->i", x.x[i], y.x[j]) >= cosine
            i, j = i[close], j[close]
            np.add.at(lx, i, y.sizes[j])
            np.add.at(lx if same else ly, j, x.sizes[i])
            # of each vector's links one row at a time, so that the forest costs no more than the links
            for u, v in zip(x.ids[i].tolist(), y.ids[j].tolist(), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((u, v))
    return lx, ly, edges


def _cleaned(kind: str):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad |= ~np.isfinite(values)
            live = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
            edge = np.concatenate([[0], np.cumsum(live)])
            raw = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                good = z > a and not bad[a:z].any() and values[a:z].any()
                raw.append((values[a:z] + 0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(live, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "vec"])

    return mapped


def _centres(classes: DataFrame, n: int, dim: int, kind: str, block: int, sample: int) -> np.ndarray:
    rows = classes.orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    x, _ = _unit(b"".join(bytes(r.vec) for r in rows), dim, kind)
    want = int(min(sample, max(1, n // block)))
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(want, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def near_vectors(embeddings: DataFrame, *, cosine: float = 0.9, block: int = 2048, sample: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings(vec_id, embedding)``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "cover")
    element = dict(embeddings.dtypes)["embedding"]
    kind = "<f4" if element == "array<float>" else "<f8"
    vector = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).mapInArrow(_cleaned(kind), "vec_id long, dim long, vec binary")
    classes = rows.where("vec is not null and vec_id is not null").groupBy("dim", "vec").agg(F.count("*").alias("size"), F.min("vec_id").alias("low_id"))
    vectors = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    key = F.unhex(F.substring(F.sha2("vec", 256), 1, 32)).alias("key")
    classes = scratch.save(vectors.select("node", "size", "low_id", key), "classes")
    rows = scratch.save(rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), key).alias("key")), "rows")
    dims = sorted((r[0], r[1]) for r in vectors.groupBy("dim").count().collect())
    blocks = {dim: _blocks(vectors.where(F.col("dim") == dim).select("node", "size", "vec"), n, dim, kind, block, sample, scratch) for dim, n in dims}
    scratch.drop("vectors")
    counts, edges = None, None
    for dim, (table, centres) in blocks.items():
        links = _links(table, centres, dim, kind, cosine, scratch)
        scratch.drop(f"blocks{dim}")
        some = links.where("v is null").select(F.col("u").alias("node"), "links")
        more = links.where("v is not null").select("u", "v")
        counts, edges = (some, more) if counts is None else (counts.union(some), edges.union(more))
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    joined = components(edges, scratch)
    named = classes.join(counts.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(joined, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = named.join(low, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.where("key is not null").join(named, "key").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _blocks(vectors: DataFrame, n: int, dim: int, kind: str, block: int, sample: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(a row a block with its covering radius and its centre's distance from each centre, centres)."""
    spark = vectors.sparkSession
    centres = _centres(vectors, n, dim, kind, block, sample)
    between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))

    def nearest(whole: bool):
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, _ = _unit(b"".join(b.column(2).to_pylist()), dim, kind)
                    cell = pa.array((x @ centres.T).argmax(1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, cell] if whole else [cell], names=["node", "size", "vec", "cell"] if whole else ["cell"])

        return mapped

    counted = vectors.mapInArrow(nearest(False), "cell int").groupBy("cell").count()
    held = spark.createDataFrame([(r[0], max(1, -(-r[1] // block))) for r in counted.collect()], "cell int, deal long")
    dealt = vectors.mapInArrow(nearest(True), "node long, size long, vec binary, cell int").join(F.broadcast(held), "cell")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "deal")).select("cell", "block", "node", "size", "vec")

    def packed(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        raw = b"".join(table.column("vec").to_pylist())
        cell = table.column("cell")[0].as_py()
        radius = float(np.sqrt(max(0.0, ((_unit(raw, dim, kind)[0] - centres[cell]) ** 2).sum(1).max())))
        return pa.table({"cell": pa.array([cell], pa.int32()), "block": [table.column("block")[0].as_py()], "radius": [radius], "apart": pa.array([between[cell]], pa.list_(pa.float64())), "ids": pa.array([ids.tobytes()], pa.binary()), "sizes": pa.array([table.column("size").to_numpy().tobytes()], pa.binary()), "vecs": pa.array([raw], pa.binary())})

    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * dim * int(kind[-1]) // _FILE)
    blocks = dealt.repartition(n_files, "cell", "block").groupBy("cell", "block").applyInArrow(packed, "cell int, block long, radius double, apart array<double>, ids binary, sizes binary, vecs binary")
    return scratch.save(blocks, f"blocks{dim}"), centres


def _links(blocks: DataFrame, centres: np.ndarray, dim: int, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """(u, v, links): links of class u where v is null, else a forest edge."""
    spark = blocks.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    radii = {r[0]: r[1] for r in blocks.groupBy("cell").agg(F.max("radius")).collect()}
    between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    cells = [(a, b, float(between[a, b])) for a in radii for b in radii if a <= b and between[a, b] <= radii[a] + radii[b] + reach + 1e-7]
    cells = spark.createDataFrame(cells, "cell_a int, cell_b int, apart double")
    some = blocks.select("cell", "block", "radius")
    a = some.select(F.col("cell").alias("cell_a"), F.col("block").alias("a"), F.col("radius").alias("ra"))
    b = some.select(F.col("cell").alias("cell_b"), F.col("block").alias("b"), F.col("radius").alias("rb"))
    pairs = a.join(F.broadcast(cells), "cell_a").join(b, "cell_b").where("cell_a < cell_b or a <= b").where(F.col("apart") <= F.col("ra") + F.col("rb") + reach + 1e-7)
    pairs = pairs.select("cell_a", "a", "cell_b", "b")
    if 2 * pairs.count() > 3 * some.count():  # else blocks go out twice at most
        return _met(blocks, dim, kind, cosine, reach, scratch)
    left = blocks.join(pairs.withColumnsRenamed({"cell_a": "cell", "a": "block"}).select("cell", "block", F.col("cell").alias("cell_a"), F.col("block").alias("a"), "cell_b", "b"), ["cell", "block"])
    right = blocks.join(pairs.withColumnsRenamed({"cell_b": "cell", "b": "block"}).select("cell", "block", "cell_a", "a", F.col("cell").alias("cell_b"), F.col("block").alias("b")).where("cell_a <> cell_b or a <> b"), ["cell", "block"])
    sides = left.union(right).select("cell_a", "a", "cell_b", "b", "ids", "sizes", "vecs")

    def compared(table: pa.Table) -> pa.Table:
        sides_ = [_block(*(r[c] for c in ("ids", "sizes", "vecs")), dim, kind) for r in table.select(["ids", "sizes", "vecs"]).to_pylist()]
        x, y = sides_[0], sides_[-1]
        lx, ly, edges = _joined(x, y, cosine, {})
        return pa.Table.from_batches([_told([(x.ids, lx)] if x is y else [(x.ids, lx), (y.ids, ly)], edges)])

    return scratch.save(sides.groupBy("cell_a", "a", "cell_b", "b").applyInArrow(compared, _LINKS), f"links{dim}")


def _told(counts: list[tuple[np.ndarray, np.ndarray]], edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u = [x for ids, links in counts for x in ids[links > 0].tolist()]
    links = [x for _, links in counts for x in links[links > 0].tolist()]
    columns = [[*u, *(e[0] for e in edges)], [*[None] * len(u), *(e[1] for e in edges)], [*links, *[None] * len(edges)]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])


def _met(blocks: DataFrame, dim: int, kind: str, cosine: float, reach: float, scratch: Scratch) -> DataFrame:
    """The same of blocks read file against file, without a shuffle; a task's links come summed."""
    spark = blocks.sparkSession
    x, y = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in ("cell", "block", "radius", "apart", "ids", "sizes", "vecs"))) for side in "xy")
    same = "cell_x = cell_y and block_x = block_y"
    # of a pair's two orders one counts, in turn, so that no pair of files has all of the work
    once = "(cell_x < cell_y or cell_x = cell_y and block_x < block_y) = ((cell_x + block_x + cell_y + block_y) % 2 = 0)"
    close = F.expr("apart_x[cell_y]") <= F.col("radius_x") + F.col("radius_y") + reach + 1e-7
    pairs = x.join(y.drop("apart_y").hint("shuffle_replicate_nl"), F.expr(f"({same}) or ({once})") & close)
    pairs = pairs.select("cell_x", "block_x", "cell_y", "block_y", "ids_x", "sizes_x", "vecs_x", "ids_y", "sizes_y", "vecs_y")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        parent: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        at, one = None, None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                a, b = (row[0].as_py(), row[1].as_py()), (row[2].as_py(), row[3].as_py())
                if a != at:
                    at, one = a, _block(*(v.as_py() for v in row[4:7]), dim, kind)
                other = one if a == b else _block(*(v.as_py() for v in row[7:]), dim, kind)
                lx, ly, more = _joined(one, other, cosine, parent)
                edges += more
                for name, side, links in ((a, one, lx), (b, other, ly)):
                    if links.any():
                        counts.setdefault(name, (side.ids, np.zeros_like(links)))[1][:] += links
        if counts:
            yield _told(list(counts.values()), edges)

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, str(_PAIRS))
    try:
        return scratch.save(pairs.mapInArrow(mapped, _LINKS), f"links{dim}")
    finally:
        spark.conf.set(size, was)


#: Both sides over all pairs: for small tables only.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(node, label) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.label FROM reach r JOIN links l ON l.u = r.node
), low AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node
), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN degree ON e.vec_id = u LEFT JOIN low ON e.vec_id = node
"""
