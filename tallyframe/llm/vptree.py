"""Approximate nearest neighbours with a vantage-point tree for each shard.

Nearness is the largest inner product. With M the largest norm of the table, a vector x gets one
more component sqrt(M^2 - |x|^2) and a query the component 0; Euclidean distance then orders vectors
as the inner product does, |q - x|^2 = |q|^2 + M^2 - 2 qx, and is a metric.

A vantage-point tree over a bounded sample (``TOP_SAMPLE`` distinct vectors in expectation, over all
lengths) cuts space into at most ``MOST_REGIONS`` regions; every row of the table descends it into
its region. Regions of more than ``SHARD_ROWS`` rows are dealt to shards by a hash. A task builds the
tree of a shard: each node has a vantage point and the median distance of its other points, those
nearer go inside, the others outside; leaves hold up to ``LEAF`` points. A region's profile is the
least and largest distance of its rows from the vantage points above it and from its centre.

A query is first put to one shard of its own region; its k-th best there bounds the rest. It is then
sent to the other shards of those regions only that may hold something nearer by the triangle
inequality and their profiles, and in a shard's tree a side is left out likewise, in both places with
the k-th best distance divided by ``factor``. Factor 1 is exact search; larger factors leave out more.
How many regions a query visits depends on the data: nearly all where vectors point in all
directions evenly, few where they form clusters. A shard's tree is sent once for each part of up to
``QUERY_PART`` queries and read before them from the sorted rows of a task, so memory holds one tree
and one batch of queries. Scores of what is found are sums of the products of the original vectors in
double precision, the same for equal vectors wherever they are.

The driver holds the sample and the profiles, and a count by vector length; lengths are few.

Defined results: null ids, null and zero vectors, and vectors with null or non-finite components
take no part. Vectors are compared with those of the same length. Of repeated query ids with
different vectors, the smallest vector asks; repeated candidate rows count as rows, are combined
before they are dealt and told apart again at the end. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ready_workers, written

SHARD_ROWS = 4096
#: Queries searched at once, and queries that share one sending of a tree.
QUERY_BLOCK, QUERY_PART = 1024, 16384
LEAF = 64
#: Vectors that the regions are fitted on, the fewest of them in a region, and regions of all lengths.
TOP_SAMPLE, LEAST_SAMPLE = 8192, 16
MOST_REGIONS = TOP_SAMPLE // LEAST_SAMPLE
#: Most tasks that a search is dealt to.
MOST_TASKS = 32768
#: Relaxation of the pruning in production.
FACTOR = 1.1


class VantagePointTree:
    """A tree over the rows of a matrix, in arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, largest: float, seed: int = 0):
        self.ids, self.vectors, self.copies, self.largest = ids, vectors, copies, largest
        self.norms = (vectors * vectors).sum(1)
        #: (vantage point, radius, inside, outside), or (-1, points) for a leaf.
        self.nodes: list[tuple] = []
        if len(ids):
            self._grow(np.random.default_rng(seed).permutation(len(ids)))

    def _distances(self, point: int, others: np.ndarray) -> np.ndarray:
        square = self.largest**2
        extra = np.sqrt(np.maximum(square - self.norms[others], 0)) - np.sqrt(max(square - self.norms[point], 0))
        apart = self.norms[others] + self.norms[point] - 2 * self.vectors[others] @ self.vectors[point]
        return np.sqrt(np.maximum(apart + extra**2, 0))

    def _grow(self, points: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(points) <= LEAF:
            self.nodes[number] = (-1, points)
            return number
        vantage, rest = int(points[0]), points[1:]
        distances = self._distances(vantage, rest)
        radius = float(np.median(distances))
        inside = distances <= radius
        if inside.all():  # all others at the same distance
            inside = np.arange(len(rest)) < len(rest) // 2
        near = self._grow(rest[inside])
        far = self._grow(rest[~inside])
        self.nodes[number] = (vantage, radius, near, far)
        return number

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """Query number, row id, score and copies of each query's k best of at least the score ``least``, ties to the smaller id."""
        found = _Best(self, query_ids, queries, least, k)
        if self.nodes and len(queries):
            self._visit(found, self._descend(found), factor)
        return found.rows()

    def _apart(self, found: _Best, asking: np.ndarray, vantage: int) -> np.ndarray:
        return np.sqrt(np.maximum(found.reach[asking] - 2 * found.queries[asking] @ self.vectors[vantage], 0))

    def _descend(self, found: _Best) -> np.ndarray:
        """Puts each query to the leaf on its own side of every vantage point; returns the leaves."""
        leaves = np.empty(len(found.queries), np.int64)
        waiting = [(0, np.arange(len(leaves)))]
        while waiting:
            number, asking = waiting.pop()
            node = self.nodes[number]
            if node[0] < 0:
                leaves[asking] = number
                found.offer(asking, node[1])
                continue
            vantage, radius, near, far = node
            inside = self._apart(found, asking, vantage) <= radius
            waiting += [(side, asking[chosen]) for side, chosen in ((far, ~inside), (near, inside)) if chosen.any()]
        return leaves

    def _visit(self, found: _Best, leaves: np.ndarray, factor: float) -> None:
        """Puts all queries together to each node that may hold something nearer, but not again to ``leaves``."""
        waiting = [(0, np.arange(len(leaves)), np.zeros(len(leaves)))]
        while waiting:
            number, asking, gap = waiting.pop()
            open_ = gap * factor <= found.limit(asking)
            asking, gap = asking[open_], gap[open_]
            if not len(asking):
                continue
            node = self.nodes[number]
            if node[0] < 0:
                found.offer(asking[leaves[asking] != number], node[1])
                continue
            vantage, radius, near, far = node
            found.offer(asking, np.array([vantage]))
            beyond = self._apart(found, asking, vantage) - radius
            slack = 1e-9 * (1 + radius)
            waiting.append((far, asking, np.maximum(gap, -beyond - slack)))
            waiting.append((near, asking, np.maximum(gap, beyond - slack)))

class _Best:
    """The k best rows of each query so far."""

    def __init__(self, tree: VantagePointTree, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.tree, self.query_ids, self.queries, self.k = tree, query_ids, queries, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.points = np.full((len(queries), k), -1)
        self.reach = (queries * queries).sum(1) + tree.largest**2
        #: What a row must score: the k-th best here, or that of an earlier search.
        self.least = least.copy()

    def limit(self, asking: np.ndarray) -> np.ndarray:
        """The distance of the k-th best."""
        return np.sqrt(np.maximum(self.reach[asking] - 2 * self.least[asking], 0))

    def offer(self, asking: np.ndarray, points: np.ndarray) -> None:
        if not len(asking):
            return
        tree = self.tree
        near = self.queries[asking] @ tree.vectors[points].T
        slack = 1e-9 * (1 + self.reach[asking])
        rows, columns = np.nonzero(near >= (self.least[asking] - slack)[:, None])
        rows, columns = asking[rows], points[columns]
        other = tree.ids[columns] != self.query_ids[rows]
        rows, columns = rows[other], columns[other]
        if not len(rows):
            return
        exact = (self.queries[rows] * tree.vectors[columns]).sum(1)
        touched = np.unique(rows)
        owner = np.concatenate([rows, np.repeat(touched, self.k)])
        points = np.concatenate([columns, self.points[touched].ravel()])
        scores = np.concatenate([exact, self.scores[touched].ravel()])
        order = np.lexsort((tree.ids[points], points < 0, -scores, owner))
        owner, points, scores = owner[order], points[order], scores[order]
        starts = np.searchsorted(owner, touched)
        take = starts[:, None] + np.arange(self.k)
        self.points[touched], self.scores[touched] = points[take], scores[take]
        self.least[touched] = np.maximum(self.least[touched], self.scores[touched, -1])

    def rows(self) -> tuple[np.ndarray, ...]:
        query, place = np.nonzero(self.points >= 0)
        point = self.points[query, place]
        return query, self.tree.ids[point], self.scores[query, place], self.tree.copies[point]


class Regions:
    """A vantage-point tree over a sample, whose leaves are regions, for vectors of one length."""

    def __init__(self, sample: np.ndarray, largest: float, leaf: int):
        self.largest = largest
        self.vantages: list[np.ndarray] = []
        self.nodes: list[tuple] = []
        self.centres: list[np.ndarray] = []
        #: The vantage points above each region.
        self.above: list[list[int]] = []
        points = self._lifted(sample)
        self._grow(points[np.random.default_rng(0).permutation(len(points))], leaf, [])

    def _lifted(self, vectors: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest**2 - (vectors * vectors).sum(1), 0))
        return np.column_stack([vectors, more])

    def _grow(self, points: np.ndarray, leaf: int, above: list[int]) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(points) > max(leaf, 1):
            distances = _apart(points[1:], points[0])
            radius = float(np.median(distances))
            inside = distances <= radius
            if not inside.all():
                vantage = len(self.vantages)
                self.vantages.append(points[0])
                near = self._grow(points[1:][inside], leaf, [*above, vantage])
                far = self._grow(points[1:][~inside], leaf, [*above, vantage])
                self.nodes[number] = (vantage, radius, near, far)
                return number
        self.nodes[number] = (-1, len(self.centres))
        self.above.append(above)
        self.centres.append(points.mean(0) if len(points) else np.zeros(points.shape[1]))
        return number

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        points, regions = self._lifted(vectors), np.zeros(len(vectors), np.int32)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            number, rows = waiting.pop()
            node = self.nodes[number]
            if node[0] < 0:
                regions[rows] = node[1]
                continue
            near = _apart(points[rows], self.vantages[node[0]]) <= node[1]
            waiting += [(node[2], rows[near]), (node[3], rows[~near])]
        return regions

    def profile(self, region: int, vectors: np.ndarray) -> tuple[list[float], list[float]]:
        """The least and largest distance of a region's rows from the points that tell of it."""
        points = self._lifted(vectors)
        distances = [_apart(points, x) for x in (*(self.vantages[i] for i in self.above[region]), self.centres[region])]
        return [float(d.min()) for d in distances], [float(d.max()) for d in distances]

    def gaps(self, queries: np.ndarray, profiles: dict[int, tuple[list[float], list[float]]]) -> dict[int, np.ndarray]:
        """By region that has rows, a distance that each query is at least away from all of them."""
        points = np.column_stack([queries, np.zeros(len(queries))])
        to_vantages = [_apart(points, x) for x in self.vantages]
        gaps = {}
        for region, (least, most) in profiles.items():
            gap = np.zeros(len(queries))
            for distance, low, high in zip([*(to_vantages[i] for i in self.above[region]), _apart(points, self.centres[region])], least, most):
                gap = np.maximum(gap, np.maximum(low - distance, distance - high))
            gaps[region] = gap
        return gaps


def _apart(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1))


@dataclass
class Index:
    """Shards with their trees, and what routes queries to them."""

    #: (dim, region, id, v, n) of every distinct row.
    rows: DataFrame
    #: (dim, region, shard, tree).
    trees: DataFrame
    regions: dict[int, Regions]
    largest: dict[int, float]
    shards: dict[tuple[int, int], int]
    profiles: dict[int, dict[int, tuple[list[float], list[float]]]]


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v, dim, square) of the rows that take part; floats stay floats."""
    v = F.col(f"`{vector}`")
    if df.select(v).schema[0].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(finite)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumns({"dim": F.size("v"), "square": square}).where("square > 0")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_regions(rows: DataFrame, counts: dict[int, int], largest: dict[int, float], shard_rows: int) -> dict[int, Regions]:
    """Regions by length, fitted on distinct vectors of small hash."""
    total = sum(counts.values())
    chosen = rows.where(F.pmod(F.xxhash64("v"), F.lit(total)) < TOP_SAMPLE).select("dim", "v").distinct()
    samples: dict[int, list] = {dim: [] for dim in counts}
    for dim, v in chosen.collect():
        samples[dim].append(v)
    regions = {}
    for dim, vectors in samples.items():
        leaf = max(LEAST_SAMPLE, len(vectors) * shard_rows // counts[dim])
        regions[dim] = Regions(np.array(sorted(vectors), np.float64).reshape(-1, dim), largest[dim], leaf)
    return regions


def build_index(rows: DataFrame, shard_rows: int | None = None) -> Index:
    """Rows in regions, the trees of their shards, and the profiles of the regions."""
    shard_rows = shard_rows or SHARD_ROWS
    sizes = rows.groupBy("dim").agg(F.count("*"), F.sqrt(F.max("square"))).collect()
    counts, largest = {d: n for d, n, _ in sizes}, {d: m for d, _, m in sizes}
    regions = fit_regions(rows, counts, largest, shard_rows) if counts else {}
    vector = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                region = pa.array(regions[int(dim)].of(_matrix(part.column("v"))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("dim"), region, part.column("id"), part.column("v"), part.column("n")], names=["dim", "region", "id", "v", "n"])

    once = rows.groupBy("dim", "id", "v").agg(F.count("*").alias("n"))
    placed = written(once.mapInArrow(place, f"dim int, region int, id long, v {vector}, n long"), "placed")
    sized = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sized = written(sized, "regions")
    shards = {(r.dim, r.region): r.shards for r in sized.collect()}

    def build(shard: pa.Table) -> pa.Table:
        ids, vectors, copies = shard.column("id").to_numpy(), _matrix(shard.column("v")), shard.column("n").to_numpy()
        order = np.lexsort((vectors[:, 0], ids))
        ids, vectors, copies = ids[order], vectors[order], copies[order]
        dim, region = shard.column("dim")[0].as_py(), shard.column("region")[0].as_py()
        tree = VantagePointTree(ids, vectors, copies, largest[dim])
        narrow = vectors.astype(np.float32) if vector == "array<float>" else vectors
        least, most = regions[dim].profile(region, vectors)
        data = pickle.dumps((ids, narrow, copies, tree.nodes))
        keys = [shard.column(c)[:1] for c in ("dim", "region", "shard")]
        return pa.table([*keys, pa.array([data], pa.binary()), pa.array([least], pa.list_(pa.float64())), pa.array([most], pa.list_(pa.float64()))], names=["dim", "region", "shard", "tree", "least", "most"])

    dealt = placed.join(sized, ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")).drop("shards")
    trees = written(dealt.groupBy("dim", "region", "shard").applyInArrow(build, "dim int, region int, shard int, tree binary, least array<double>, most array<double>"), "trees")
    places = trees.select("dim", "region", F.posexplode(F.arrays_zip("least", "most")).alias("place", "x"))
    profiles: dict[int, dict] = {dim: {} for dim in counts}
    for dim, region, _, least, most in places.groupBy("dim", "region", "place").agg(F.min("x.least"), F.max("x.most")).orderBy("dim", "region", "place").collect():
        low, high = profiles[dim].setdefault(region, ([], []))
        low.append(least)
        high.append(most)
    return Index(placed, trees.drop("least", "most"), regions, largest, shards, profiles)


def loaded(data: bytes, largest: float) -> VantagePointTree:
    ids, vectors, copies, nodes = pickle.loads(data)
    tree = VantagePointTree(ids[:0], vectors[:0].astype(np.float64), copies[:0], largest)
    tree.ids, tree.vectors, tree.copies, tree.nodes = ids, vectors.astype(np.float64), copies, nodes
    tree.norms = (tree.vectors * tree.vectors).sum(1)
    return tree


KEY = ["dim", "region", "shard", "part"]


def put_to(index: Index, asked: DataFrame, k: int, factor: float, tasks: int) -> DataFrame:
    """(query_id, vec_id, score, n) of what ``asked`` (dim, region, shard, part, id, v, least) finds in its shards."""
    largest = index.largest
    keys = asked.select(*KEY).distinct()
    no_query = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("id", "v", "least")]
    trees = index.trees.join(keys, ["dim", "region", "shard"]).select(*KEY, F.lit(0).alias("kind"), "tree", *no_query)
    queries = asked.select(*KEY, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "id", "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = np.unique(np.concatenate([np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 0) + 1, [0, len(kinds)]]))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if kinds[start] == 0:
                    tree = loaded(batch.column("tree")[start].as_py(), largest[batch.column("dim")[start].as_py()])
                    continue
                for at in range(start, end, QUERY_BLOCK):
                    some = batch.slice(at, min(QUERY_BLOCK, end - at))
                    ids = some.column("id").to_numpy()
                    query, found, scores, copies = tree.search(ids, _matrix(some.column("v")), some.column("least").to_numpy(), k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(scores), pa.array(copies)], names=["query_id", "vec_id", "score", "n"])

    stream = trees.unionByName(queries).repartition(tasks, *KEY).sortWithinPartitions(*KEY, "kind")
    return stream.mapInArrow(search, "query_id long, vec_id long, score double, n long")


def query_parts(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """The first part and the number of parts of each region's queries: neighbouring regions share a part until it is full."""
    parts, part, filled = {}, 0, 0
    for key in sorted(counts):
        if filled and filled + counts[key] > QUERY_PART:
            part, filled = part + 1, 0
        several = -(-counts[key] // QUERY_PART)
        parts[key] = (part, several)
        part, filled = (part + several, 0) if several > 1 else (part, filled + counts[key])
    return parts


def nearest(df: DataFrame, asks: Column, k: int = 20, factor: float = FACTOR, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row that ``asks``.

    ``asks`` is a condition on the column ``id``.
    """
    spark = df.sparkSession
    ready_workers(spark)
    index = build_index(usable(df, id_column, vector))
    regions, shards, profiles, largest = index.regions, index.shards, index.profiles, index.largest
    first_row = F.min(F.struct("v", "dim", "region")).alias("first")
    queries = written(index.rows.where(asks).groupBy("id").agg(first_row).select("id", "first.*"), "queries")
    counts = {(r.dim, r.region): r["count"] for r in queries.groupBy("dim", "region").count().collect()}
    parts = query_parts(counts)
    of_regions = [(dim, region, shards[dim, region], *parts[dim, region]) for dim, region in counts]
    known = spark.createDataFrame(of_regions, "dim int, region int, shards int, first int, several int")
    part = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("several"))).cast("int").alias("part")
    home = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("shards")).cast("int").alias("shard")
    asked = queries.join(known, ["dim", "region"]).select("dim", "region", home, part, "id", "v")

    def tasks(keys: int) -> int:
        return min(MOST_TASKS, max(1, 2 * keys))

    all_shards = sum(shards.values())
    all_parts = 1 + max((x + several for x, several in parts.values()), default=0)
    own = written(put_to(index, asked.withColumn("least", F.lit(float("-inf"))), k, factor, tasks(all_shards)), "own")
    kth = own.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    bounded = asked.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                vectors, least = _matrix(rows.column("v")), rows.column("least").to_numpy()
                reach = (vectors * vectors).sum(1) + largest[dim] ** 2
                limit = np.sqrt(np.maximum(reach - 2 * least, 0)) + 1e-9 * (1 + np.sqrt(reach))
                own_region, own_shard = rows.column("region").to_numpy(), rows.column("shard").to_numpy()
                for region, gap in regions[dim].gaps(vectors, profiles[dim]).items():
                    near = gap * factor <= limit
                    for shard in range(shards[dim, region]):
                        chosen = near & ~((own_region == region) & (own_shard == shard))
                        some = rows.filter(pa.array(chosen))
                        size = some.num_rows
                        places = [pa.array(np.full(size, x, np.int32)) for x in (dim, region, shard)]
                        yield pa.RecordBatch.from_arrays([*places, *(some.column(c) for c in ("part", "id", "v", "least"))], names=[*KEY, "id", "v", "least"])

    vectors = asked.schema["v"].dataType.simpleString()
    routed = bounded.select(*KEY, "id", "v", "least").mapInArrow(route, f"dim int, region int, shard int, part int, id long, v {vectors}, least double")
    others = put_to(index, routed, k, factor, tasks(all_shards * all_parts))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    met = own.unionByName(others).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """The nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(embeddings, F.col("id") % 20 == 0, k, factor)
