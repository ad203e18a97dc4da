"""Approximate nearest neighbours with one vantage-point tree per shard.

Nearness is the largest inner product.  Of a node we know a vantage point v, the
least and greatest distances of its members from v, and the length M of its longest
member.  With d the query's distance to v, the triangle inequality gives every
member x a distance of at least gap = max(0, d - greatest, least - d) to the query, so

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2  <=  (|q|^2 + M^2 - gap^2) / 2,

and q.x <= |q| M.  A node whose bound lies below the query's k-th best score is
pruned.  ``relax`` multiplies the gap: 1 is the exact search, more prunes more.
Bounds have a margin for rounding that scales with the lengths they are made of, and
rows are ranked by inner products of the original vectors, so one very long vector
spoils no others.  Ties are kept until the ids break them.

Index.  Equal vectors are one entry with their smallest ids (as many as any query can
return), so a group of copies costs one row.  A *top tree* over a bounded sample
(the ``SAMPLE`` distinct vectors of smallest hash) deals all entries to regions; a
region is cut by hash into shards of about ``shard_rows``.  Each shard's tree is
built in one task and written to the shared folder.

Search.  Every query first goes to the region that it falls into, which gives it a
k-th best score, then to the other regions whose bound by the top tree is not below
it.  A shard's tree travels once for every ``task_queries`` of the queries that are
sent to it, ahead of them in the same sorted partition, and the task reads the
queries as a stream.  Nothing that grows with the table is broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, partitions, small_batches

SHARD_ROWS = 4096
SAMPLE = 4096          # vectors that the top tree is built on: the bound of what reaches the driver
REGIONS = 1024         # most regions of the top tree
TASK_QUERIES = 8192    # queries that share one copy of a shard's tree
BLOCK_ROWS = 1024      # queries that walk a tree together
LEAF = 128
RELAX = 1.0
ROUND = 1e-12          # relative margin of distances and bounds


@dataclass
class Node:
    """An inner node (vantage point, two children) or a leaf (rows, or the number of a region).

    ``least`` and ``greatest``: distances of the node's rows from its parent's vantage point; ``length``: of its longest row."""

    point: np.ndarray | None = None
    inside: "Node | None" = None
    outside: "Node | None" = None
    rows: np.ndarray | None = None
    least: float = 0.0
    greatest: float = np.inf
    length: float = np.inf
    radius: float = 0.0
    number: int = -1


def to_point(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances by differences: exact to rounding also for points that lie close together far from zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((vectors - point) ** 2).sum(1))


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors ** 2).sum(1))


def build(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Node:
    """The tree of ``rows``: the vantage point is the farthest of all from a random row, the radius
    the median distance to it; rows that cannot be split by distance stay a leaf."""
    length = float(lengths(vectors[rows]).max()) if len(rows) else 0.0
    if len(rows) > leaf:
        at = vectors[rows]
        point = at[int(np.argmax(to_point(at, at[rng.integers(len(rows))])))]
        d = to_point(at, point)
        radius = float(np.median(d))
        near = d <= radius
        if near.any() and not near.all():
            node = Node(point, build(vectors, rows[near], rng, leaf), build(vectors, rows[~near], rng, leaf), length=length, radius=radius)
            for child, own in ((node.inside, d[near]), (node.outside, d[~near])):
                child.least, child.greatest = float(own.min()), float(own.max())
            return node
    return Node(rows=rows, length=length)


def bound(d: np.ndarray, size: np.ndarray, node: Node, reach: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """(largest gap to any ancestor's shell, largest possible inner product) of queries with lengths ``size`` at distance
    ``d`` from the parent's vantage point; ``reach`` is the largest gap so far."""
    slack = ROUND * (d + size + node.length)
    gap = np.maximum(reach, np.maximum(d - node.greatest, node.least - d) - slack)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.minimum((size ** 2 + node.length ** 2 - (relax * gap) ** 2) / 2, size * node.length)
        return gap, top + ROUND * (size ** 2 + node.length ** 2)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in component order."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * vectors[:, j]
    return total


class Best:
    """The ``keep`` best rows of each query so far, by score, then by the row's smallest id."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, name: np.ndarray, keep: int, floor: np.ndarray):
        self.q, self.v, self.name, self.floor = queries, vectors, name, floor
        self.size, self.length = lengths(queries), lengths(vectors)
        self.score = np.full((len(queries), keep), -np.inf)
        self.row = np.full((len(queries), keep), -1, np.int64)

    def worst(self, q: np.ndarray) -> np.ndarray:
        """Scores below it cannot be among a query's best."""
        return np.maximum(self.score[q, -1], self.floor[q])

    def offer(self, q: np.ndarray, rows: np.ndarray) -> None:
        """Rows for the queries ``q``: those that cannot be left out are scored exactly and merged."""
        with np.errstate(over="ignore", invalid="ignore"):
            about = self.q[q] @ self.v[rows].T
            margin = ROUND * self.size[q][:, None] * self.length[rows]
            i, j = np.nonzero(~(about + margin < self.worst(q)[:, None]))
        if not len(i):
            return
        own, rows = q[i], rows[j]
        score = exact_scores(self.q[own], self.v[rows])
        hit = np.unique(own)
        keep = self.row.shape[1]
        had = self.row[hit].ravel()
        who = np.concatenate((np.repeat(hit, keep)[had >= 0], own))
        score = np.concatenate((self.score[hit].ravel()[had >= 0], score))
        row = np.concatenate((had[had >= 0], rows))
        order = np.lexsort((self.name[row], -score, who))
        who, score, row = who[order], score[order], row[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = place < keep
        self.score[hit], self.row[hit] = -np.inf, -1
        self.score[who[first], place[first]], self.row[who[first], place[first]] = score[first], row[first]


def search(node: Node, best: Best, active: np.ndarray, reach: np.ndarray, relax: float) -> None:
    """All queries ``active`` walk the tree together, each the nearer child first."""
    if not len(active):
        return
    if node.rows is not None:
        best.offer(active, node.rows)
        return
    d = to_point(best.q[active], node.point)
    inside, outside = (bound(d, best.size[active], c, reach, relax) for c in (node.inside, node.outside))
    first = d <= node.radius
    for own, child, (gap, top) in ((first, node.inside, inside), (~first, node.outside, outside),
                                   (first, node.outside, outside), (~first, node.inside, inside)):
        own = own & ~(top < best.worst(active))
        search(child, best, active[own], gap[own], relax)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows with an id whose vector is neither null nor empty nor zero and
    holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as a matrix of ``width`` columns; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


@dataclass
class Top:
    """The top tree: inner nodes, and for each region the way to it."""

    root: Node
    width: int
    regions: int

    @classmethod
    def build(cls, sample: np.ndarray, width: int, regions: int) -> "Top":
        root, number = build(sample, np.arange(len(sample)), np.random.default_rng(0), max(1, -(-len(sample) // regions))), 0
        todo = [root]
        while todo:
            node = todo.pop()
            node.length, node.rows = np.inf, None  # of the sample only
            if node.point is None:
                node.number, number = number, number + 1
                continue
            node.inside.least, node.inside.greatest = 0.0, node.radius
            node.outside.least, node.outside.greatest = node.radius, np.inf
            todo += [node.inside, node.outside]
        return cls(root, width, number)

    def set_lengths(self, longest: dict[int, float]) -> None:
        """Length of the longest entry of each region; -inf for regions without entries."""
        def fill(node: Node) -> float:
            node.length = longest.get(node.number, -np.inf) if node.point is None else max(fill(node.inside), fill(node.outside))
            return node.length
        fill(self.root)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Region of each vector."""
        out = np.zeros(len(vectors), np.int32)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            if node.point is None:
                out[own] = node.number
            elif len(own):
                near = to_point(vectors[own], node.point) <= node.radius
                todo += [(node.inside, own[near]), (node.outside, own[~near])]
        return out

    def others(self, queries: np.ndarray, worst: np.ndarray, home: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, region) of the regions that may hold a score of ``worst`` or more, a query's own one left out."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size = lengths(queries)
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, own, reach = todo.pop()
            if node.point is None:
                own = own[home[own] != node.number]
                found.append((own, np.full(len(own), node.number)))
                continue
            d = to_point(queries[own], node.point)
            for child in (node.inside, node.outside):
                if child.length == -np.inf:
                    continue  # no entries
                gap, top = bound(d, size[own], child, reach, relax)
                go = ~(top < worst[own])
                todo.append((child, own[go], gap[go]))
        return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Index:
    trees: DataFrame   # shard, tree
    top: Top
    shards: DataFrame  # region, shard


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> Index | None:
    """The index in the shared folder; ``vectors`` as ``usable`` returns them.  None if there are none."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    # distinct vectors with their k + 1 smallest distinct ids (a query's own id is left out of them later), each as
    # often as its rows stand there, at most k times
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    rows = vectors.withColumn("h", F.xxhash64("v")).groupBy("h", "v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    times = F.array_repeat("vec_id", F.least("n", F.lit(k)).cast("int"))
    distinct = materialize(first.groupBy("h", "v").agg(F.sort_array(F.flatten(F.collect_list(times))).alias("ids"))
                           .withColumn("length", F.sqrt(square)), "ann-distinct")
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    some = distinct.orderBy("h", "v").limit(sample).select("v").toArrow()  # at most ``sample`` vectors
    top = Top.build(_matrix(some.column(0), width), width, min(REGIONS, max(1, -(-n // shard_rows))))
    sent = distinct.sparkSession.sparkContext.broadcast(top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = sent.value.place(_matrix(b.column(1), sent.value.width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32())], [*b.schema.names, "region"])

    placed = small_batches(distinct).select("h", "v", "ids", "length").mapInArrow(
        place, "h bigint, v array<double>, ids array<bigint>, length double, region int")
    placed = materialize(placed, "ann-placed")
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    top.set_lengths({r["region"]: r["length"] for r in sizes.collect()})  # at most REGIONS rows
    parts = sizes.select("region", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    shard = F.format_string("%d-%d", "region", F.pmod("h", "parts").cast("int"))

    def tree(part: pa.Table) -> pa.Table:
        v, ids = _matrix(part.column("v"), width), [np.asarray(x, np.int64) for x in part.column("ids").to_pylist()]
        order = np.lexsort((np.array([x[0] for x in ids]), part.column("h").to_numpy()))  # the same tree whatever the order of arrival
        v, ids = v[order], [ids[i] for i in order]
        blob = pickle.dumps((v, ids, build(v, np.arange(len(v)), np.random.default_rng(0))))
        return pa.table({"shard": part.column("shard")[:1], "tree": pa.array([blob], pa.binary())})

    trees = materialize(placed.join(F.broadcast(parts), "region").withColumn("shard", shard).select("shard", "h", "v", "ids")
                        .groupBy("shard").applyInArrow(tree, "shard string, tree binary"), "ann-index")
    shards = parts.select("region", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.format_string("%d-%d", "region", i))).alias("shard"))
    return Index(trees, top, shards)


_FOUND = "query_id bigint, q bigint, vec_id bigint, score double"


def _find(k: int, width: int, relax: float, block_rows: int):
    """mapInArrow over rows sorted by (shard, part, tree first): the best rows of each query in the shard."""
    def solve(shard: tuple, batch: pa.Table) -> pa.RecordBatch:
        v, ids, root = shard
        q, names = _matrix(batch.column("v"), width), batch.column("query_id").to_numpy()
        # a query's own id may take one place of an entry, so one entry more than is asked for
        best = Best(q, v, np.array([x[0] for x in ids]), k + 1, batch.column("worst").to_numpy())
        search(root, best, np.arange(len(q)), np.zeros(len(q)), relax)
        who, at = np.nonzero(best.row >= 0)
        rows, score = best.row[who, at], best.score[who, at]
        many = np.array([len(ids[r]) for r in rows], np.int64)
        who, score = np.repeat(who, many), np.repeat(score, many)
        vec = np.concatenate([np.zeros(0, np.int64), *(ids[r] for r in rows)])
        keep = vec != names[who]
        who, score, vec = who[keep], score[keep], vec[keep]
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        who = who[top]
        return pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(batch.column("q").to_numpy()[who]), pa.array(vec[top]), pa.array(score[top])],
                                          ["query_id", "q", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = None, [], 0
        for b in batches:
            trees = np.flatnonzero(b.column("tree").is_valid().to_numpy(zero_copy_only=False))
            for at, to in zip([-1, *trees], [*trees, b.num_rows]):
                if at >= 0:  # a tree begins a new group
                    if held:
                        yield solve(shard, pa.Table.from_batches(held))
                    shard, held, size = pickle.loads(b.column("tree")[at].as_py()), [], 0
                for i in range(at + 1, to, block_rows):
                    part = b.slice(i, min(block_rows, to - i))
                    held.append(part)
                    size += part.num_rows
                    if size >= block_rows:
                        yield solve(shard, pa.Table.from_batches(held))
                        held, size = [], 0
        if held:
            yield solve(shard, pa.Table.from_batches(held))

    return run


def _search_shards(index: Index, asked: DataFrame, k: int, relax: float, task_queries: int, block_rows: int) -> DataFrame:
    """Results of ``asked`` (shard, query_id, q, v, worst) in their shards."""
    asked = materialize(asked, "ann-asked")
    parts = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / task_queries).cast("int").alias("parts"))
    trees = index.trees.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tree", F.lit(None).cast("bigint").alias("query_id"),
        F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("worst"))
    queries = asked.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("query_id", "q"), "parts").cast("int").alias("part"), F.lit(None).cast("binary").alias("tree"), "query_id", "q", "v", "worst")
    n = partitions(asked.sparkSession)
    rows = trees.unionByName(queries).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", F.col("query_id").asc_nulls_first())
    return rows.select("tree", "query_id", "q", "v", "worst").mapInArrow(_find(k, index.top.width, relax, block_rows), _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = RELAX, shard_rows: int = SHARD_ROWS,
            block_rows: int = BLOCK_ROWS, task_queries: int = TASK_QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of each query, its own id left out.

    Rows whose vector is null, zero, or holds null or non-finite components take no part, as candidates
    or as queries; a null id takes no part either.  Rows that repeat an id are separate candidates.
    A query row that repeats another's id and vector shares its result; rows of one id with different
    vectors are separate queries, each with its own ``k`` rows under that id.
    Vectors of unequal length are compared as if the shorter ended in zeros.  Ties go to the smaller id,
    however many there are; empty tables give no rows.  Other columns are not read."""
    none = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = materialize(usable(queries).select(F.col("vec_id").alias("query_id"), "v").distinct().withColumn("q", F.xxhash64("v")), "ann-queries")
    width = asked.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return none
    index = build_index(usable(vectors), k, shard_rows, sample)
    if index is None:
        return none
    if width > index.top.width:  # what lies beyond all candidates adds nothing to any inner product
        asked = asked.withColumn("v", F.slice("v", 1, index.top.width))
    top = vectors.sparkSession.sparkContext.broadcast(index.top)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = top.value.place(_matrix(b.column("v"), top.value.width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32())], [*b.schema.names, "region"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block_rows):
                part = b.slice(i, block_rows)
                q, region = top.value.others(_matrix(part.column("v"), top.value.width), part.column("worst").to_numpy(),
                                             part.column("region").to_numpy(), relax)
                for j in range(0, len(q), block_rows):
                    own = part.take(pa.array(q[j:j + block_rows]))
                    yield pa.RecordBatch.from_arrays([own.column("query_id"), own.column("q"), own.column("v"), own.column("worst"),
                                                      pa.array(region[j:j + block_rows], pa.int32())], ["query_id", "q", "v", "worst", "region"])

    placed = materialize(small_batches(asked).select("query_id", "q", "v").mapInArrow(home, "query_id bigint, q bigint, v array<double>, region int"), "ann-home")
    shards = F.broadcast(index.shards) if index.top.regions <= 1 else index.shards
    own = placed.join(shards, "region").select("shard", "query_id", "q", "v", F.lit(float("-inf")).alias("worst"))
    near = materialize(_search_shards(index, own, k, relax, task_queries, block_rows), "ann-near")
    by = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select("query_id", "q", F.col("score").alias("worst"))
    known = placed.join(kth, ["query_id", "q"], "left").select("query_id", "q", "v", "region", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    far = known.mapInArrow(others, "query_id bigint, q bigint, v array<double>, worst double, region int")
    far = far.join(shards, "region").select("shard", "query_id", "q", "v", "worst")
    found = near.unionByName(_search_shards(index, far, k, relax, task_queries, block_rows))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
