"""Exact top-k search by inner product in a paged M-tree, best first.

Integer vectors get one more component that brings all candidates to the same length (queries get 0 there), so Euclidean distance orders
them as the inner product does. The tree has three levels: routing vectors, a bounded sample of the data, in an order that keeps near
ones together; nodes, the vectors nearest to one routing vector, about NODE_ROWS of them; and pages of at most PAGE_ROWS. All levels
keep a covering radius, and entries their distance to the page's routing vector (their parent). A query block visits nodes and, in a
node, pages from the most promising on, leaves out nodes and pages whose ball cannot hold a score that counts, and entries that the
triangle inequality with the stored parent distance excludes; scores are exact integers. A first round in each query's home node
gives the score to beat.

Every row is indexed; a hot vector's rows are dealt over several nodes, rows that repeat an id too. Queries meet nodes in cells of a query
block and a group of nodes, each a bounded task; no cell sees all queries or all rows. Before anything is sent, the balls of the
routing vectors (at most MAX_ROUTING, held by every task) tell which groups a query needs; a group is copied once for each block of the queries that
need it. Where balls exclude nothing, as with vectors of many independent components, the shuffle is that of a blocked product:
rows times queries over the size of a cell, so cells are as large as BLOCK_BYTES and GROUP_BYTES allow and vectors travel as the narrowest integers that hold them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import staged

NODE_ROWS = 1024
PAGE_ROWS = 128
#: Most routing vectors of the upper level, and the rows that each is meant for while there are fewer.
MAX_ROUTING = 4096
ROWS_PER_ROUTING = 1024
#: Vectors of a block of queries and of a group of nodes, in bytes, at most; and the cells that smaller blocks and groups are made for while there are fewer.
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 1 << 23
CELLS = 64
#: Queries of a block, at most and in the first round.
BLOCK_QUERIES = 4096
HOME_QUERIES = 512
#: Pairs of a query and a group that are looked at, or handed on, at once.
PAIRS = 1 << 14
#: Relative allowance for rounding in bounds.
SLACK = 1e-9

NODE_SCHEMA = "node int, ids binary, vectors binary, to_parent binary, pages binary, routing binary, radii binary, centre binary, radius double"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Vectors that are null or hold null or non-finite components are left out, and so are null ids; an empty one counts as zeros."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.filter(fine).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows as float64, shorter ones padded with zeros. Integers are exact up to 2^53."""
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -(2**62), 2**62).astype(np.int64)


def _raised(m: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that brings them to the length ``sqrt(longest)``."""
    return np.column_stack([m, np.sqrt(np.maximum(0, longest - (m * m).sum(1)))])


def _pages(points: np.ndarray, most: int = PAGE_ROWS) -> list[np.ndarray]:
    """Row numbers of pages, near ones after each other: balls split between two far rows until they are small; rows that coincide are cut in order."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = points[rows]
        one = own[((own - own[0]) ** 2).sum(1).argmax()]
        to_one = ((own - one) ** 2).sum(1)
        left = to_one <= ((own - own[to_one.argmax()]) ** 2).sum(1)
        if left.all() or not left.any():
            done += [rows[i : i + most] for i in range(0, len(rows), most)]
        else:
            open_ += [rows[left], rows[~left]]
    return done


def _packed(m: np.ndarray, kind: str) -> list[bytes]:
    return [x.tobytes() for x in m.astype(kind)]


def _unpacked(rows, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def _node(key: tuple, pdf: pd.DataFrame, kind: str, dim: int, longest: float) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    m = _unpacked(pdf["v"], kind, dim)
    points, ids = _raised(m, longest), pdf["vec_id"].to_numpy(np.int64)
    pages = _pages(points)
    order = np.concatenate(pages)
    routing = np.array([points[p].mean(0) for p in pages])
    to_parent = np.concatenate([_distances(points[p], r[None])[:, 0] for p, r in zip(pages, routing)])
    sizes = np.array([len(p) for p in pages], np.int64)
    ends = np.cumsum(sizes)
    radii = np.maximum.reduceat(to_parent, ends - sizes)
    centre = points.mean(0)
    return pd.DataFrame({
        "node": [key[0]], "ids": [ids[order].tobytes()], "vectors": [m[order].astype(kind).tobytes()], "to_parent": [to_parent.tobytes()],
        "pages": [ends.tobytes()], "routing": [routing.tobytes()], "radii": [radii.tobytes()], "centre": [centre.tobytes()],
        "radius": [float(_distances(points, centre[None]).max())],
    })


def highest(distance: np.ndarray, radius, span) -> np.ndarray:
    """The highest score that a ball can hold, for queries at a distance from its centre; ``span`` is the sum of both squared lengths."""
    near = np.maximum(0, distance - radius)
    return (span - near * near) / 2 + SLACK * (span + 1)


class Searcher:
    """The best candidates of a block of queries, kept over the nodes that it visits."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, kind: str, beat: np.ndarray, k: int, longest: float):
        self.ids, self.m, self.kind, self.k, self.longest = ids, m, kind, k, longest
        self.points = np.column_stack([m, np.zeros(len(m))])
        self.squares = (m * m).sum(1)
        self.least = beat.astype(np.int64)  # a lower score cannot be among the best
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.computed = 0

    def _reach(self, distance: np.ndarray, radius, q) -> np.ndarray:
        return highest(distance, radius, self.longest + self.squares[q])

    def search(self, nodes: pd.DataFrame) -> None:
        """Visit nodes from the one on whose ball holds the highest score that any query may find."""
        if len(nodes):
            reach = self._reach(_distances(self.points, np.stack([np.frombuffer(c) for c in nodes["centre"]])), nodes["radius"].to_numpy()[None], np.arange(len(self.ids))[:, None])
            for i in np.argsort(-reach.max(0), kind="stable"):
                self.visit(nodes.iloc[i], np.nonzero(reach[:, i] >= self.least)[0])

    def visit(self, row, q: np.ndarray) -> None:
        if not len(q):
            return
        dim = self.m.shape[1]
        ids, m, to_parent = np.frombuffer(row.ids, np.int64), _unpacked([row.vectors], self.kind, dim), np.frombuffer(row.to_parent)
        ends, radii = np.frombuffer(row.pages, np.int64), np.frombuffer(row.radii)
        starts = np.concatenate([[0], ends[:-1]])
        distance = _distances(self.points[q], np.frombuffer(row.routing).reshape(-1, dim + 1))
        reach = np.stack([self._reach(distance[:, j], radii[j], q) for j in range(len(ends))], 1)
        order = np.argsort(-reach, axis=1, kind="stable")
        for turn in range(len(ends)):  # every query's next best page; those for the same page go together
            page = order[:, turn]
            going = reach[np.arange(len(q)), page] >= self.least[q]
            if not going.any():
                return
            for j in np.unique(page[going]):
                at = np.nonzero(going & (page == j))[0]
                own = slice(starts[j], ends[j])
                gap = np.abs(distance[at, j][:, None] - to_parent[None, own])
                may = (self._reach(gap, 0, q[at][:, None]) >= self.least[q[at]][:, None]).any(0)
                if may.any():
                    self._offer(q[at], ids[own][may], m[own][may])

    def _offer(self, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        got = _products(self.m[q], m)
        self.computed += got.size
        fits = (got >= self.least[q][:, None]) & (ids[None] != self.ids[q][:, None])
        some = fits.any(1)
        if not some.any():
            return
        q, got, fits = q[some], got[some], fits[some]
        scores = np.concatenate([self.scores[q], np.where(fits, got, np.iinfo(np.int64).min)], 1)
        found = np.concatenate([self.found[q], np.where(fits, ids[None], np.iinfo(np.int64).max)], 1)
        best = np.lexsort((found, -scores.astype(np.float64)), axis=1)[:, : self.k] if np.abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else np.lexsort((found, ~scores), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)
        self.least[q] = np.maximum(self.least[q], self.scores[q][:, -1])

    def rows(self) -> pd.DataFrame:
        i, j = np.nonzero(self.found < np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": self.ids[i], "vec_id": self.found[i, j], "score": self.scores[i, j]})


FOUND_SCHEMA = "query_id long, vec_id long, score long"
LOWEST = -(2**62)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` candidates of highest score for each query row of ``vectors(vec_id, embedding)``: query_id, rank, vec_id, score.

    Scores are inner products of floor(scale * x). Candidates are all rows but those with the query's own vec_id; ties go to the smaller
    vec_id; fewer candidates give fewer rows. Unusable vectors (see ``quantised``) take no part; scores are clipped to 2^62 either way; shorter vectors count as padded with zeros.
    Rows that repeat a vec_id are candidates each, but a query once. No rows or no queries give an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, dim, longest, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    kind = next((t for t in ("int8", "int16", "int32") if (most or 0) <= np.iinfo(t).max), "float64")
    routing_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(max(1, min(MAX_ROUTING, n // ROWS_PER_ROUTING))).collect()
    points = _raised(_matrix([r["v"] for r in routing_rows], dim), longest)
    routing = spark.sparkContext.broadcast(points[np.concatenate(_pages(points, 1))])

    def routed(it):
        for b in it:
            m, is_q = _matrix(b.column(1).to_pylist(), dim), b.column(2).to_numpy(zero_copy_only=False)
            away = _distances(_raised(m, longest), routing.value)
            home, asked = away.argmin(1), _distances(np.column_stack([m, np.zeros(len(m))]), routing.value).argmin(1)
            columns = [b.column(0), pa.array(_packed(m, kind), pa.binary()), pa.array(home.astype(np.int32)), pa.array(away.min(1)), pa.array(np.where(is_q, asked, -1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "home", "away", "asked"])

    rows = rows.mapInArrow(routed, "vec_id long, v binary, home int, away double, asked int")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "routed")  # row is fixed once written
    homes = rows.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas().sort_values("home")  # at most MAX_ROUTING rows
    homes["parts"] = -(-homes["n"] // NODE_ROWS)
    homes["first"] = homes["parts"].cumsum() - homes["parts"]
    at = spark.createDataFrame(homes[["home", "first", "parts"]], "home int, first long, parts long")
    width = F.pmod(F.xxhash64("row", F.lit("node")), F.col("parts"))
    numbered = rows.join(F.broadcast(at), "home").select((F.col("first") + width).cast("int").alias("node"), "vec_id", "v")
    nodes = staged(numbered.groupBy("node").applyInPandas(lambda key, pdf: _node(key, pdf, kind, dim, longest), NODE_SCHEMA), "nodes")

    # first round: a query in one node of its nearest routing vector that has rows at all
    queries = rows.filter("asked >= 0").dropDuplicates(["vec_id"]).select("vec_id", "v", F.col("asked").alias("home"))
    asked_of = queries.groupBy("home").agg(F.ceil(F.count("*") / HOME_QUERIES).cast("int").alias("blocks"))
    starts = asked_of.join(F.broadcast(at), "home", "left").select("home", F.col("first").cast("int").alias("node"), "blocks")  # at most MAX_ROUTING rows
    salted = queries.join(F.broadcast(starts), "home").select("vec_id", "v", F.coalesce("node", F.lit(-1)).alias("node"), F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("blocks")).cast("int").alias("part"))
    first = nodes.join(F.broadcast(starts), "node").select(nodes["*"], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))

    def first_round(key, asked: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        beat = [np.zeros(0, np.int64)]
        for i in range(0, len(asked), BLOCK_QUERIES):
            some = asked.iloc[i : i + BLOCK_QUERIES]
            searcher = Searcher(some["vec_id"].to_numpy(np.int64), _unpacked(some["v"], kind, dim), kind, np.full(len(some), LOWEST), k, longest)
            searcher.search(node)
            beat.append(np.maximum(searcher.scores[:, -1], LOWEST))
        return pd.DataFrame({"vec_id": asked["vec_id"], "v": asked["v"], "beat": np.concatenate(beat)})

    met = salted.groupBy("node", "part").cogroup(first.groupBy("node", "part"))
    asked = staged(met.applyInPandas(first_round, "vec_id long, v binary, beat long"), "queries")

    # second round: the groups that each query needs, told by the routing vectors' balls, then cells
    size = np.dtype(kind).itemsize * dim
    block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // size))
    total, blocks = int(homes["parts"].sum()), -(-max(1, asked.count()) // block)
    per_group = max(1, min(GROUP_BYTES // (size * NODE_ROWS), total * blocks // CELLS))
    balls = homes["home"].to_numpy(), homes["radius"].to_numpy()
    begin = (homes["first"] // per_group).to_numpy(np.int64)
    end = ((homes["first"] + homes["parts"] - 1) // per_group).to_numpy(np.int64) + 1
    groups = int(end.max())

    def needed(it):
        centres = routing.value[balls[0]]
        step = max(1, PAIRS // groups)
        for b in it:
            for i in range(0, b.num_rows, step):
                some = b.slice(i, step)
                m, beat = _unpacked(some.column(1).to_pylist(), kind, dim), some.column(2).to_numpy()
                span = longest + (m * m).sum(1)[:, None]
                need = highest(_distances(np.column_stack([m, np.zeros(len(m))]), centres), balls[1], span) >= beat[:, None]
                edges = np.zeros((len(m), groups + 1), np.int32)  # +1 where a needed home's groups begin, -1 behind them
                q, h = np.nonzero(need)
                np.add.at(edges, (q, begin[h]), 1)
                np.add.at(edges, (q, end[h]), -1)
                q, g = np.nonzero(np.cumsum(edges, 1)[:, :groups])
                for j in range(0, len(q), PAIRS):
                    sent = some.take(pa.array(q[j : j + PAIRS]))
                    yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(g[j : j + PAIRS].astype(np.int32))], names=["vec_id", "v", "beat", "grp"])

    pairs = staged(asked.mapInArrow(needed, "vec_id long, v binary, beat long, grp int"), "pairs")
    wanted = pairs.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left = pairs.join(wanted, "grp").select("vec_id", "v", "beat", "grp", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int").alias("block"))
    right = nodes.withColumn("grp", F.floor(F.col("node") / per_group).cast("int")).join(wanted, "grp").select("grp", *nodes.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def cell(key, asked: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        searcher = Searcher(asked["vec_id"].to_numpy(np.int64), _unpacked(asked["v"], kind, dim), kind, asked["beat"].to_numpy(np.int64), k, longest)
        if len(asked):
            searcher.search(node)
        return searcher.rows()

    found = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInPandas(cell, FOUND_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
