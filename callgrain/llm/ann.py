"""Approximate nearest neighbours by inner product, with balanced posting lists.

Index: inner products become Euclidean distances by one more coordinate, sqrt(M^2 -
|x|^2), 0 for queries, M being the largest norm. Centroids come from a bounded sample,
cut again and again at the median of its main direction, so lists are balanced; lists
that are twice too long after the means have settled are cut again. Their number grows
with the table (`list_rows` vectors each) up to about `max_lists`. A vector goes to its nearest
list and, near a boundary, to further lists: those within (1 + `closure`) of the nearest
distance, if each list taken before is more than `apart` times as far from them as the
vector is. Centroids are searched on an in-memory neighbour graph: a query's frontier of
bounded size moves to its nearest centroids, and floods their surroundings from there.

Search: a query visits all lists within (1 + `reach`) of its nearest centroid's
distance, `probes` of them at least, and more while those hold too few vectors.
Neighbouring lists form bins. A query is sent to each bin that holds a list it visits,
with the numbers of its lists there, is compared with the vectors of those lists only,
and answers once a bin. Bins hold about `block` vectors in small tables, and grow with the square root of the
table up to `bin_values` components. Bins and their queries meet in blocks of two bins'
vectors and `block` queries, so a crowded bin spreads over tasks.

Equal vectors are indexed once, with the k + 1 smallest of their ids: no others can be
among k nearest. Equal queries are searched once. Scores are sums of products in
double precision, in order of the components; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than most (ties: the longer). Rows with a
null id take no part. Repeated rows of one id and vector count once. Queries always get
k neighbours, or all candidates if there are fewer. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import materialize, python_ready

CELLS = 1 << 22  # distances held at once while centroids settle
POSTED = "rep long, x array<double>, bin int, lists array<int>"
SLACK = 1.1**2  # a flood of the graph goes so far beyond its limit


@dataclass(frozen=True)
class AnnConfig:
    k: int = 20
    list_rows: int = 128  # vectors of a list, before replicas
    max_lists: int = 20_000
    sample_per_list: int = 16  # the sample has so many rows per list, at most
    closure: float = 0.1
    apart: float = 0.6
    replicas: int = 2
    reach: float = 0.165
    probes: int = 16
    max_probes: int | None = None  # no bound
    graph_degree: int = 24
    beam: int = 24  # centroids in a query's frontier
    sample_values: int = 1 << 25  # and so many components, at most
    block: int = 2048
    bin_values: int = 1 << 19


def clean(vectors: DataFrame) -> DataFrame:
    """(id, x array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    d = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where("id is not null and size(x) > 0")
    d = d.where(F.forall("x", finite)).where(F.exists("x", lambda v: v != 0))
    size = d.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return d.where(F.size("x") == (size["dim"] if size else 0))


def squared(q: np.ndarray, c: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q from those of c, whose squared lengths are sq."""
    return (q**2).sum(axis=1)[:, None] + sq[None, :] - 2 * q @ c.T


class Graph:
    """Centroids, each with its nearest neighbours and a few long links, and a top layer of evenly drawn ones to start from."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c = centroids
        self.sq = (centroids**2).sum(axis=1)
        n = len(centroids)
        m = min(degree, max(1, n - 1))
        self.near = np.zeros((n, m), np.int32)
        for at in range(0, n, 512):
            d = self.sq[None, :] - 2 * centroids[at : at + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            self.near[at : at + 512] = np.argpartition(d, m - 1, axis=1)[:, :m] if n > 1 else 0
        # long links keep the graph connected: every node also knows a few nodes spread over all
        spread = (np.arange(n)[:, None] * 7919 + np.arange(1, 5)[None, :] * max(1, n // 5)) % n
        self.near = np.concatenate([self.near, spread.astype(np.int32)], axis=1)
        self.top = np.unique(np.linspace(0, n - 1, min(n, 2 * math.isqrt(n) + 1)).astype(np.int32))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and numbers of the `beam` nearest centroids found for each row of q, nearest first.

        A query holds a frontier of `beam` centroids. At each step the nearest few that
        weren't are expanded: their neighbours join, and the best `beam` stay.
        """
        n, width = len(self.c), self.near.shape[1]
        beam = min(beam, n)
        d = squared(q, self.c[self.top], self.sq[self.top])
        k = min(beam, len(self.top))
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        ids = np.full((len(q), beam), -1, np.int32)
        dist = np.full((len(q), beam), np.inf, np.float32)
        ids[:, :k], dist[:, :k] = self.top[at], np.take_along_axis(d, at, axis=1)
        done = ids < 0
        while True:
            open_ = np.where(done, np.inf, dist)
            step = min(4, beam)
            pick = np.argpartition(open_, step - 1, axis=1)[:, :step]
            fresh = np.isfinite(np.take_along_axis(open_, pick, axis=1))
            rows = np.flatnonzero(fresh.any(axis=1))
            if not len(rows):
                break
            pick, fresh = pick[rows], fresh[rows]
            done[rows[:, None], pick] = True
            new = self.near[np.where(fresh, ids[rows[:, None], pick], 0)].reshape(len(rows), -1)
            far = (q[rows] ** 2).sum(axis=1)[:, None] + self.sq[new] - 2 * np.matmul(self.c[new], q[rows][:, :, None])[:, :, 0]
            far[np.repeat(~fresh, width, axis=1)] = np.inf
            all_ids = np.concatenate([ids[rows], new], axis=1)
            all_dist = np.concatenate([dist[rows], far.astype(np.float32)], axis=1)
            all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
            order = np.argsort(all_ids, axis=1, kind="stable")  # of equal numbers the one in the frontier is first
            same = np.take_along_axis(all_ids, order, axis=1)
            again = np.zeros(same.shape, bool)
            again[:, 1:] = same[:, 1:] == same[:, :-1]
            np.put_along_axis(all_dist, order, np.where(again, np.inf, np.take_along_axis(all_dist, order, axis=1)), axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids[rows], dist[rows] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_dist, best, axis=1)
            done[rows] = np.take_along_axis(all_done, best, axis=1) | np.isinf(dist[rows])
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(dist, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def within(self, q: np.ndarray, ratio: float, least: int, beam: int) -> list[np.ndarray]:
        """For each row of q: all centroids up to `ratio` times its nearest distance, and `least` at least, nearest first.

        From the frontier of search() the query floods the graph as far as a little beyond
        that distance, looking at each centroid once. Where it has seen an eighth of all
        centroids, it looks at the others as well, in one product.
        """
        n = len(self.c)
        d, found = self.search(q, max(beam, least))
        limit = ratio**2 * np.maximum(d[:, 0], 1e-12)
        dist = np.full((len(q), n), np.inf, np.float32)  # a block of queries x lists, both bounded
        ok = found >= 0
        r, v = np.nonzero(ok)
        dist[r, found[ok]] = d[ok]
        all_ = np.zeros(len(q), bool)
        r, v = np.nonzero(np.isfinite(dist) & (dist <= SLACK * limit[:, None]))
        while len(r):
            seen = np.isfinite(dist).sum(axis=1)
            all_ |= 8 * seen >= n
            go = ~all_[r]
            key = np.unique((r[go, None].astype(np.int64) * n + self.near[v[go]]).ravel())
            r, v = key // n, key % n
            go = np.isinf(dist[r, v])
            r, v = r[go], v[go]
            for at in range(0, len(r), 1 << 16):
                i, j = r[at : at + (1 << 16)], v[at : at + (1 << 16)]
                dist[i, j] = (q[i] ** 2).sum(axis=1) + self.sq[j] - 2 * np.einsum("ij,ij->i", q[i], self.c[j])
            go = dist[r, v] <= SLACK * limit[r]
            r, v = r[go], v[go]
        if all_.any():
            dist[all_] = squared(q[all_], self.c, self.sq)
            limit[all_] = ratio**2 * np.maximum(dist[all_].min(axis=1), 1e-12)
        k = min(least, n)
        reach = np.maximum(limit, np.partition(dist, k - 1, axis=1)[:, k - 1])
        out = []
        for x, top in zip(dist, reach, strict=True):
            near = np.flatnonzero((x <= top) & np.isfinite(x))
            out.append(near[np.argsort(x[near], kind="stable")])
        return out


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` equally large parts of the sample, cut at medians of main directions."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len, reverse=True)
        if len(parts[0]) < 2:
            break
        rest, now = parts[lists - len(parts) :], parts[: lists - len(parts)]
        for p in now:
            if len(p) < 2:
                rest.append(p)
                continue
            rest += halves(sample, p)
        parts = rest
    c = np.stack([sample[p].mean(axis=0) for p in parts])
    for _ in range(2):  # let the means settle; lists stay near their equal sizes
        own = nearest_of(sample, c)
        order = np.argsort(own, kind="stable")
        used, at = np.unique(own[order], return_index=True)
        for i, part in zip(used, np.split(order, at[1:]), strict=True):
            c[i] = sample[part].mean(axis=0)
    return split_crowded(sample, c, 2 * max(1, len(sample) // lists))


def halves(x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A part of the rows of x, cut at the median of its main direction."""
    y = x[part] - x[part].mean(axis=0)
    v = y[int(np.argmax((y**2).sum(axis=1)))].copy()
    for _ in range(6):
        v = y.T @ (y @ v)
        size = np.linalg.norm(v)
        if size == 0:
            break
        v /= size
    order = np.argsort(y @ v, kind="stable")
    return part[order[: len(part) // 2]], part[order[len(part) // 2 :]]


def split_crowded(sample: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """Centroids whose lists hold more than `most` rows of the sample are replaced by those of its halves, until none does."""
    own = nearest_of(sample, c)
    order = np.argsort(own, kind="stable")
    used, at = np.unique(own[order], return_index=True)
    todo, out = np.split(order, at[1:]), []
    for i, part in zip(used, list(todo), strict=True):
        stack, whole = [part], len(part) <= most
        while stack:
            p = stack.pop()
            if len(p) > most and (sample[p] != sample[p[0]]).any():
                stack += halves(sample, p)
            else:
                out.append(c[i] if whole else sample[p].mean(axis=0))
    return np.stack(out)


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, over blocks of x of about CELLS distances."""
    sq, step = (c**2).sum(axis=1)[None, :], max(1, CELLS // len(c))
    return np.concatenate([np.argmin(sq - 2 * x[at : at + step] @ c.T, axis=1) for at in range(0, len(x), step)])


def lists_of(x: np.ndarray, graph: Graph, c: AnnConfig) -> list[list[int]]:
    """For each vector: its nearest list, and further lists across near boundaries."""
    d, found = graph.search(x, 4 * c.replicas)
    d = np.sqrt(np.maximum(d, 0))
    out = []
    for dist, near in zip(d, found, strict=True):
        taken = [int(near[0])]
        for a, i in zip(dist[1:], near[1:], strict=True):
            if len(taken) >= c.replicas or a > (1 + c.closure) * dist[0] + 1e-12:
                break
            if all(np.linalg.norm(graph.c[i] - graph.c[t]) > c.apart * a for t in taken):
                taken.append(int(i))
        out.append(taken)
    return out


def probes_of(q: np.ndarray, graph: Graph, c: AnnConfig) -> list[np.ndarray]:
    """For each query: the lists it visits."""
    return [found[: c.max_probes] for found in graph.within(q, 1 + c.reach, c.probes, c.beam)]


def enough(q: np.ndarray, visited: np.ndarray, graph: Graph, rows: np.ndarray, least: int) -> np.ndarray:
    """The lists of a query: those it visits, and the next nearest until they hold `least` rows together."""
    if rows[visited].sum() >= least:
        return visited
    order = np.argsort(squared(q[None], graph.c, graph.sq)[0], kind="stable")
    order = np.concatenate([visited, order[~np.isin(order, visited)]])
    return order[: int(np.searchsorted(np.cumsum(rows[order]), least)) + 1]


def by_bin(frame: pd.DataFrame, lists: list, bins: np.ndarray) -> pd.DataFrame:
    """A row of rep and x for each bin that holds one of the row's lists, with its lists there."""
    at, bin_of, held = [], [], []
    for i, own in enumerate(lists):
        own = np.asarray(own, np.int32)
        for b in np.unique(bins[own]):
            at.append(i)
            bin_of.append(b)
            held.append(own[bins[own] == b])
    out = frame[["rep", "x"]].iloc[at].reset_index(drop=True)
    return out.assign(bin=np.array(bin_of, np.int32), lists=pd.Series(held, dtype=object))


def members(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The rows of each list, from the lists of each row."""
    size = np.array([len(x) for x in lists], np.int64)
    rows, flat = np.repeat(np.arange(len(lists)), size), np.concatenate(lists)
    order = np.argsort(flat, kind="stable")
    used, at = np.unique(flat[order], return_index=True)
    return dict(zip(used.tolist(), np.split(rows[order], at[1:]), strict=True))


def bins_of(centroids: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each list: neighbours share one."""
    if bins >= len(centroids):
        return np.arange(len(centroids), dtype=np.int32)
    middles = balanced_centroids(centroids, bins)
    return nearest_of(centroids, middles).astype(np.int32)


def nearest(vectors: DataFrame, queries: Column, config: AnnConfig | None = None) -> DataFrame:
    """vectors(vec_id, embedding); queries: condition on `id` that selects query rows.

    Returns query_id, rank, vec_id, score: each query's k nearest other rows.
    """
    c = config or AnnConfig()
    spark = vectors.sparkSession
    python_ready(spark)
    rows = materialize(clean(vectors), "vectors")
    # equal vectors once, with the smallest ids
    ranked = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("n") <= c.k + 1)
    points = materialize(ranked.groupBy("x").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "points")
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    total, top = stats["n"], stats["m"] or 0.0
    bin_rows, dim = c.block, 1
    if total:
        dim = len(points.first()["x"])
        bin_rows = max(c.block, int(min(c.block * (total / (4 * c.block)) ** 0.5, c.bin_values / dim)))
    lists = int(min(c.max_lists, max(1, total // c.list_rows), max(1, c.sample_values // dim // 4)))
    bound = min(lists * c.sample_per_list, max(1, c.sample_values // dim))
    sample = points.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * bound / max(1, total)))).orderBy(F.xxhash64("rep"), "rep").select(F.col("x").cast("array<float>").alias("x")).limit(bound).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def raised(x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0))
        return np.concatenate([x.astype(np.float32), last.astype(np.float32)[:, None]], axis=1)

    flat = np.concatenate([part.flatten().to_numpy() for part in sample["x"].chunks])
    graph = Graph(balanced_centroids(raised(flat.reshape(sample.num_rows, -1)), lists).astype(np.float32), c.graph_degree)
    del flat, sample
    shared = spark.sparkContext.broadcast((graph, bins_of(graph.c, -(-total // bin_rows))))  # bounded by max_lists

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, bins = shared.value
        for f in frames:
            if len(f):
                yield by_bin(f, lists_of(raised(np.stack(f["x"].to_numpy())), graph, c), bins)

    posted = materialize(points.select("rep", "x").mapInPandas(assign, POSTED), "lists")
    # a row per list, at most max_lists. A vector is in at most `replicas` lists, so so many rows hold k + 1 vectors
    counted = posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect()
    held, least = np.zeros(len(graph.c), np.int64), c.replicas * (c.k + 1)
    held[[r["list"] for r in counted]] = [r["count"] for r in counted]

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, bins = shared.value
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy())
                q = np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)
                yield by_bin(f, [enough(y, t, graph, held, least) for y, t in zip(q, probes_of(q, graph, c), strict=True)], bins)

    asked_rows = rows.where(queries).select("id", "x").distinct()
    asked = asked_rows.join(points.select("x", "rep"), "x").select("id", "rep")
    asked = materialize(asked, "queries")
    distinct = points.join(asked.select("rep").distinct(), "rep").select("rep", "x")
    probed = materialize(distinct.mapInPandas(probe, POSTED), "probes")
    sizes = posted.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(probed.groupBy("bin").agg(F.count(F.lit(1)).alias("m")), "bin")
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = F.broadcast(sizes.select("bin", cut("n", 2 * bin_rows).alias("vs"), cut("m", c.block).alias("qs")))  # a row per bin, at most max_lists
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = posted.join(sizes, "bin").select("bin", F.pmod(F.xxhash64("rep"), F.col("vs")).cast("int").alias("v"), span("qs").alias("q"), "rep", "x", "lists")
    q = probed.join(sizes, "bin").select("bin", span("vs").alias("v"), F.pmod(F.xxhash64("rep"), F.col("qs")).cast("int").alias("q"), "rep", "x", "lists")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "rep": [], "score": []})
        if not len(left) or not len(right):
            return none
        x, y = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        ids, asked = left["rep"].to_numpy(), members(right["lists"].to_list())
        size = np.sqrt((x**2).sum(axis=1).max())
        slack = 1e-12 * size * np.sqrt((y**2).sum(axis=1))
        near = []
        for number, rows in members(left["lists"].to_list()).items():
            own, keep = x[rows], min(len(rows), c.k + 1)
            for at in range(0, len(asked.get(number, ())), 256):
                i = asked[number][at : at + 256]
                s = y[i] @ own.T  # these scores only preselect: all that may tie with the last place stay
                last = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                a, b = np.nonzero(s >= (last - slack[i])[:, None])
                near.append(i[a] * len(x) + rows[b])
        if not near:
            return none
        i, j = np.divmod(np.unique(np.concatenate(near)), len(x))  # a vector of two lists once
        exact = np.zeros(len(i))
        for d in range(x.shape[1]):
            exact += y[i, d] * x[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < c.k + 1
        return pd.DataFrame({"query": right["rep"].to_numpy()[i[best]], "rep": ids[j[best]], "score": exact[best]})

    pairs = v.groupBy("bin", "v", "q").cogroup(q.groupBy("bin", "v", "q")).applyInPandas(compare, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    pairs = pairs.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= c.k + 1)
    found = pairs.join(points.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= c.k + 1)
    answers = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("a"))
    own = asked.join(answers, asked["rep"] == answers["query"]).select(F.col("id").alias("query_id"), F.filter("a", lambda e: e["vec_id"] != F.col("id")).alias("a"))
    out = own.select("query_id", F.posexplode(F.slice("a", 1, c.k)).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("id") % 20 == 0)
