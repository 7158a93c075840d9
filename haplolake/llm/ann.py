"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Nearness is the largest inner product. With one more coordinate, sqrt(largest squared norm - squared
norm), it becomes the least distance, so graphs are built and searched by distance.

Equal vectors are folded into one node that keeps its smallest ids; more than the result size plus one
can't appear in any result. Nodes are dealt to shards by a hash of their id. A shard draws a level for
each node and inserts the nodes in batches, those of high levels first. An inserted node looks for its
place as a query does: from the entry node a beam goes down the levels, and on each of its own levels the
node links to found ones that are nearer to it than to each other; these link back, keeping their nearest.
A batch is no larger than the graph so far, and its nodes see each other too, so a node misses nothing
that another order of insertion would show it. A node is numbered by its insertion, so a level's nodes
are the first ones, and a graph is flat arrays: vectors, and a padded list of neighbours for each level.

All shards are searched for all queries. A task holds one shard at a time: its graph comes first, and the
queries stream past it in batches, so a graph moves once, however many queries there are. Results of the shards are merged, scored again in double precision, and opened up to the folded
ids.

The whole table is indexed, no sample is taken. Vectors of different lengths have no inner product: each
length has shards of its own, and a query finds vectors of its length. Defined cases: rows with a null id,
and vectors that are null, empty, zero, or hold null or non-finite components take no part. Rows that
repeat id and vector count once; an id with several vectors is several candidates. Ties go to the smaller
id. With fewer candidates than asked for, all are returned. Other columns are not carried. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.minhash import mixed
from haplolake.llm.storage import written

#: Bounds of a shard: nodes, and bytes of their vectors.
SHARD_ROWS, SHARD_BYTES = 16_384, 64_000_000
#: Links that a node chooses on a level; nearest ones that it accepts back, on the lowest level and above.
LINKS, BACK, BACK_ABOVE = 24, 48, 24
BATCH, BUILD_BEAM, BEAM, STEP = 512, 48, 112, 6
#: Rows of one vector that are folded in one task, in the mean; bound on the number of tasks.
SALT_ROWS, MOST_TASKS = 4096, 100_000


class Graph:
    """Points (single precision, with the added coordinate) in order of insertion; neighbour lists of each
    level, lowest first (-1: none), as long as the level has nodes."""

    def __init__(self, vectors: np.ndarray, largest: float, links: list[np.ndarray]) -> None:
        squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        extra = np.sqrt(np.maximum(largest - squares, 0))
        self.points = np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)
        self.half = np.einsum("ij,ij->i", self.points, self.points) / 2
        self.links = links

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, largest: float) -> tuple[Graph, np.ndarray]:
        """The graph, and the given rows in order of insertion. ids seed the levels; largest: greatest squared norm."""
        u = (mixed(ids.astype(np.uint64), 11) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        level = np.minimum((-np.log(u) / np.log(LINKS)).astype(np.int64), 8)
        order = np.lexsort((mixed(ids.astype(np.uint64), 12), -level))
        count = [int((level >= at).sum()) for at in range(int(level.max()) + 1)]
        graph = cls(vectors[order], largest, [np.full((n, LINKS + (BACK_ABOVE if at else BACK)), -1, dtype=np.int32) for at, n in enumerate(count)])
        far = [np.full((n, x.shape[1] - LINKS), np.inf, dtype=np.float32) for n, x in zip(count, graph.links, strict=True)]
        begin = 1
        while begin < len(order):
            end = min(len(order), begin + min(BATCH, begin))
            batch = graph.points[begin:end]
            entry = np.zeros((len(batch), 1), dtype=np.int64)
            for at in range(len(count) - 1, -1, -1):
                members = max(0, min(end, count[at]) - begin)
                entry, score = graph._beam(batch, entry, at, min(begin, count[at]), BUILD_BEAM if members else 8)
                if members:
                    own = graph._choose(begin, members, entry[:members], score[:members])
                    graph.links[at][begin : begin + members, :LINKS] = own
                    graph._link_back(at, begin, own, far[at])
            begin = end
        return graph, order

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """Node numbers (-1: none) of the k best found for every query, best first."""
        queries = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for at in range(len(self.links) - 1, -1, -1):
            entry, _ = self._beam(queries, entry, at, len(self.links[at]), 8 if at else max(beam, k))
        return entry[:, :k]

    def _scores(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Row by row, larger for nearer: half of what a query's square is above the squared distance."""
        return np.einsum("nd,nd->n", queries, np.take(self.points, nodes, axis=0)) - self.half[nodes]

    def _beam(self, queries: np.ndarray, entry: np.ndarray, at: int, size: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found on a level of ``size`` nodes so far, and their scores, best first."""
        n, width, links = len(queries), max(beam, entry.shape[1]), self.links[at]
        # For every query and node: its place in the list that it was found in, or -1.
        seen = np.full(n * size, -1, dtype=np.int32)
        node = np.full((n, width), -1, dtype=np.int64)
        score = np.full((n, width), -np.inf, dtype=np.float32)
        row, column = np.nonzero(entry >= 0)
        node[:, : entry.shape[1]] = entry
        score[row, column] = self._scores(queries[row], entry[row, column])
        seen[row * size + entry[row, column]] = 0
        done = node < 0
        active = np.arange(n)
        step = min(STEP, width)
        while True:
            waiting = np.where(done[active], -np.inf, score[active])
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            live = np.take_along_axis(waiting, pick, axis=1) > -np.inf
            going = live.any(axis=1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] |= live
            near = np.take(links, node[rows, pick][live], axis=0).reshape(-1)
            ends = np.cumsum(live.sum(1)) * links.shape[1]
            place = np.flatnonzero(near >= 0)
            spot = np.repeat(active * size, np.diff(ends, prepend=0))[place] + near[place]
            fresh = np.flatnonzero(seen[spot] < 0)
            place, spot = place[fresh], spot[fresh]
            # A node that two of the picked ones share is taken once.
            seen[spot] = np.arange(len(spot))
            place = place[seen[spot] == np.arange(len(spot))]
            new, per = near[place], np.diff(np.searchsorted(place, ends), prepend=0)
            row = np.repeat(np.arange(len(active)), per)
            # New ones in one block, as wide as the longest list.
            slot = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            found = np.full((len(active), int(per.max(initial=0))), -np.inf, dtype=np.float32)
            found[row, slot] = self._scores(np.repeat(queries[active], per, axis=0), new)
            name = np.full(found.shape, -1, dtype=np.int64)
            name[row, slot] = new
            scores = np.concatenate([score[active], found], axis=1)
            best = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            score[active] = np.take_along_axis(scores, best, axis=1)
            node[active] = np.take_along_axis(np.concatenate([node[active], name], axis=1), best, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], name < 0], axis=1), best, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(node, order, axis=1), np.take_along_axis(score, order, axis=1)

    def _choose(self, begin: int, members: int, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        """LINKS neighbours of each of the nodes begin, begin + 1, ...: those nearer to it than to a nearer one first."""
        own = self.points[begin : begin + members]
        between = own @ own.T - self.half[begin : begin + members]
        np.fill_diagonal(between, -np.inf)
        mates = np.argpartition(-between, min(LINKS, members) - 1, axis=1)[:, :LINKS]
        node = np.concatenate([found, np.where(np.take_along_axis(between, mates, 1) > -np.inf, mates + begin, -1)], axis=1)
        score = np.concatenate([score, np.take_along_axis(between, mates, 1)], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, : 2 * LINKS + 8]
        node, score = np.take_along_axis(node, best, 1), np.take_along_axis(score, best, 1)
        out = np.full((members, LINKS), -1, dtype=np.int32)
        for lo in range(0, members, 128):
            c, near = node[lo : lo + 128], score[lo : lo + 128]
            x, half = self.points[c], self.half[c]
            # Squared distances, halved, without the node's own square: to the node, and between candidates.
            to_node = self.half[begin + lo : begin + lo + len(c), None] - near
            apart = half[:, :, None] + half[:, None, :] - x @ x.transpose(0, 2, 1)
            kept, closest = np.zeros(c.shape, dtype=bool), np.full(c.shape, np.inf, dtype=np.float32)
            for j in range(c.shape[1]):
                kept[:, j] = (to_node[:, j] <= closest[:, j]) & (c[:, j] >= 0)
                closest = np.where(kept[:, j][:, None], np.minimum(closest, apart[:, j, :]), closest)
            # Room that these leave goes to the nearest others.
            first = np.argsort(~kept + 2 * (c < 0), axis=1, kind="stable")[:, :LINKS]
            out[lo : lo + 128, : first.shape[1]] = np.take_along_axis(c, first, 1)
        return out

    def _link_back(self, at: int, begin: int, own: np.ndarray, far: np.ndarray) -> None:
        """Nodes that were chosen link back to the choosers as far as these are among their nearest."""
        row, column = np.nonzero(own >= 0)
        to, by = own[row, column], begin + row
        distance = self.half[to] - self._scores(self.points[by], to)  # half the squared distance, less the same for all of one node
        distance = distance + self.half[by] - self.half[to]
        order = np.lexsort((distance, to))
        to, by, distance = to[order], by[order], distance[order]
        chosen, first, count = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, count)
        width = far.shape[1]
        fits = slot < width
        place = np.repeat(np.arange(len(chosen)), count)[fits]
        new, name = np.full((len(chosen), width), np.inf, dtype=np.float32), np.full((len(chosen), width), -1, dtype=np.int32)
        new[place, slot[fits]], name[place, slot[fits]] = distance[fits], by[fits]
        new, name = np.concatenate([far[chosen], new], axis=1), np.concatenate([self.links[at][chosen, LINKS:], name], axis=1)
        best = np.argpartition(new, width - 1, axis=1)[:, :width]
        far[chosen], self.links[at][chosen, LINKS:] = np.take_along_axis(new, best, 1), np.take_along_axis(name, best, 1)


def usable(embedding: Column, id_: Column) -> Column:
    """Rows that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return id_.isNotNull() & embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


_INDEX = "n int, shard int, largest double, ids binary, vectors binary, sizes array<int>, widths array<int>, links binary"


def _build(table: pa.Table) -> pa.Table:
    ids, largest = table.column("node").to_numpy(), table.column("largest")[0].as_py()
    exact = _matrix(table.column("v"), np.float64)
    graph, order = Graph.build(exact.astype(np.float32), ids, largest)
    one = lambda x, kind: pa.array([x], kind)
    return pa.table(
        {
            "n": table.column("n")[:1],
            "shard": table.column("shard")[:1],
            "largest": one(largest, pa.float64()),
            "ids": one(ids[order].tobytes(), pa.binary()),
            "vectors": one(exact[order].tobytes(), pa.binary()),
            "sizes": one([len(x) for x in graph.links], pa.list_(pa.int32())),
            "widths": one([x.shape[1] for x in graph.links], pa.list_(pa.int32())),
            "links": one(b"".join(x.tobytes() for x in graph.links), pa.binary()),
        }
    )


def _loaded(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    """Graph, ids and vectors of an index row."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    exact = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(ids), -1)
    flat, at, links = np.frombuffer(row["links"], dtype=np.int32), 0, []
    for size, width in zip(row["sizes"], row["widths"], strict=True):
        links.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(exact.astype(np.float32), row["largest"], links), ids, exact


def _searcher(k: int, beam: int):
    """Rows sorted by shard, a shard's graph before its queries: the nearest nodes of each query in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            n, shard, is_query = (batch.column(c).to_numpy() for c in ("n", "shard", "is_query"))
            cuts = np.flatnonzero((np.diff(n) != 0) | (np.diff(shard) != 0) | (np.diff(is_query) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
                if a == b:
                    continue
                if not is_query[a]:
                    held, of = _loaded({c: batch.column(c)[a].as_py() for c in ("largest", "ids", "vectors", "sizes", "widths", "links")}), (n[a], shard[a])
                elif of == (n[a], shard[a]):  # a shard that got no node has no graph
                    graph, ids, exact = held
                    part = batch.slice(a, b - a)
                    query, q = part.column("query").to_numpy(), part.column("v").flatten().to_numpy().reshape(b - a, -1)
                    for at in range(0, len(query), BATCH):
                        some = q[at : at + BATCH]
                        found = graph.search(some, 2 * (k + 1), beam)
                        score = np.where(found >= 0, np.einsum("qd,qkd->qk", some, exact[found]), -np.inf)
                        node = np.where(found >= 0, ids[found], np.iinfo(np.int64).max)
                        best = np.lexsort((node, -score), axis=1)[:, : k + 1]
                        score, node = np.take_along_axis(score, best, 1), np.take_along_axis(node, best, 1)
                        on = score > -np.inf
                        yield pa.RecordBatch.from_pydict({"query": np.repeat(query[at : at + BATCH], on.sum(1)), "node": node[on], "score": score[on]})

    return run


def _folded(rows: DataFrame, most: int) -> DataFrame:
    """node (its least id), v, ids (its ``most`` least ids) of every different vector of rows (id, v, h: a hash of v).

    Vectors whose hash occurs once need no folding; the others are folded in two steps, in as many parts as their
    number asks for, so that no task gets all rows of one vector.
    """
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select(F.col("h").alias("_h"), "uses")
    single = rows.join(repeated, F.col("h") == F.col("_h"), "left_anti").select(F.col("id").alias("node"), "v", F.array("id").alias("ids"))
    salted = rows.join(repeated, F.col("h") == F.col("_h")).withColumn("s", F.pmod(F.xxhash64("id"), F.ceil(F.col("uses") / SALT_ROWS))).drop("_h", "uses")
    few = salted.withColumn("r", F.dense_rank().over(Window.partitionBy("v", "s").orderBy("id"))).filter(F.col("r") <= most)
    folded = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids"))
    return single.unionByName(folded.select(F.col("ids")[0].alias("node"), "v", "ids"))


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to every row whose id is divisible by ``every``."""
    v, i = F.col(vector_col).cast("array<double>"), F.col(id_col).cast("long")
    plus_zero = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 is 0.0, for the hash too
    rows = written(vectors.filter(usable(F.col(vector_col), i)).select(i.alias("id"), plus_zero.alias("v")).withColumn("h", F.xxhash64("v")), "vectors")
    nodes = written(_folded(rows, k + 1).withColumn("n", F.size("v")), "nodes")
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    count = F.count(F.lit(1))
    lengths = nodes.groupBy("n").agg(F.ceil(F.greatest(count / shard_rows, count * F.col("n") * 8 / shard_bytes)).cast("int").alias("shards"), norm.alias("largest"))
    # A shard is much work from few bytes: a number of tasks is given, so that Spark does not join small ones.
    tasks = min(MOST_TASKS, 2 * (lengths.agg(F.sum("shards")).first()[0] or 1))
    dealt = nodes.join(lengths, "n").select("n", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "largest", "node", "v")
    index = written(dealt.repartition(tasks, "n", "shard").groupBy("n", "shard").applyInArrow(_build, _INDEX), "index")

    asked = rows.filter(F.col("id") % every == 0)
    questions = written(asked.groupBy("v").agg(F.min("id").alias("query")).withColumn("n", F.size("v")), "queries")
    to_shards = questions.join(lengths.select("n", "shards"), "n").select("n", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "query", "v")
    both = index.withColumn("is_query", F.lit(0)).unionByName(to_shards.withColumn("is_query", F.lit(1)), allowMissingColumns=True)
    hits = both.repartition(tasks, "n", "shard").sortWithinPartitions("n", "shard", "is_query").mapInArrow(_searcher(k, beam), "query long, node long, score double")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    opened = best.join(nodes.select("node", "ids", "n"), "node")
    opened = opened.join(questions.select("query", F.col("n").alias("_n")), "query").filter("n = _n").select("query", "score", F.explode("ids").alias("id"))
    ranked = opened.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    # Queries with one vector share a list, from which each takes out itself.
    answers = asked.select("id", "v").distinct().join(questions.select("v", "query"), "v").join(lists, "query")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
