"""Approximate nearest neighbours by cosine: NN-descent builds a graph, a greedy search walks it.

Equal vectors are one node. Every node starts with neighbours from three random orders: rows sorted
by the signs of random projections are compared within slices, and one ring through all nodes keeps the
graph in one piece. Then, round after round, each node sends its vector, as one byte a number, to its
neighbours and to some of those that have it as theirs; each compares what it got, where at least
one of the two is new to it, and offers both sides better neighbours than their worst. A node keeps its
best ``NEIGHBOURS``; the rounds end when few of them are new.

A search starts from its own node's neighbours and keeps the ``BEAM`` nearest nodes met. In each
round the ``EXPANDED`` nearest not yet left are left towards their neighbours, which are compared by
the original vectors in double precision, until none is left. Only numbers of nodes and queries
move with the search; the vectors of a block of queries, ``QUERY_BYTES`` at most, go to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.grouping import top_per
from ..functions.ordering import row_index
from ..session import release, scratch, stage_table

NEIGHBOURS = 24  # of each node
REVERSE = 24  # of the nodes that have it as a neighbour, in a round and in the search
OFFERED = 8  # by one node to another in a round
ORDERS, SLICE = 3, 512
PROJECTIONS = 32
CHANGED = 0.1  # the share of new neighbours at which rounds end
BEAM, EXPANDED = 300, 75
QUERY_BYTES = 16 << 20
GROUPS_AT_ONCE = 256
SEED = 42


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.empty((0, 0), kind)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square is too large or small; directions stay exactly the same."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0, keepdims=True))[1]) if rows.size else rows


def _codes(column: pa.Array) -> np.ndarray:
    """Vectors of length one from codes of a byte a number."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


@dataclass(frozen=True)
class Graph:
    """Tables in the shared folder. ``nodes``: node, vec. ``members``: node, _key, of each node's keys the
    smallest ones. ``links``: node, near (array of nodes)."""

    nodes: DataFrame
    members: DataFrame
    links: DataFrame

    def release(self) -> None:
        release(self.nodes, self.members, self.links)


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(_key, vec): one vector for each key, NULL keys and vectors that can have no cosine left out.

    Those are NULL or zero vectors, vectors with a component that is NULL or not finite, and vectors of
    another length than the most frequent one (of equally frequent ones, the longest). Of a key's several
    vectors the smallest one is taken.
    """
    cast = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than any number
    right = cast.filter(F.col("_key").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))
    width = right.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    right = right.filter(F.size("vec") == (width["width"] if width else 0))
    return right.groupBy("_key").agg(F.min("vec").alias("vec"))


def _coded(nodes: DataFrame) -> DataFrame:
    """(node, code, order0, …): each vector in a byte a number, and its places in the random orders."""

    def coded(batches):
        for batch in batches:
            rows = _scaled(_matrix(batch.column("vec")))
            if not len(rows):
                continue
            # The largest component of a row is 127.
            codes = np.rint(rows / np.abs(rows).max(axis=1, keepdims=True) * 127).astype(np.int8)
            directions = np.random.default_rng(SEED).standard_normal((rows.shape[1], ORDERS * PROJECTIONS))
            signs = (rows @ directions > 0).reshape(len(rows), ORDERS, PROJECTIONS)
            orders = (signs << np.arange(PROJECTIONS)[::-1]).sum(axis=2)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in codes]), *(pa.array(orders[:, i]) for i in range(ORDERS))], names)

    names = ["node", "code", *(f"order{i}" for i in range(ORDERS))]
    return nodes.mapInArrow(coded, "node long, code binary, " + ", ".join(f"{n} long" for n in names[2:]))


def _sliced(coded: DataFrame, order: str, neighbours: int) -> DataFrame:
    """(node, id, score): for each node its best in a slice of neighbours in an order."""

    def compared(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                n, most = rows.num_rows, min(neighbours, rows.num_rows - 1)
                if most < 1:
                    continue
                codes, node = _codes(rows.column("code")), rows.column("node").to_numpy()
                near = codes @ codes.T
                np.fill_diagonal(near, -9)
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                score = np.take_along_axis(near, best, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, most)), pa.array(node[best].ravel()), pa.array(score.ravel())], ["node", "id", "score"])

    dealt = coded.select("node", "code", order).repartitionByRange(order, "node").sortWithinPartitions(order, "node")
    return dealt.select("node", "code").mapInArrow(compared, "node long, id long, score float")


def _ring(nodes: DataFrame) -> DataFrame:
    """(node, id, score): every node's next one in a random order."""
    with scratch(nodes.sparkSession) as table:
        placed = table(row_index(nodes.select("node"), [F.xxhash64("node", F.lit(SEED)), "node"], "place", unique=True))
        n = placed.count()
        after = placed.select(F.col("node").alias("id"), F.pmod(F.col("place") - 1, F.lit(max(1, n))).alias("place"))
        # A score below any true one: whoever compares the two finds it.
        return stage_table(placed.join(after, "place").filter("node <> id").select("node", "id", F.lit(-2.0).cast("float").alias("score")))


def _best(offers: DataFrame, neighbours: int) -> DataFrame:
    """(node, id, score, fresh): each node's best distinct neighbours. One exchange, by node."""
    distinct = offers.repartition("node").groupBy("node", "id").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return top_per(distinct, ["node"], [F.desc("score"), F.asc("id")], neighbours).drop("rank")


def _offers(coded: DataFrame, edges: DataFrame, neighbours: int, reverse: int, offered: int) -> DataFrame:
    """(node, id, score): what a round finds; see above."""

    def group_offers(at, who, fresh, least, codes):
        """For whole groups of equal ``at``, sorted by it."""
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sizes = np.diff(np.append(begin, len(at)))
        place = begin[:, None] + np.arange(sizes.max())
        held = np.arange(sizes.max()) < sizes[:, None]
        place = np.where(held, place, 0)
        node, new = who[place], fresh[place]
        some = codes[place]
        near = some @ some.transpose(0, 2, 1)
        fit = held[:, :, None] & held[:, None, :] & (new[:, :, None] | new[:, None, :]) & (node[:, :, None] != node[:, None, :])
        near[~(fit & (near > least[place][:, :, None]))] = -9
        most = min(offered, near.shape[2])
        best = np.argpartition(-near, most - 1, axis=2)[:, :, :most]
        score = np.take_along_axis(near, best, axis=2)
        to = np.broadcast_to(node[:, :, None], score.shape)
        found = np.take_along_axis(np.broadcast_to(node[:, None, :], near.shape), best, axis=2)
        kept = score > -9
        return pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (to, found, score)], ["node", "id", "score"])

    def compared(batches):
        rest = None
        for batch in batches:
            parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "who", "fresh", "least")] + [_codes(batch.column("code"))] if batch.num_rows else None
            if parts is None:
                continue
            if rest is not None:
                parts = [np.concatenate(p) for p in zip(rest, parts)]
            begin = np.flatnonzero(np.append(True, parts[0][1:] != parts[0][:-1]))
            for first in range(0, len(begin) - 1, GROUPS_AT_ONCE):  # the last group may go on
                a, b = begin[first], begin[min(first + GROUPS_AT_ONCE, len(begin) - 1)]
                yield group_offers(*(p[a:b] for p in parts))
            rest = [p[begin[-1] :] for p in parts]
        if rest is not None:
            yield group_offers(*rest)

    backwards = edges.select(F.col("id").alias("at"), F.col("node").alias("who"), "fresh")
    some = top_per(backwards, ["at"], [F.desc("fresh"), F.xxhash64("at", "who")], reverse).drop("rank")
    known = edges.select(F.col("node").alias("at"), F.col("id").alias("who"), "fresh").unionByName(some)
    least = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= neighbours, F.min("score")).otherwise(F.lit(-3.0)).cast("float").alias("least"))
    sent = known.join(coded.select("node", "code").join(least, "node"), F.col("who") == F.col("node"))
    dealt = sent.select("at", "who", "fresh", "least", "code").repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(compared, "node long, id long, score float")


def build(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 5, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, offered: int = OFFERED, changed: float = CHANGED) -> Graph:
    """The graph of all vectors, for searches of the ``k`` nearest; see ``usable`` for the rows that take part."""
    given = stage_table(usable(vectors, vector, key))
    # Of many equal vectors only the first k + 1 keys of a task move.
    ranked = top_per(given, ["vec"], [F.asc("_key")], k + 1)
    named = stage_table(ranked.select(F.min("_key").over(Window.partitionBy("vec")).alias("node"), "_key", "rank", F.when(F.col("rank") == 1, F.col("vec")).alias("vec")))
    members, nodes = stage_table(named.select("node", "_key")), stage_table(named.filter("rank = 1").select("node", "vec"))
    release(given, named)
    with scratch(vectors.sparkSession) as table:
        coded, ring = table(_coded(nodes)), _ring(nodes)
        first = ring
        for i in range(ORDERS):
            first = first.unionByName(_sliced(coded, f"order{i}", neighbours))
        edges = stage_table(_best(first.withColumn("fresh", F.lit(True)), neighbours))
        release(ring)
        total = nodes.count()
        while edges.filter("fresh").count() > changed * total * min(neighbours, total - 1):
            found = _offers(coded, edges, neighbours, reverse, offered)
            every = edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
            after = stage_table(_best(every, neighbours))
            release(edges)
            edges = after
        both = top_per(edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "score"), ["node"], [F.desc("score"), F.asc("id")], reverse)
        # A node has at most neighbours + reverse links.
        linked = edges.select("node", "id").unionByName(both.select("node", "id")).groupBy("node").agg(F.collect_set("id").alias("near"))
        links = stage_table(linked)
        release(edges)
    return Graph(nodes, members, links)


def _walk(graph: Graph, block: DataFrame, beam: int, expanded: int) -> DataFrame:
    """(query, node, score): for each node in ``block`` the nearest nodes met, itself among them; a staged table."""
    rows = block.select("node", "vec").orderBy("node").toArrow()  # QUERY_BYTES at most
    names, wanted = rows.column("node").to_numpy(), _scaled(_matrix(rows.column("vec").combine_chunks()))
    lengths = np.sqrt((wanted * wanted).sum(axis=1))
    least = np.full(len(names), -np.inf)

    def scored(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.searchsorted(names, batch.column("query").to_numpy())
            out = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, 2048):
                there = _scaled(_matrix(batch.column("vec").slice(at, 2048)))
                asked = which[at : at + 2048]
                out[at : at + 2048] = (there * wanted[asked]).sum(axis=1) / (np.sqrt((there * there).sum(axis=1)) * lengths[asked])
            made = pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(out)], ["query", "node", "score"])
            yield made.filter(pa.array(out > least[which]))

    def compare(met: DataFrame) -> DataFrame:
        return met.join(graph.nodes, "node").select("query", "node", "vec").mapInArrow(scored, "query long, node long, score double")

    def near(of: DataFrame) -> DataFrame:
        return of.join(graph.links, "node").select("query", F.explode("near").alias("node")).distinct()

    order = [F.desc("score"), F.asc("node")]
    asked = block.select(F.col("node").alias("query"), "node")
    start = compare(near(asked).unionByName(asked).distinct())
    pool = stage_table(top_per(start.withColumn("left", F.col("node") == F.col("query")), ["query"], order, beam).drop("rank"))
    while True:
        turn = F.row_number().over(Window.partitionBy("query").orderBy("left", *order))
        marked = stage_table(pool.withColumn("next", ~F.col("left") & (turn <= expanded)))
        release(pool)
        going = marked.filter("next").select("query", "node")
        if going.isEmpty():
            return marked.select("query", "node", "score")
        for r in marked.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= beam).collect():
            least[np.searchsorted(names, r["query"])] = r["worst"]
        met = compare(near(going)).withColumn("left", F.lit(False))
        every = marked.select("query", "node", "score", (F.col("left") | F.col("next")).alias("left")).unionByName(met)
        distinct = every.repartition("query").groupBy("query", "node").agg(F.max("score").alias("score"), F.max("left").alias("left"))
        pool = stage_table(top_per(distinct, ["query"], order, beam).drop("rank"))
        release(marked)


def search(graph: Graph, queries: DataFrame, k: int = 5, beam: int = BEAM, expanded: int = EXPANDED, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, _key, score) of the k nearest other keys for each of ``queries`` (_key, vec), which are among the graph's.

    Of equal scores the smaller key comes first; fewer than k come back where the graph has no more.
    """
    asked = queries.join(graph.nodes, "vec").select(F.col("_key").alias("query"), "node")
    with scratch(queries.sparkSession) as table:
        asked = table(asked)
        starts = table(asked.select("node").distinct().join(graph.nodes, "node"))
        n, width = starts.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        blocks = max(1, -(-n * 8 * (width or 1) // query_bytes))
        found = None
        for block in range(blocks):
            part = _walk(graph, starts.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)) == block) if blocks > 1 else starts, beam, expanded)
            found = part if found is None else found.unionByName(part)
        # One class more than asked for, since a query's own may hold nothing but itself.
        classes = top_per(found.withColumnRenamed("query", "of"), ["of"], [F.desc("score"), F.asc("node")], k + 1).drop("rank")
        keyed = asked.withColumnRenamed("node", "of").join(classes, "of").join(graph.members, "node").filter(F.col("query") != F.col("_key"))
        return stage_table(top_per(keyed.select("query", "_key", "score"), ["query"], [F.desc("score"), F.asc("_key")], k).select("query", "rank", "_key", "score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", **options) -> DataFrame:
    """(query, rank, _key, score): for every key of a row that fulfils ``is_query`` its k nearest other keys.

    The score is the cosine in double precision. Rows that ``usable`` leaves out are neither queries nor
    found. Repeated rows of a key are one; an empty table gives no rows. Other columns are not looked at.
    """
    graph = build(vectors, vector, key, k, **options)
    wanted = vectors.filter(is_query).select(F.col(key).cast("long").alias("_key")).distinct()
    found = search(graph, usable(vectors, vector, key).join(wanted, "_key"), k)
    graph.release()
    return found
