"""Near-duplicate embeddings by NN-descent (operator 5).

Equal vectors are one node.  A first neighbour graph comes from blocks of nodes that lie next to each other in
the order of random hyperplane codes.  Each round then joins the neighbours of every node with each other and
keeps, for each node, the best of all it has met.  Nodes compared together are also tied by all their links of at
least the limit, listed or not (a star for each group, so ties grow with the nodes only); ties make components.

A list full of links is saturated: other links of its node may be hidden behind them.  Lists are then enlarged to the
whole component, compared in blocks, and the graph is refined again with lists of the best nodes outside the own
component, until no list outside holds a link.  An audit compares a hashed sample of nodes, of components of
all sizes, with all others; rounds go on until its recall is met, and an error tells if it is not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.llm.graph import components
from sharetide.llm.seeds import first_words
from sharetide.session import stage

LIST = 10  # neighbours kept for a node while the graph is refined
TABLES, BITS, BLOCK = 10, 30, 512  # orders of the first graph, hyperplanes of a code, nodes of a block
TOLD = 4  # neighbours told to a node by one local join
LARGE = 2048  # nodes of a component compared in one task
AUDITED, RECALL, ROUNDS = 200, 0.97, 4  # nodes of the audit for a size of component, recall asked for, and rounds at most


def usable(e: Column) -> Column:
    """Whether a vector has a direction: present, finite in all components, not zero."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, a: int, b: int) -> np.ndarray:
    return unit(column.slice(a, b - a).flatten().to_numpy(), b - a)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of one value of ``column`` at a time; they come in order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(column).to_numpy()
        cut = [*first_words(key).tolist(), len(key)]
        for x, y in zip(cut, cut[1:]):
            if held and held[0].column(column)[0].as_py() != key[x]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tied(linked: np.ndarray) -> np.ndarray:
    """For each row, the first row that it is joined to by links."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None], len(label)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _best(ids: np.ndarray, root: np.ndarray, x: np.ndarray, keep: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` nearest others of each row outside its component, and ties of all rows that links join."""
    s = x @ x.T
    s[root[:, None] == root[None]] = -2
    keep = min(keep, len(ids) - 1)
    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    c, nbr, near = np.repeat(ids, keep), ids[top.ravel()], np.take_along_axis(s, top, 1).ravel()
    other = near > -2
    linked = s >= limit
    hub = _tied(linked) if linked.any() else np.arange(len(ids))
    tied = np.flatnonzero(hub != np.arange(len(ids)))
    return (
        np.concatenate((c[other], ids[tied])), np.concatenate((nbr[other], ids[hub[tied]])),
        np.concatenate((near[other], np.ones(len(tied)))), np.repeat([False, True], [int(other.sum()), len(tied)]),
    )


_EDGE = "c bigint, nbr bigint, s double, tie boolean"


def _edges(c: np.ndarray, nbr: np.ndarray, s: np.ndarray, tie: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c), pa.array(nbr), pa.array(s), pa.array(tie)], ["c", "nbr", "s", "tie"])


def first_graph(nodes: DataFrame, seed: int, limit: float) -> DataFrame:
    """Neighbours met in blocks along the orders of random hyperplane codes; blocks have a fixed size."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim_rows in _by_dimension(b):
                c, root, e, dim = dim_rows.column("c"), dim_rows.column("root"), dim_rows.column("e"), dim_rows.column("dim")[0].as_py()
                x = _matrix(e, 0, len(c))
                for t in range(TABLES):
                    planes = np.random.default_rng([seed, t, dim]).normal(size=(dim, BITS))
                    bits = ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = len(c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t * 100_000 + dim, np.int64)), pa.array(bits), c, root, e], ["part", "code", "c", "root", "e"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_numpy()
            cut = [*first_words(part).tolist(), len(part)]
            for x, y in zip(cut, cut[1:]):
                for a in range(x, y, BLOCK // 2):  # blocks overlap by half
                    z = min(a + BLOCK, y)
                    if z - a > 1:
                        yield _edges(*_best(b.column("c").to_numpy()[a:z], b.column("root").to_numpy()[a:z], _matrix(b.column("e"), a, z), LIST, limit))

    kind = nodes.schema["e"].dataType.simpleString()
    coded = nodes.select("c", "root", "e", F.size("e").alias("dim")).mapInArrow(code, f"part bigint, code bigint, c bigint, root bigint, e {kind}")
    return best_of(coded.repartitionByRange("part", "code").sortWithinPartitions("part", "code", "c").mapInArrow(blocks, _EDGE))


def _by_dimension(b: pa.RecordBatch) -> list[pa.RecordBatch]:
    dim = b.column("dim").to_numpy()
    return [b.filter(pa.array(dim == d)) for d in np.unique(dim)]


def best_of(edges: DataFrame, keep: int = LIST) -> DataFrame:
    """For each node its ``keep`` best edges, and all its ties."""
    best = F.slice(F.sort_array(F.collect_set(F.when(~F.col("tie"), F.struct("s", "nbr"))), asc=False), 1, keep)
    ties = F.collect_set(F.when(F.col("tie"), F.struct(F.lit(1.0).alias("s"), "nbr")))
    met = edges.groupBy("c").agg(best.alias("best"), ties.alias("ties"))
    of = lambda name, tie: F.transform(name, lambda x: F.struct(x["nbr"].alias("nbr"), x["s"].alias("s"), F.lit(tie).alias("tie")))
    return met.select("c", F.explode(F.concat(of("best", False), of("ties", True))).alias("b")).select("c", "b.*")


def descend(graph: DataFrame, nodes: DataFrame, limit: float, inside: DataFrame | None = None) -> DataFrame:
    """One round: every node's neighbours, either way, are compared with each other.

    ``inside`` has lists of neighbours in the own component, by which the lists of a component's nodes spread.
    """
    order = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"))

    def either_way(lists: DataFrame) -> DataFrame:
        lists = lists.where("NOT tie")
        back = lists.select(F.col("nbr").alias("u"), F.col("c").alias("v")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= LIST).drop("n")
        return lists.select(F.col("c").alias("u"), F.col("nbr").alias("v")).union(back)

    around = either_way(graph).union(nodes.select(F.col("c").alias("u"), F.col("c").alias("v")))
    around = (around if inside is None else around.union(either_way(inside))).distinct()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for t in _groups(batches, "u"):
            if t.num_rows > 1:
                e = t["e"].combine_chunks() if isinstance(t["e"], pa.ChunkedArray) else t["e"]
                out.append(_best(t["c"].to_numpy(), t["root"].to_numpy(), _matrix(e, 0, t.num_rows), TOLD, limit))
                size += len(out[-1][0])
            if size > 20_000:
                yield _edges(*(np.concatenate(x) for x in zip(*out)))
                out, size = [], 0
        if out:
            yield _edges(*(np.concatenate(x) for x in zip(*out)))

    joined = around.join(nodes.select(F.col("c").alias("v"), "root", "e"), "v").select("u", F.col("v").alias("c"), "root", "e")
    met = joined.repartition("u").sortWithinPartitions("u").mapInArrow(meet, _EDGE)
    return best_of(graph.unionByName(met))


def _ties(graph: DataFrame, limit: float, before: DataFrame | None = None) -> DataFrame:
    """Pairs known to be of one component."""
    ties = graph.where(F.col("tie") | (F.col("s") >= limit)).select(F.col("c").alias("a"), F.col("nbr").alias("b"))
    return ties if before is None else before.unionByName(ties)


def _components(ties: DataFrame) -> DataFrame:
    return components(ties).select(F.col("v").alias("c"), "root")


def join_outside(nodes: DataFrame, graph: DataFrame, roots: DataFrame, ties: DataFrame, limit: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Components and ties after the search for links that saturated lists hide; each pass joins components or is the last."""
    full = graph.where("NOT tie").groupBy("c").agg(F.count("*").alias("n"), F.min("s").alias("s")).where((F.col("n") >= LIST) & (F.col("s") >= limit))
    if full.isEmpty():
        return roots, ties
    inside = graph
    while True:
        placed = stage(nodes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "placed")
        outside = stage(first_graph(placed, seed, limit), "outside")
        for _ in range(2):
            outside = stage(descend(outside, placed, limit, inside), "outside")
        if outside.where(F.col("tie") | (F.col("s") >= limit)).isEmpty():
            return roots, ties
        ties = _ties(outside, limit, ties)
        roots = stage(_components(ties), "components")


def enlarge(nodes: DataFrame, member: DataFrame, limit: float) -> DataFrame:
    """``c``, ``n_near``: vectors (copies counted) of other nodes linked to c, among all of its component."""
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / LARGE).alias("blocks"))
    placed = nodes.join(member, "c").join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    left = placed.select("root", "c", "e", "m", F.col("block").alias("i"), every, F.lit(True).alias("is_left")).withColumnRenamed("o", "j")
    right = placed.select("root", "c", "e", "m", F.col("block").alias("j"), every, F.lit(False).alias("is_left")).withColumnRenamed("o", "i")
    tasks = left.unionByName(right).select(F.xxhash64("root", "i", "j").alias("task"), "c", "e", "m", "is_left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "task"):
            side = t["is_left"].to_numpy()
            e = t["e"].combine_chunks() if isinstance(t["e"], pa.ChunkedArray) else t["e"]
            x, c, m = _matrix(e, 0, t.num_rows), t["c"].to_numpy(), t["m"].to_numpy()
            near = np.empty(int(side.sum()), np.int64)
            for a in range(0, len(near), 256):
                s = x[side][a : a + 256] @ x[~side].T >= limit
                s[c[side][a : a + 256, None] == c[~side][None]] = False
                near[a : a + 256] = s @ m[~side]
            yield pa.RecordBatch.from_arrays([pa.array(c[side]), pa.array(near)], ["c", "n_near"])

    return tasks.repartition("task").sortWithinPartitions("task", "c").mapInArrow(compare, "c bigint, n_near bigint").groupBy("c").agg(F.sum("n_near").alias("n_near"))


def audit(nodes: DataFrame, roots: DataFrame, found: DataFrame, limit: float, sample: int = AUDITED) -> float:
    """Share of linked nodes whose links were all found, by brute force of sampled nodes against all nodes.

    About ``sample`` nodes are taken of the components of each size (by powers of two) and count for all of these.
    Nodes with about as many true links form a class; the share of the worst class is returned, so that no
    large group covers what small ones lack.
    """
    member = nodes.select("c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    sizes = member.groupBy("root").agg(F.floor(F.log2(F.count("*"))).alias("stratum"))
    strata = stage(member.join(sizes, "root").select("c", "stratum"), "strata")
    of = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    if not of:
        return 1.0
    share = F.create_map(*[F.lit(x) for k, n in of.items() for x in (k, sample / n)])[F.col("stratum")]
    drawn = strata.where(F.pmod(F.xxhash64("c", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))
    chosen = nodes.join(drawn, "c").select("c", "e", F.size("e").alias("dim"), "stratum").collect()
    taken = Counter(r["stratum"] for r in chosen)
    weight = {r["c"]: of[r["stratum"]] / taken[r["stratum"]] for r in chosen}
    wanted = []  # a few hundred vectors of one length at a time
    for d in sorted({r["dim"] for r in chosen}):
        same = [r for r in chosen if r["dim"] == d]
        for part in (same[a : a + 256] for a in range(0, len(same), 256)):
            wanted.append((d, np.array([r["c"] for r in part]), unit(np.concatenate([r["e"] for r in part]), len(part))))
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _by_dimension(b):
                d, x, c, m = rows.column("dim")[0].as_py(), _matrix(rows.column("e"), 0, rows.num_rows), rows.column("c").to_numpy(), rows.column("m").to_numpy()
                for _, ids, y in (w for w in shared.value if w[0] == d):
                    s = y @ x.T >= limit
                    s[ids[:, None] == c[None]] = False
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s @ m)], ["c", "truth"])

    truth = nodes.select("c", "e", "m", F.size("e").alias("dim")).mapInArrow(count, "c bigint, truth bigint").groupBy("c").agg(F.sum("truth").alias("truth"))
    linked, whole = Counter(), Counter()
    for r in truth.where("truth > 0").join(found, "c", "left").select("c", "truth", F.coalesce("n_near", F.lit(0)).alias("n")).collect():
        kind = int(r["truth"]).bit_length()
        linked[kind] += weight[r["c"]]
        whole[kind] += weight[r["c"]] * (r["n"] >= r["truth"])
    return min((whole[k] / n for k, n in linked.items()), default=1.0)


def near_duplicates(vectors: DataFrame, limit: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` (least key), ``kept`` for every row; other columns are left behind.

    Rows whose vector is null, zero, empty, or has a null or non-finite component link with nothing and are kept.
    Vectors of different lengths don't link.  An error is raised if the audit is not met.  Repeated rows are linked copies; the least key of a component is
    kept (all rows of it, if keys repeat).  An empty table gives an empty table.
    """
    rows = vectors.select(F.col(key), F.col(column).alias("e"), usable(F.col(column)).alias("ok")).withColumn("c", F.when(F.col("ok"), F.xxhash64(F.transform("e", lambda x: x.cast("double")))))
    nodes = stage(rows.where("ok").groupBy("c").agg(F.first("e").alias("e"), F.count("*").alias("m")), "nodes")
    graph = ties = None
    for turn in range(ROUNDS):
        apart = nodes.withColumn("root", F.col("c"))
        fresh = first_graph(apart, turn + 1, limit)
        graph = stage(fresh if graph is None else best_of(graph.unionByName(fresh)), "graph")
        for _ in range(2):
            graph = stage(descend(graph, apart, limit), "graph")
        ties = _ties(graph, limit, ties)
        roots = stage(_components(ties), "components")
        roots, ties = join_outside(nodes, graph, roots, ties, limit, turn + 1)
        found = stage(enlarge(nodes, roots, limit), "links")
        recall = audit(nodes, roots, found, limit)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"near_duplicates: after {ROUNDS} rounds all links were found for {recall:.3f} of the linked nodes, not for {RECALL}")
    told = nodes.select("c", "m").join(found, "c", "left").join(roots, "c", "left").select("c", (F.coalesce("n_near", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "c").alias("root"))
    all_rows = rows.select(key, "c").join(told, "c", "left")
    least = all_rows.where("root is not null").groupBy("root").agg(F.min(key).alias("least"))
    out = all_rows.join(least, "root", "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


@op_query("op5_nn_descent")
def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
