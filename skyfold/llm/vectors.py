"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label are put into their three nearest cluster shards (centroids from a bounded sample); shards that are
overfull all the same are divided again, by pivots drawn from each of them. In each shard
every vector's neighbours are pruned robustly to at most 32; the lists of a vector from its shards are united, and edges lead both ways. A search
then runs for every vector in each of its shards: greedily from the shard's medoid with a beam, and from there on over
everything in range. A vector with more vectors in range than it may have neighbours is crowded: its edges can all lead
into its own dense group, so no search is sure to leave it, and it is compared with its whole shard instead. Links found are verified by cosine in double precision. Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Vectors a shard has on average before overlap; shards a vector is in; neighbours a node keeps; candidates they come from.
SHARD, OVERLAP, DEGREE, POOL = 400, 3, 32, 96
ALPHA, BEAM = 1.2, 24
#: Rows that centroids are fitted on, of all labels together (those with the smallest hash of vec_id).
SAMPLE = 20_000
#: Rows of a label in the sample for each of its centroids.
PER_CENTRE = 8
#: A shard with more vectors is divided by its nearest pivots.
OVERFULL, PIVOTS, LEVELS = 16_384, 16, 12
#: Queries that one step of a search holds at once.
QUERIES = 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square is infinite or lost."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1)[:, None]
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over unit rows; the first centroids are evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1))
        c[size > 0] = total[size > 0] / size[size > 0][:, None]
    return c


def prune(u: np.ndarray, least: float, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> tuple[list[np.ndarray], np.ndarray]:
    """Robustly pruned out-neighbours of every unit row, from its nearest rows, and which rows are crowded (more than degree in range); a block of rows at a time."""
    n = len(u)
    k = min(pool, n - 1)
    crowded = np.zeros(n, bool)
    if k < 1:
        return [np.zeros(0, np.int64)] * n, crowded
    lists: list[np.ndarray] = []
    for b in range(0, n, QUERIES):
        mine = np.arange(b, min(n, b + QUERIES))
        own = u[mine] @ u.T
        own[mine - b, mine] = -2
        crowded[mine] = (own >= least).sum(1) > degree
        near = np.argpartition(-own, k - 1, 1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(own, near, 1), 1, kind="stable"), 1)
        far = 1 - np.take_along_axis(own, near, 1)
        between = 1 - u[near] @ u[near].transpose(0, 2, 1)
        alive, rows = np.ones((len(mine), k), bool), np.arange(len(mine))
        out = np.full((len(mine), degree), -1)
        for r in range(min(degree, k)):
            pick = np.argmax(alive, 1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, r] = near[rows, pick][some]
            alive[rows, pick] = False
            alive &= ~(some[:, None] & (alpha * between[rows, pick] <= far))
        lists += [x[x >= 0] for x in out]
    return lists, crowded


def search(vectors: np.ndarray, near: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Mask (queries, nodes) of those in range that a beam search from entry, and then a search over all in range, meet.

    The queries are nodes of the graph; each also starts from its own place in it.

    The neighbours of node i are near[edges[i]:edges[i + 1]].
    """
    q, n = len(queries), len(vectors)
    target = vectors[queries]
    seen = np.zeros((q, n), bool)
    done = np.zeros((q, n), bool)
    sims = np.full((q, n), -2.0, np.float32)
    seen[:, entry] = True
    sims[:, entry] = target @ vectors[entry]
    rows = np.arange(q)
    top = np.full((q, beam), entry)
    top_sims = np.full((q, beam), -2.0, np.float32)
    top_sims[:, 0] = sims[:, entry]
    seen[rows, queries] = True
    sims[rows, queries] = np.einsum("ij,ij->i", target, target)
    other = np.flatnonzero(queries != entry)
    top[other, 1], top_sims[other, 1] = queries[other], sims[other, queries[other]]

    def meet(of: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        degrees = edges[nodes + 1] - edges[nodes]
        who = np.repeat(of, degrees)
        new = near[np.arange(len(who)) + np.repeat(edges[nodes] - np.cumsum(degrees) + degrees, degrees)]
        fresh = ~seen[who, new]
        flat = np.unique(who[fresh] * n + new[fresh])
        who, new = flat // n, flat % n
        seen[who, new] = True
        sims[who, new] = np.einsum("ij,ij->i", target[who], vectors[new])
        return who, new

    while True:
        open_ = np.where(done[rows[:, None], top] | (top_sims < -1.5), -3.0, top_sims)
        pick = np.argmax(open_, 1)
        active = np.flatnonzero(open_[rows, pick] > -2.5)
        if not len(active):
            break
        nodes = top[active, pick[active]]
        done[active, nodes] = True
        who, new = meet(active, nodes)
        if len(who):
            first = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1])
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            wide = int(rank.max()) + 1
            more, more_sims = np.zeros((q, wide), np.int64), np.full((q, wide), -2.0, np.float32)
            more[who, rank], more_sims[who, rank] = new, sims[who, new]
            all_, all_sims = np.concatenate([top, more], 1), np.concatenate([top_sims, more_sims], 1)
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            top, top_sims = np.take_along_axis(all_, best, 1), np.take_along_axis(all_sims, best, 1)
    while True:
        who, nodes = np.nonzero((sims >= least) & ~done)
        if not len(who):
            break
        done[who, nodes] = True
        for k in range(0, len(who), 4096):
            meet(who[k : k + 4096], nodes[k : k + 4096])
    return sims >= least


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _deal(centres: dict):
    """Rows of a class, once for each of its shards; a label without centroids is one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 1))
            for key in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
                mine = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                part, c = batch.take(pa.array(mine)), centres.get(key)
                k, near = 1, np.zeros((len(mine), 1), np.int64)
                if c is not None:
                    k = min(OVERLAP, len(c))
                    near = np.argpartition(-(unit(_matrix(part.column(3))) @ c.T), k - 1, 1)[:, :k]
                dealt = part.take(pa.array(np.repeat(np.arange(len(mine)), k)))
                yield pa.RecordBatch.from_arrays([*dealt.columns, pa.array(near.ravel().astype(np.int64))], names=["node", "label", "dim", "embedding", "weight", "shard"])

    return run


_SHARD = ["label", "dim", "shard"]


def _divided(dealt: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """dealt with overfull shards divided, level by level: a vector goes to those of its OVERLAP nearest pivots of PIVOTS; and what stays overfull.

    Pivots are the shard's vectors of smallest hashes, found by a partial aggregation. A shard is not divided where a pivot
    has 2 * OVERLAP pivots or more in range, itself included: there a dense group would be cut, as two of its members
    might have no pivot in common. Such shards, and what LEVELS leave, come as (label, dim, shard, n), and None where
    there are none: dense_links() compares all of theirs.
    """
    scaled = lambda e: F.transform(e, lambda x: x.cast("double") / F.array_max(F.transform(e, lambda y: F.abs(y.cast("double")))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    for level in range(LEVELS + 1):
        big = common.cut(dealt.groupBy(*_SHARD).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERFULL))
        if not big.limit(1).count():
            common.drop(big)
            return dealt, None
        if level == LEVELS:
            break
        drawn = dealt.join(big.drop("n"), _SHARD).groupBy(*_SHARD).agg(F.array(*[F.min_by("embedding", F.xxhash64("node", F.lit(PIVOTS * level + j))) for j in range(PIVOTS)]).alias("pivots"))
        drawn = drawn.withColumn("pivots", F.transform(F.array_distinct("pivots"), lambda p: F.transform(scaled(p), lambda x: x / F.sqrt(dot(scaled(p), scaled(p))))))
        in_range = F.array_max(F.transform("pivots", lambda p: F.size(F.filter("pivots", lambda q: dot(p, q) >= least))))
        pivots = common.cut(drawn.where(in_range < 2 * OVERLAP))
        if not pivots.limit(1).count():
            common.drop(pivots)
            break
        near = F.array_sort(F.transform("pivots", lambda p, i: F.struct((-dot(p, F.col("own"))).alias("d"), i.alias("i"))))
        named = F.transform(F.slice(near, 1, OVERLAP), lambda s: F.xxhash64("shard", F.lit(level), s["i"]))
        new = dealt.join(pivots, _SHARD).withColumn("own", scaled(F.col("embedding"))).withColumn("shard", F.explode(named)).select(*dealt.columns)
        after = common.cut(dealt.join(pivots, _SHARD, "left_anti").select(*dealt.columns).unionByName(new.dropDuplicates(["node", *_SHARD])))
        common.drop(dealt, big, pivots)
        dealt = after
    return dealt, big


def _build(least: float):
    def run(key, table):
        """Pruned neighbours of one shard's nodes, and whether they are crowded there."""
        nodes = table["node"].to_numpy()
        u = unit(_matrix(table["embedding"])).astype(np.float32)
        lists, crowded = prune(u, least - 1e-4)
        return pa.table({"node": nodes, "shard": table["shard"], "near": pa.array([nodes[x] for x in lists], pa.list_(pa.int64())), "crowded": crowded})

    return run


class Forest:
    """Spanning trees of links that come in batches, as arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[np.ndarray] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Each round, every tree that a link joins to one of a smaller label is joined by one link; the others wait for the next round."""
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            roots, first = np.unique(np.maximum(a, b), return_index=True)
            self.kept.append(np.stack([x[first], y[first]]))
            to = np.arange(len(self.label))
            to[roots] = np.minimum(a, b)[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]

    def edges(self) -> np.ndarray:
        return np.concatenate([np.zeros((2, 0), np.int64), *self.kept], 1)


#: Vectors of a block where all of an overfull shard are compared.
BLOCK = 4096


def _dense_links(least: float):
    def run(key, table):
        """Of two blocks of a dense shard (or of one with itself): the forest of links, and links' weights of both ends, as _links() gives them.

        Sums in single precision decide what is 1e-4 away from the bound; the others are summed up in double precision.
        All nodes here are crowded, so the first common shard of two of them counts their link.
        """
        side = table["side"].to_numpy()
        nodes, weight, own = table["node"].to_numpy(), table["weight"].to_numpy(), key[2].as_py()
        u64 = unit(_matrix(table["embedding"]))
        u = u64.astype(np.float32)
        lists = table["homes"].to_pylist()
        homes = np.array([(x := sorted(h for h in own_list if h < own)) + [np.iinfo(np.int64).max] * (max(map(len, lists)) - len(x)) for own_list in lists])
        elsewhere = (homes < own).any(1)
        same = key[3].as_py() == key[4].as_py()
        left, right = (np.flatnonzero(side == 0),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        forest, count = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        for k in range(0, len(left), QUERIES):
            some = left[k : k + QUERIES]
            dots = u[some] @ u[right].T
            linked = dots >= least + 1e-4
            x, y = np.nonzero((dots >= least - 1e-4) & ~linked)
            for s in range(0, len(x), 65536):
                i, j = x[s : s + 65536], y[s : s + 65536]
                linked[i, j] = np.einsum("ij,ij->i", u64[some[i]], u64[right[j]]) >= least
            if same:
                linked[np.arange(len(some)), np.arange(k, k + len(some))] = False
            x, y = np.nonzero(linked)
            forest.add(some[x], right[y])
            x, y = np.nonzero(linked & elsewhere[some][:, None] & elsewhere[right][None, :])
            for s in range(0, len(x), 65536):
                i, j = x[s : s + 65536], y[s : s + 65536]
                here, there = homes[some[i]][:, :, None], homes[right[j]][:, None, :]
                linked[i, j] = ~((here == there) & (here < own)).any((1, 2))
            count[some] += linked.astype(np.float64).dot(weight[right].astype(np.float64)).astype(np.int64)
            if not same:
                count[right] += linked.T.astype(np.float64).dot(weight[some].astype(np.float64)).astype(np.int64)
        some, (a, b) = np.flatnonzero(count), (nodes[e] for e in forest.edges())
        return pa.table({"a": pa.array(np.concatenate([nodes[some], a])), "b": pa.array([*[None] * len(some), *b.tolist()], pa.int64()), "n": pa.array(np.concatenate([count[some], np.zeros(len(a), np.int64)]))})

    return run


def dense_links(rows: DataFrame, shards: DataFrame, least: float) -> DataFrame:
    """All links within shards (label, dim, shard, n) of any size, exactly: each block of BLOCK vectors meets each other one in a task of its own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.join(shards, _SHARD).withColumns({"_of": blocks, "_b": F.pmod(F.xxhash64("node", F.lit(11)), blocks.cast("long")).cast("int")})
    met = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    met = met.select(*_SHARD, "node", "embedding", "weight", "homes", F.least("_b", "_k").alias("i"), F.greatest("_b", "_k").alias("j"), (F.col("_b") > F.col("_k")).cast("int").alias("side"))
    return met.groupBy(*_SHARD, "i", "j").applyInArrow(_dense_links(least), "a long, b long, n long")


def _links(least: float):
    def run(key, table):
        """Of one shard: a forest of the links (a, b, 0), and the links' weights, of both ends.

        Links with a crowded end are found in every common shard; the first one sums up their weights (a, null, n).
        Of others any common shard may find one: they are rows (a, b, weight of b), at most DEGREE of a node, that tally() counts once.
        """
        nodes, weight, own = table["node"].to_numpy(), table["weight"].to_numpy(), key[2].as_py()
        order = np.argsort(nodes)
        u64 = unit(_matrix(table["embedding"]))[order]
        nodes, weight, crowded = nodes[order], weight[order], table["crowded"].to_numpy()[order]
        lists_ = table["homes"].to_pylist()
        homes = np.array([sorted(x) + [np.iinfo(np.int64).max] * (max(map(len, lists_)) - len(x)) for x in lists_])[order]
        own_homes = homes < own
        n, u = len(nodes), u64.astype(np.float32)
        out = [np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in lists)]) for lists in table["lists"].to_pylist()]
        x, y = np.repeat(np.arange(n), [len(out[i]) for i in order]), np.concatenate([out[i] for i in order])
        at = np.minimum(np.searchsorted(nodes, y), n - 1)
        known = (nodes[at] == y) & (at != x)
        x, at = x[known], at[known]
        pairs = np.unique(np.concatenate([x * n + at, at * n + x]))  # both ways: else a hub would lead nowhere
        near, edges = pairs % n, np.searchsorted(pairs // n, np.arange(n + 1))
        medoid = int(np.argmax(u @ u.sum(0)))
        forest, count, pairs = Forest(n), np.zeros(n, np.int64), []
        for k in range(0, n, QUERIES):
            some = np.arange(k, min(n, k + QUERIES))
            found, full = np.zeros((len(some), n), bool), crowded[some]
            found[full] = u[some[full]] @ u.T >= least - 1e-4
            if not full.all():
                found[~full] = search(u, near, edges, medoid, some[~full], least - 1e-4)
            x, y = np.nonzero(found)
            x = x + k
            keep = x != y
            x, y = x[keep], y[keep]
            good = np.concatenate([np.einsum("ij,ij->i", u64[x[s : s + 65536]], u64[y[s : s + 65536]]) >= least for s in range(0, len(x), 65536)]) if len(x) else np.zeros(0, bool)
            x, y = x[good], y[good]
            forest.add(x, y)
            few = ~crowded[x] & ~crowded[y]
            pairs.append(np.minimum(x, y)[few] * n + np.maximum(x, y)[few])
            x, y = x[crowded[x]], y[crowded[x]]
            for s in range(0, len(x), 65536):
                i, j = x[s : s + 65536], y[s : s + 65536]
                first = ~((homes[i][:, :, None] == homes[j][:, None, :]) & own_homes[i][:, :, None]).any((1, 2))
                i, j = i[first], j[first]
                np.add.at(count, i, weight[j])
                alone = ~crowded[j]
                np.add.at(count, j[alone], weight[i[alone]])
        some = np.flatnonzero(count)
        x, y = np.divmod(np.unique(np.concatenate(pairs)), n)
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        a, b = (nodes[e].tolist() for e in forest.edges())
        return pa.table(
            {
                "a": pa.array([*nodes[some].tolist(), *a, *nodes[x].tolist()], pa.int64()),
                "b": pa.array([*[None] * len(some), *b, *nodes[y].tolist()], pa.int64()),
                "n": pa.array([*count[some].tolist(), *[0] * len(a), *weight[y].tolist()], pa.int64()),
            }
        )

    return run


def tally(found: DataFrame) -> DataFrame:
    """(a, n): the weight of every node's links, a link once however many shards found it."""
    once = found.where("b is not null and n > 0").dropDuplicates(["a", "b"])
    return found.where("b is null").unionByName(once).groupBy("a").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows are compared only where labels are equal and not null (and lengths are). n_links counts the other rows whose
    cosine, in double precision at any magnitude, is at least `least`, as found; equal vectors count each other. A vector that is null, empty, zero or holds
    null or non-finite components has no links, and forms its own component. Rows that repeat a vec_id count as other
    rows of the same vertex. A null vec_id has no component (null) and is not kept. Other columns are ignored; an
    empty table gives no rows. audit() measures the recall.
    """
    common.ship(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())  # held as it is; all else in double precision
    e = F.col("embedding").cast("array<float>" if single else "array<double>")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    hashes = [F.xxhash64("label", "embedding").alias("h"), F.xxhash64("embedding", "label", F.lit(7)).alias("g")]
    rows = rows.withColumn("ok", fine)
    classes = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    classes = common.cut(classes.select("node", "label", F.size("embedding").alias("dim"), "embedding", "weight", *hashes))
    # A vec_id with several vectors joins their classes; a class that it would name has a name of its own.
    both = F.struct(*hashes)
    several = rows.where("ok").groupBy("vec_id").agg(F.min(both).alias("low"), F.max(both).alias("high")).where("low <> high")
    several = common.cut(several.select("vec_id"))
    ties = None
    classes = classes.withColumn("vec_id", F.col("node"))
    if several.limit(1).count():
        named = classes.join(several.withColumn("twice", F.lit(True)), "vec_id", "left")
        classes = common.cut(named.withColumn("node", F.when(F.col("twice"), F.xxhash64("node", "h", "g")).otherwise(F.col("node"))).drop("twice"))
        many = rows.where("ok").join(several, "vec_id").select("vec_id", "label", "embedding").join(classes.select("label", "embedding", "node"), ["label", "embedding"]).select("vec_id", "node").distinct()
        ties = many.join(many.groupBy("vec_id").agg(F.min("node").alias("a")), "vec_id").select("a", F.col("node").alias("b"))
    plain = classes.select("node", "label", "dim", "embedding", "weight")
    total = classes.count()
    drawn = plain.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLE).select("label", "dim", "embedding").toPandas()
    centres = {}
    for key, mine in drawn.groupby(["label", "dim"])["embedding"]:
        k = min(-(-total * len(mine) // (len(drawn) * SHARD)), len(mine) // PER_CENTRE)
        if k > 1:
            centres[tuple(map(int, key))] = centroids(unit(np.stack(mine.to_list())), k)
    kind = "float" if single else "double"
    dealt = common.cut(plain.mapInArrow(_deal(centres), f"node long, label long, dim int, embedding array<{kind}>, weight long, shard long"))
    dealt, dense = _divided(dealt, least)
    sparse = dealt if dense is None else dealt.join(dense, _SHARD, "left_anti")
    lists = sparse.groupBy(*_SHARD).applyInArrow(_build(least), "node long, shard long, near array<long>, crowded boolean")
    if dense is not None:
        lists = lists.unionByName(dealt.join(dense, _SHARD).select("node", "shard", F.array().cast("array<long>").alias("near"), F.lit(True).alias("crowded")))
    lists = lists.groupBy("node").agg(F.collect_list("near").alias("lists"), F.max("crowded").alias("crowded"), F.collect_list("shard").alias("homes"))  # a node is in OVERLAP shards, more only where these were divided
    links = sparse.join(lists, "node").groupBy(*_SHARD).applyInArrow(_links(least), "a long, b long, n long")
    if dense is not None:
        links = links.unionByName(dense_links(dealt.join(lists.select("node", "homes"), "node"), dense, least))
    found = common.cut(links)
    common.drop(dealt, *([] if dense is None else [dense]))
    counts = tally(found)
    edges = found.where("b is not null and n = 0").select("a", "b")
    comps = common.components(edges if ties is None else edges.unionByName(ties))
    low = comps.join(classes.select(F.col("node").alias("id"), "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("low"))
    comps = comps.join(low, "component").select("id", F.col("low").alias("component"))
    known = classes.select("node", "vec_id", "weight", "h", "g").join(counts, F.col("node") == F.col("a"), "left").join(comps, F.col("node") == F.col("id"), "left")
    known = known.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "vec_id").alias("comp"))
    out = rows.select("vec_id", *[F.when(F.col("ok"), h).alias(n) for h, n in zip(hashes, "hg", strict=True)]).join(known, ["h", "g"], "left")
    if ties is not None:  # rows of one vec_id that have no vector to compare
        same = out.where("vec_id is not null and comp is not null").groupBy("vec_id").agg(F.min("comp").alias("of_id"))
        out = out.join(same, "vec_id", "left").withColumn("comp", F.coalesce("of_id", "comp"))
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(False)).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.93, every: int = 20) -> float:
    """Share of links found, over all rows whose vec_id is divisible by `every` as queries against all rows, by brute force in blocks.

    ValueError where these queries have no links: nothing is measured then.
    """
    common.ship(vectors.sparkSession)
    rows = vectors.where("label is not null and embedding is not null and vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    n = 64
    ask = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("asks"))
    have = rows.select("vec_id", "embedding", "label", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("asks"))

    def count(key, table):
        rows_, out = table.to_pylist(), []
        good = [r for r in rows_ if all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
        q, b = [r for r in good if r["asks"]], [r for r in good if not r["asks"]]
        if q and b:
            hit = (unit(np.array([r["embedding"] for r in q])) @ unit(np.array([r["embedding"] for r in b])).T) >= least
            ids = np.array([r["vec_id"] for r in b])
            out = [(r["vec_id"], int(h.sum() - (h & (ids == r["vec_id"])).sum())) for r, h in zip(q, hit, strict=True)]
        return pa.table({"vec_id": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64())})

    true = ask.unionByName(have).groupBy("label", "block").applyInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(found, "vec_id").agg(F.sum("n_links"), F.sum("n")).first()
    if not got[1]:
        raise ValueError("the queries have no links")
    return float(got[0] / got[1])
