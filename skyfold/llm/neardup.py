"""MinHash near-duplicates with odd sketches.

Every document becomes 128 MinHash samples of its 5-word shingles; 32 bands of 4 samples propose candidates, and
the samples folded into a 512-bit parity bitmap (odd sketch) estimate a pair's similarity from the population
count of an XOR. Accepted candidates are confirmed on the full shingle sets.

The members of a bucket are not paired with each other. First each is compared with the bucket's smallest document.
Then, twice, a forest of nearest sketches that spans the components met so far is confirmed: one edge a member at
most. Last, members of one bucket that still are in different components are compared by larger sketches: those
outside the bucket's largest component with all members, which are dealt to blocks. Where very many are outside it, the
bucket is split first, by 128 further bands of 8 samples each. All that are near enough are confirmed. So groups of
copies of any size stay linear and no link is given up. A round that finds nothing to do ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, words

U = np.uint64
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: The estimate's standard deviation at 0.75 is about 0.05 with these sizes; a candidate goes on to the exact check from 0.75 less this.
MARGIN = 0.2
#: Larger sketches, only of documents that the last round still compares; the estimate's deviation is about 0.017.
FINE_SAMPLES, FINE_BITS, FINE_MARGIN = 1024, 4096, 0.07
#: Members of one bucket that one task compares.
BLOCK = 4096
#: Further bands that split a bucket with more than BLOCK members outside its largest component. They miss a pair of similarity 0.75 with a probability of 1.4e-6.
FINE_BANDS, FINE_ROWS = 128, 8

_rng = np.random.Generator(np.random.PCG64(77))
_A = (_rng.integers(0, 2**31, FINE_SAMPLES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, FINE_SAMPLES, dtype=np.int64).astype(np.uint32)
_BIT_SALT = words.mix(np.arange(1, FINE_SAMPLES + 1, dtype=np.int64).astype(U) * U(0x9E3779B97F4A7C15))
_DOC_BITS = 10


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of at most 1000 texts: sorted 54-bit names in one array, and each text's offset in it."""
    n = len(offsets) - 1
    _, _, names, at = words.words(data, offsets, fold=True)
    ok, counts = words.inside(at, k)
    grams = words.rolled(names, k)[ok] if len(ok) else np.zeros(0, U)
    owner = np.repeat(np.arange(n), counts)
    few = np.flatnonzero((np.diff(at) > 0) & (counts == 0))
    if len(few):
        with np.errstate(over="ignore"):
            c = np.zeros(len(names) + 1, U)
            rank = np.arange(len(names)) - np.repeat(at[:-1], np.diff(at))
            np.cumsum(names * words.powers(words._M, max(1, len(names)))[rank], out=c[1:])
            short = words.mix(c[at[few + 1]] - c[at[few]] + (at[few + 1] - at[few]).astype(U) * U(0xD6E8FEB86659FD93))
        grams, owner = np.concatenate([grams, short]), np.concatenate([owner, few])
    keys = np.sort((owner.astype(U) << U(64 - _DOC_BITS)) | (grams >> U(_DOC_BITS)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    edges = np.searchsorted(keys, np.arange(n + 1).astype(U) << U(64 - _DOC_BITS))
    return keys & U((1 << (64 - _DOC_BITS)) - 1), edges


def minhashes(sets: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """(len(begin), count) MinHash samples of the sets that begin there."""
    x = (words.mix(sets) >> U(32)).astype(np.uint32)
    out = np.empty((len(begin), count), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(count):
            out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], begin)
    return out


def fold(samples: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches: (n, bits / 64) words whose bits are the parity of the samples that fall on them."""
    n, count = samples.shape
    at = (words.mix(samples.astype(U) + _BIT_SALT[:count]) >> U(40)).astype(np.int64) % bits
    odd = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.reshape(n, bits).astype(np.uint8), axis=1).view(np.int64)


def sketches(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty set: two 64-bit sums that name it, its band keys (n, BANDS), its odd sketch (n, SKETCH_BITS / 64)."""
    begin = edges[:-1][np.diff(edges) > 0]
    n = len(begin)
    if not n:
        return np.zeros((0, 2), U), np.zeros((0, BANDS), U), np.zeros((0, SKETCH_BITS // 64), np.int64)
    with np.errstate(over="ignore"):
        named = np.stack([np.add.reduceat(words.mix(sets + U(11)), begin), np.add.reduceat(words.mix(sets * U(3) + U(5)), begin)], 1)
        samples = minhashes(sets, begin, SAMPLES)
        wide = samples.astype(U)
        keys = np.zeros((n, BANDS), U)
        for r in range(ROWS):
            keys = words.mix(keys * U(31) + wide[:, r::ROWS] + U(1))
        keys = words.mix(keys + np.arange(BANDS).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return named, keys, fold(samples, SKETCH_BITS)


def estimate(differing_bits: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * differing_bits / bits, 1e-9))


def most_bits(share: int, fine: bool = False) -> float:
    """Bits in which two sketches differ at most, for an estimate of share percent less the margin."""
    samples, bits, margin = (FINE_SAMPLES, FINE_BITS, FINE_MARGIN) if fine else (SAMPLES, SKETCH_BITS, MARGIN)
    return (1 - np.exp((share / 100 - margin - 1) * 4 * samples / bits)) / 2 * bits


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    for batch in batches:
        data, offsets = words.buffers(batch.column(1))
        for i, j in words.chunks(offsets):
            sets, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = np.diff(edges)
            named, keys, odd = sketches(sets, edges)
            has = np.flatnonzero(sizes > 0)
            slot = np.full(j - i, -1)
            slot[has] = np.arange(len(has))
            absent = slot < 0
            h = np.zeros((j - i, 2), np.int64)
            h[has] = named.view(np.int64)
            lengths = np.concatenate([[0], np.cumsum(np.where(absent, 0, BANDS))]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.where(absent, 0, SKETCH_BITS // 64))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(h[:, 0], mask=absent),
                    pa.array(h[:, 1], mask=absent),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(keys.view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(odd.ravel())),
                ],
                names=["id", "n_shingles", "h1", "h2", "bands", "sketch"],
            )
    words.release()


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, set)."""
    for batch in batches:
        data, offsets = words.buffers(batch.column(1))
        for i, j in words.chunks(offsets):
            sets, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([sets[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["id", "shingles"])
    words.release()


def _fine_of(split: bool):
    """(id, text) to (id, sketch, keys): the larger sketches, and where split the keys of the further bands (else none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            for i, j in words.chunks(offsets, most_rows=250):
                sets, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                has = np.flatnonzero(np.diff(edges) > 0)
                if len(has):
                    samples = minhashes(sets, edges[:-1][has], FINE_SAMPLES)
                    odd = fold(samples, FINE_BITS)
                    keys = np.zeros((len(has), FINE_BANDS if split else 0), U)
                    if split:
                        with np.errstate(over="ignore"):
                            for r in range(FINE_ROWS):
                                keys = words.mix(keys * U(31) + samples[:, r::FINE_ROWS].astype(U) + U(1))
                            keys = words.mix(keys + np.arange(FINE_BANDS).astype(U) * U(0xC2B2AE3D27D4EB4F))
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (odd, keys)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(has)), *lists], names=["id", "sketch", "keys"])
        words.release()

    return run


def _confirm(share: int):
    """mapInArrow function over rows (a, salt, b, shingles) sorted by (a, salt, side): the set of a, then those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, U)
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, b, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                values = np.frombuffer(blob, U)
                if b is None:
                    at, own = (a, salt), values
                elif at == (a, salt):
                    small, large = (values, own) if len(values) < len(own) else (own, values)
                    if 100 * len(small) < share * len(large):
                        continue
                    pos = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(pos, len(large) - 1)] == small)) if len(large) else 0
                    if both and 100 * both >= share * (len(own) + len(values) - both):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        words.release()

    return run


def confirm(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """Of distinct pairs (a, b), a cut point, those whose full sets reach share percent. texts: (id, text), one set an id.

    A vertex with many partners is dealt to several tasks, each with its set and at most 500 or so partners.
    """
    sets, _ = common.divide(texts, "id", pairs.select("a", "b"), among=(_sets_of, "id long, shingles binary"))
    loads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("m"))
    left = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    right = pairs.join(loads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("salt"), "b", F.col("b").alias("id"))
    asked = left.unionByName(right).join(sets, "id").select("a", "salt", "b", "shingles")
    n = common.parts(pairs.sparkSession)
    dealt = asked.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_confirm(share), "a long, b long")


def _forest(odd: np.ndarray, comps: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest of nearest sketches that spans the members' components (Prim), none over most differing bits."""
    n = len(odd)
    best, via = np.full(n, 1 << 20), np.zeros(n, np.int64)
    outside = np.ones(n, bool)
    out = []
    at = 0
    for _ in range(n):
        outside[at] = False
        d = np.bitwise_count(odd ^ odd[at]).sum(1).astype(np.int64)
        d[comps == comps[at]] = -1
        closer = outside & (d < best)
        best[closer], via[closer] = d[closer], at
        left = np.flatnonzero(outside)
        if not len(left):
            break
        at = left[np.argmin(best[left])]
        if 0 <= best[at] <= most:
            out.append((via[at], at))
    x = np.array(out, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _across(odd: np.ndarray, comps: np.ndarray, bands: np.ndarray, band: int, one: np.ndarray, two: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a member of one and a member of two in different components and near enough; of two in one, each pair once.

    A pair that shares several bands is given in the first of them only.
    """
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inner = np.zeros(len(odd), bool)
    inner[one] = True
    for i in one:
        others = two[(comps[two] != comps[i]) & (~inner[two] | (two > i))]
        near = others[np.bitwise_count(odd[others] ^ odd[i]).sum(1) <= most]
        if len(near):
            near = near[bands[i][np.argmax(bands[near] == bands[i], axis=1)] == band]
        out_a.append(np.full(len(near), i))
        out_b.append(near)
    return np.concatenate(out_a), np.concatenate(out_b)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, comps = table["id"].to_numpy(), table["component"].to_numpy()
    return ids, comps, table["sketch"].combine_chunks().flatten().to_numpy().view(U).reshape(len(ids), -1)


def _pairs(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})


def _nearest(share: int):
    """Of one block of one bucket: the pairs of a spanning forest."""

    def run(key, table):
        ids, comps, odd = _columns(table)
        return _pairs(ids, *_forest(odd, comps, most_bits(share)))

    return run


def _all_near(share: int):
    """All pairs that are near enough of the two blocks of one bucket that a task holds: one of members that stand out, one of the others or of such members, too."""

    def run(key, table):
        ids, comps, odd = _columns(table)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        home, out = table["home"].to_numpy(), table["outside"].to_numpy(zero_copy_only=False)
        band, i, j, inner = (k.as_py() for k in key)
        if inner:
            one, two = np.flatnonzero(home == i), np.flatnonzero(home == j)
        else:
            one, two = np.flatnonzero(out), np.flatnonzero(~out)
        return _pairs(ids, *_across(odd, comps, bands, band, one, two, most_bits(share, True)))

    return run


def _standing(members: DataFrame) -> DataFrame:
    """members (band, id, component) of buckets with several components, with n (members), outside (not of the bucket's largest component) and m (how many are)."""
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    of = sizes.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    got = members.join(of.select("band", "n", F.col("top.component").alias("top"), (F.col("n") - F.col("top.k")).alias("m")), "band")
    return got.withColumn("outside", F.col("component") != F.col("top")).drop("top")


def _rest(placed: DataFrame, own: DataFrame, bands: DataFrame, share: int, block: int, old: list) -> DataFrame:
    """Pairs to confirm of members (band, id, component) that one bucket holds and that are in different components.

    Members outside the largest component and the others are dealt to blocks; every block of the first meets all
    blocks of both kinds. Cut points that only these pairs read are added to old.
    """
    waiting = common.cut(_standing(placed))
    old.append(waiting)
    crowded = waiting.where(F.col("m") > block)
    split = bool(crowded.limit(1).count())
    fine, _ = common.divide(own, "id", waiting.select("id"), among=(_fine_of(split), "id long, sketch array<long>, keys array<long>"))
    fine = fine.join(waiting.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    if split:
        fine = common.cut(fine)
        old.append(fine)
        keyed = crowded.join(fine.select("id", "keys"), "id").select(F.col("id"), "component", F.posexplode("keys").alias("at", "key"), F.col("band").alias("was"))
        keyed = _standing(keyed.select(F.xxhash64("was", "at", "key").alias("band"), "id", "component"))
        named = keyed.select("band", "id", "component", "n", "m", "outside", F.lit(True).alias("own_band"))
        waiting = waiting.where(F.col("m") <= block).withColumn("own_band", F.lit(False)).unionByName(named)
    else:
        waiting = waiting.withColumn("own_band", F.lit(False))
    rows = waiting.join(fine.select("id", "sketch"), "id").join(bands, "id")
    rows = rows.withColumn("bands", F.when(F.col("own_band"), F.array("band")).otherwise(F.col("bands")))  # of a split bucket every key may give a pair
    rows = rows.withColumn("bo", F.ceil(F.col("m") / block).cast("int")).withColumn("bi", F.ceil((F.col("n") - F.col("m")) / block).cast("int"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("bo")).otherwise(F.col("bi"))).cast("int"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    to = lambda i, j, inner: F.struct(i.alias("i"), j.alias("j"), F.lit(inner).alias("inner"))
    home = F.col("home")
    stands = F.concat(each("bi", lambda j: to(home, j, False)), each("bo", lambda k: to(F.least(home, k), F.greatest(home, k), True)))
    rows = rows.withColumn("to", F.explode(F.when(F.col("outside"), stands).otherwise(each("bo", lambda i: to(i, home, False)))))
    rows = rows.select("band", "id", "component", "sketch", "bands", "home", "outside", "to.*")
    return rows.groupBy("band", "i", "j", "inner").applyInArrow(_all_near(share), "a long, b long").distinct()


def _merged(near: DataFrame, found: DataFrame) -> DataFrame | None:
    """Components (id, component) after new links found (a, b); None where these join none."""
    top = near.select("id", "component")
    met = found.join(top.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(top.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
    met = common.cut(met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    if not met.limit(1).count():
        common.drop(met)
        return None
    again = common.components(met)
    ids = near.select("id", "component").unionByName(again.select("id", F.col("id").alias("component")).join(near, "id", "left_anti"))
    out = common.cut(ids.join(again.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select("id", F.coalesce("c", "component").alias("component")))
    common.drop(met)
    return out


def _linked(texts: DataFrame, marked: DataFrame, known: DataFrame | None, share: int, block: int) -> DataFrame:
    """marked with component (the smallest id reachable). texts: (id, text); marked: its sketches; known: links (a, b) to begin with."""
    some = marked.where("h1 is not null")
    classes = common.cut(some.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    first = some.join(classes, (some.h1 == classes.h1) & (some.h2 == classes.h2) & (some.id == classes.rep), "left_semi")
    reps = common.cut(first.dropDuplicates(["id"]).select("id", "bands", "sketch"))
    keyed = reps.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.cut(keyed.join(shared, "band").select("band", "a", "n", F.col("id").alias("b")))
    odd = [reps.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    star = members.where("a <> b").select("a", "b").distinct().join(odd[1], "b").join(odd[0], "a")
    differing = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    star = common.cut(star.where(differing <= most_bits(share)).select("a", "b"))
    found = confirm(star, texts, share).distinct()
    if known is not None:  # these are links of rows, not of classes
        named = known.select(F.col("a").alias("id")).unionByName(known.select(F.col("b").alias("id"))).distinct()
        of = some.join(named, "id", "left_semi").join(classes, ["h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
        found = found.unionByName(known).unionByName(of)
    links = common.cut(found)
    tried, near, old = star, common.components(links), [star]
    common.drop(links)
    for last in (False, False, True):
        placed = members.join(near, members.b == near.id, "left").select("band", "n", F.col("b").alias("id"), F.coalesce("component", "b").alias("component"))
        mixed = common.cut(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band"))
        old.append(mixed)
        if not mixed.limit(1).count():
            break
        waiting = placed.join(mixed, "band")
        if last:
            pairs = _rest(waiting.select("band", "id", "component"), texts, reps.select("id", "bands"), share, block, old)
        else:
            waiting = waiting.join(reps.select("id", "sketch"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int"))
            pairs = waiting.select("band", "id", "component", "sketch", "block").groupBy("band", "block").applyInArrow(_nearest(share), "a long, b long").distinct()
        pairs = common.cut(pairs.join(tried, ["a", "b"], "left_anti"))
        old.append(pairs)
        tried = tried.unionByName(pairs)
        if pairs.limit(1).count():
            merged = _merged(near, confirm(pairs, texts, share).distinct())
            if merged is not None:
                common.drop(near)
                near = merged
    common.drop(reps, members, *old)
    final = classes.join(near, classes.rep == near.id, "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = marked.join(final, ["h1", "h2"], "left")
    if known is not None:
        out = out.withColumnRenamed("component", "of_class").join(near, "id", "left").withColumn("component", F.coalesce("of_class", "component")).drop("of_class")
    return out.withColumn("component", F.coalesce("component", "id"))


_ONE = "id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def cluster(docs: DataFrame, share: int = 75, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; other columns are ignored).

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased; fewer than five words make one shingle; a text
    without words (or null) has an empty set and is linked with nothing. Two documents are linked if their sets'
    intersection is at least share percent of their union. Equal sets are one class and are represented by the
    smallest doc_id, so exact copies cost nothing more. A doc_id that occurs on several rows is one vertex, whatever
    their texts are and in whatever order they come. A null doc_id forms its own component (component_id null, kept
    false) and is linked with nothing. An empty table gives no rows. block: members of a bucket that one task compares.
    """
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    marked = common.cut(texts.mapInArrow(_sketch_batches, _ONE))
    named = marked.where("id is not null")
    texts = texts.where("id is not null")
    sets = F.struct(F.coalesce("h1", F.lit(0)).alias("one"), F.coalesce("h2", F.lit(0)).alias("two"))
    several = common.cut(named.groupBy("id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").select(F.col("id").alias("doc_id")))
    if several.limit(1).count():
        # Such a doc_id has a vertex for each of its texts, named by both, and links between these.
        row = texts.withColumnRenamed("id", "doc_id").join(several.withColumn("odd", F.lit(True)), "doc_id", "left")
        row = common.cut(row.select("doc_id", "text", F.when(F.col("odd"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("id")))
        texts = row.select("id", "text")
        again = common.cut(texts.mapInArrow(_sketch_batches, _ONE))
        owner = common.cut(row.select("id", "doc_id").distinct())
        stars = owner.join(owner.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
        linked = _linked(texts, again, stars, share, block)
        low = linked.join(owner, "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        # An id stands for one doc_id and text, so equal rows of it are equal rows of docs.
        out = linked.join(low, "component").join(owner, "id").select("doc_id", "n_shingles", "component_id")
    else:
        out = _linked(texts, named, None, share, block).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(marked.where("id is null").select(F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))
