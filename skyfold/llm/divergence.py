"""How far sources of one language are apart: exact divergences of their term distributions.

Joint count histograms: for two sources, all terms with counts (m, n) add the same to their divergence. So per pair of
sources only how many terms have each (m, n) is tallied. Cells where both counts are above 0 are tallied from terms'
lists of (source, count), within tasks and without a row for a pair of a term's sources; cells with a zero are implied by
each source's own histogram, less what the pair's tally has of it. Then the divergence is evaluated once for each
combination and multiplied by its number of terms.

All is in whole numbers of 64 bits: counts must stay below 9e15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms of sources that a task counts at a time before it sends them, and pairs of cells that it tallies at a time.
HELD_TERMS, TALLIED = 300_000, 1 << 21
#: Bytes of terms: ASCII letters, lower-cased, and all bytes from 0x80 on; the others part terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms and documents that hold them, for each (lang, source), added up within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            keys = list(n)
            size = len(keys)
            cols = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = terms_of(text)
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from send()
    yield from send()


def term_counts(docs: DataFrame, at_least: int = 10) -> DataFrame:
    """Kept terms: lang, term, n (occurrences in the lang), cells (array of source and n, ascending, n above 0)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return kept.where(F.col("docs") >= at_least).select("lang", "term", "n", "cells")


_TALLY = "lang string, a string, b string, m long, n long, terms long"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From terms' lists of (source, count): how many terms have counts (m, n) in sources a < b, both above 0."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(flat):
            continue
        langs, sources = batch.column(0).dictionary_encode(), flat.field(0).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        source = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values, count = np.unique(flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        ends = np.repeat(np.cumsum(sizes), sizes)
        later = ends - np.arange(len(ends)) - 1  # cells of the same term after each cell: sources ascend, so a < b
        bounds = np.r_[0, np.cumsum(later)]
        i = 0
        while i < len(later):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + TALLIED, "right")) - 1)
            own = later[i:j]
            x = np.repeat(np.arange(i, j), own)
            y = x + 1 + np.arange(len(x)) - np.repeat(bounds[i:j] - bounds[i], own)
            kinds, pair = np.unique((lang[x] * len(sources.dictionary) + source[x]) * len(sources.dictionary) + source[y], return_inverse=True)
            cells, terms = np.unique((pair * len(values) + count[x]) * len(values) + count[y], return_counts=True)
            pair, m, n = cells // len(values) ** 2, cells // len(values) % len(values), cells % len(values)
            a, b = kinds[pair] // len(sources.dictionary), kinds[pair] % len(sources.dictionary)
            cols = [langs.dictionary.take(pa.array(a // len(sources.dictionary))), sources.dictionary.take(pa.array(a % len(sources.dictionary))), sources.dictionary.take(pa.array(b))]
            if len(cells):
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in (values[m], values[n], terms))], names=["lang", "a", "b", "m", "n", "terms"])
            i = j


def _share(count: str, total: str, terms: str) -> str:
    """1 + floor(1e9 * (count + 2) / (total + 2 * terms)) in SQL, by long division in three steps of 1000: nothing overflows."""
    below = f"({total} + 2 * {terms})"
    first = f"(({count} + 2) * 1000)"
    second = f"(({first} % {below}) * 1000)"
    third = f"(({second} % {below}) * 1000)"
    return f"(1 + ({first} div {below}) * 1000000 + ({second} div {below}) * 1000 + ({third} div {below}))"


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) in SQL; p and q are at most 1e9 + 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def audit(docs: DataFrame, at_least: int = 10, top: int = 10) -> DataFrame:
    """Divergences of each (lang, source) of docs: rows (lang, source, part, item, value, rank).

    Null lang, source and text are ''. A lang keeps the terms that are in at_least of its rows or more (V of them); each
    (lang, source) that occurs, and each lang, gives each kept term p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), N being
    its occurrences of kept terms. f = floor((p - q)^2 / (p + q)). Part pair: item is each other source of the lang, value
    the sum of f over all kept terms, also those that neither has (0 where V is 0). Part term: item is a kept term that the
    source has and that has a larger p there than in its lang, value its f, at most top of them. Ranks follow value
    descending, then item ascending by UTF-8. Equal rows count each; a very long text is counted by one task; other columns
    are ignored; an empty table gives no rows. The list of a term holds one entry for each source of its lang, and
    there is a row for each two sources of a lang: neither is meant for sources without number.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kept = common.cut(term_counts(docs, at_least))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    cells = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    info = common.cut(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "lang_total", "v"]))

    shares = cells.join(info, ["lang", "source"]).select("lang", "source", "term", F.expr(_share("n", "total", "v")).alias("p"), F.expr(_share("lang_n", "lang_total", "v")).alias("q"))
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    def side(name: str) -> DataFrame:
        return info.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"), F.col("held").alias(f"held_{name}"), "v")

    pairs = side("a").join(side("b").drop("v"), "lang").where("a < b")
    alone = cells.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("terms"))
    tallied = kept.select("lang", "cells").mapInArrow(_tally, _TALLY).groupBy("lang", "a", "b", "m", "n").agg(F.sum("terms").alias("terms"))
    implied = tallied.select("lang", "a", "b", F.expr("stack(4, m, n, terms, m, 0L, -terms, 0L, n, -terms, 0L, 0L, terms) as (m, n, terms)"))
    of_a = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("count").alias("m"), F.lit(0).cast("long").alias("n"), "terms")
    of_b = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("m"), F.col("count").alias("n"), "terms")
    none = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("n"), F.expr("v - held_a - held_b").alias("terms"))
    combined = none.unionByName(implied).unionByName(of_a).unionByName(of_b).groupBy("lang", "a", "b", "m", "n").agg(F.sum("terms").alias("terms"))
    known = combined.join(side("a").drop("held_a"), ["lang", "a"]).join(side("b").drop("held_b", "v"), ["lang", "b"])
    f = _apart(_share("m", "total_a", "v"), _share("n", "total_b", "v"))
    sums = known.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"CASE WHEN terms > 0 THEN {f} * terms ELSE 0L END")).alias("value"))
    both = sums.select("lang", "value", F.expr("stack(2, a, b, b, a) as (source, item)"))
    near = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return near.unionByName(best)
