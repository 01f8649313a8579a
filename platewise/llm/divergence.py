"""Audit of how far the sources of a language diverge in their terms.

A kept term is a row of the counts it has in its language's sources. The
divergence of two sources is a sum over all kept terms, most of which neither
source holds; so it is taken as if no source held any, corrected for every
term that one of the two holds, and corrected again for the terms that both
hold. The last part is the costly one: rows without their zeros go, in the
order of the sources, into a frequent-pattern tree with multiplicities. Terms
that have the same counts in their first sources share those nodes, and a
pair's correction is made once for a node and an ancestor of it, for all the
terms that pass through the node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.common import materialise, sized_join, slices, text_or_empty

#: A term is kept when so many documents of its language hold it.
LEAST_DOCUMENTS = 10
#: Ranks of part ``term``.
TERM_RANKS = 10
#: Shares are in parts of so many.
ONE = 1_000_000_000
#: Terms of a task that wait to be sent, and items and node-ancestor
#: combinations of a tree that are in memory at a time, about.
HELD_TERMS, TREE_ITEMS, COMBINATIONS = 200_000, 1 << 19, 1 << 20
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_DOCUMENT = 1 << 44  # a document in the upper part of a sum, its occurrences in the lower

_COUNTS = "lang string, source string, term string, n bigint, documents bigint"
_CORRECTIONS = "lang string, source string, item string, value bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term), summed over what
    fits in memory of the task's documents."""
    held, waiting = {}, 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = list(terms.values())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(list(terms), pa.binary()).cast(pa.string()),
                pa.array([x % _DOCUMENT for x in both], pa.int64()), pa.array([x // _DOCUMENT for x in both], pa.int64())],
                names=["lang", "source", "term", "n", "documents"])

    for b in slices(batches):
        groups = zip(b.column("lang").to_pylist(), b.column("source").to_pylist())
        for group, text in zip(groups, b.column("text").cast(pa.binary())):
            terms = held.setdefault(group, {})
            waiting -= len(terms)
            for term, n in Counter(_TERM.findall(text.as_py().lower())).items():  # bytes: only A-Z are lowered
                terms[term] = terms.get(term, 0) + _DOCUMENT + n
            waiting += len(terms)
            if waiting > HELD_TERMS:
                yield from sent()
                held, waiting = {}, 0
    yield from sent()


def _f(p, q):
    """floor((p - q)^2 / (p + q)) of columns or of arrays of whole numbers."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 2) / (total + 2 * terms)), whatever the counts'
    size; null where no term is kept."""
    wide = "decimal(20,0)"
    return F.lit(1).cast("bigint") + F.call_function(
        "div", (n.cast(wide) + 2) * ONE, F.nullif(total.cast(wide) + terms.cast(wide) * 2, F.lit(0).cast(wide)))


def tree_nodes(langs: np.ndarray, starts: np.ndarray, items: np.ndarray, times: np.ndarray):
    """The frequent-pattern tree of sorted rows, as arrays over its nodes.

    Row i is ``items[starts[i]:starts[i + 1]]`` (whole numbers, one of each
    kind of item) of language ``langs[i]`` and counts ``times[i]`` times.
    Gives, per node, (row, at, times): the first row that passes through it,
    its place in ``items`` there, and the rows' multiplicities; its ancestors
    are the items of that row before it. Equal neighbours share their nodes."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(items)) - starts[row]
    before = np.maximum(row - 1, 0)
    same = (row > 0) & (langs[row] == langs[before]) & (depth < lengths[before])
    same &= items[np.where(same, starts[before] + depth, 0)] == items
    shared = np.full(len(lengths), np.iinfo(np.int64).max)  # items a row begins with like the one before
    np.minimum.at(shared, row[~same], depth[~same])
    new = depth >= shared[row]
    by_depth = np.argsort(depth, kind="stable")  # within a depth in the rows' order: a node's rows are neighbours
    first = np.flatnonzero(new[by_depth])
    at = by_depth[first]
    summed = np.add.reduceat(times[row[by_depth]], first) if len(first) else np.zeros(0, np.int64)
    return row[at], at, summed


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms held by two sources add for the pair (source < item), from
    the tree of each run of sorted rows."""
    for batch in batches:
        lengths = np.diff(batch.column("path").offsets.to_numpy())
        cut = 0
        while cut < batch.num_rows:
            end = max(cut + 1, int(np.searchsorted(np.cumsum(lengths[cut:]), TREE_ITEMS, side="right")) + cut)
            yield from _of_tree(batch.slice(cut, end - cut))
            cut = end


def _of_tree(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    path = b.column("path")
    names, langs = path.flatten().field("source").dictionary_encode(), b.column("lang").dictionary_encode()
    source, lang = names.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
    p, zero = (path.flatten().field(c).to_numpy() for c in ("p", "zero"))
    starts = path.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    _, items = np.unique(np.stack([source, p]), axis=1, return_inverse=True)
    row, at, times = tree_nodes(lang, starts, items.ravel(), b.column("n").to_numpy())
    depth = at - starts[row]
    done = np.concatenate([[0], np.cumsum(depth)])
    k = 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(done, done[k] + COMBINATIONS, side="right")) - 1)
        node = np.repeat(np.arange(k, end), depth[k:end])
        k, low = end, k
        if not len(node):
            continue
        below = at[node]
        above = starts[row[node]] + np.arange(len(node)) - (done[node] - done[low])
        value = (_f(p[above], p[below]) - _f(p[above], zero[below]) - _f(zero[above], p[below])
                 + _f(zero[above], zero[below])) * times[node]
        pair = (lang[row[node]] * len(names.dictionary) + source[above]) * len(names.dictionary) + source[below]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, value = pair[first], np.add.reduceat(value[order], first)
        of, item = pair // len(names.dictionary), pair % len(names.dictionary)
        yield pa.RecordBatch.from_arrays([
            langs.dictionary.take(pa.array(of // len(names.dictionary))),
            names.dictionary.take(pa.array(of % len(names.dictionary))), names.dictionary.take(pa.array(item)),
            pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source;
    other columns are ignored; every row is a document).

    Null text, lang and source count as ''. Part ``pair`` has each source's
    divergence from every other source of its language, part ``term`` the
    terms that most set it apart from its language as a whole. A source
    without terms has its pairs; a source alone in its language has none; a
    language without kept terms has pairs of value 0. Equal values are ranked
    by the item's UTF-8 bytes. An empty table gives an empty result. All
    arithmetic is of whole numbers; a source's row of a term is never split,
    so a row has at most as many items as its language has sources."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*groups, text_or_empty().alias("text"))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("lang_n"),
        F.collect_list(F.struct("source", "n")).alias("cells")).filter(F.col("documents") >= least_documents)
    kept = materialise(kept.drop("documents"), "divergence-terms")
    cells = kept.select("lang", "term", "lang_n", F.inline("cells"))

    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    per_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = (docs.select(*groups).distinct().join(per_group, ["lang", "source"], "left")
               .join(per_lang, "lang", "left").fillna(0, ["total", "terms", "lang_total"]))
    sources = materialise(sources.withColumn("zero", _share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-sources")

    cells = sized_join(cells, sources, ["lang", "source"], "inner").withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("terms")))
    cells = materialise(cells.withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).select(
        "lang", "term", "source", "p", "q", "zero"), "divergence-cells")

    # if no source held any term
    other = sources.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    apart = F.col("source") != F.col("item")
    none = sized_join(sources, other, ["lang"], "inner").filter(apart).select(
        "lang", "source", "item", F.coalesce(F.col("terms") * _f(F.col("zero"), F.col("item_zero")), F.lit(0)).alias("value"))
    # for the terms that one source holds, all of a group with the same share at once
    shares = cells.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("n"))
    one = sized_join(shares, other, ["lang"], "inner").filter(apart).select(
        "lang", "source", "item",
        (F.col("n") * (_f(F.col("p"), F.col("item_zero")) - _f(F.col("zero"), F.col("item_zero")))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # for the terms that both hold
    paths = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n"))
    both = (paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
            .mapInArrow(_corrections, _CORRECTIONS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    def turned(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    pairs = none.unionByName(turned(one.unionByName(both))).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = cells.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs, terms = pairs.withColumn("rank", place), terms.withColumn("rank", place).filter(F.col("rank") <= term_ranks)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
