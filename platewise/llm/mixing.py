"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its
documents is due: a whole part that every document gets, and a fraction that
rounding decides. Two fractions meet, words move at random from one document
to the other until one of them holds a whole copy or none, and the other goes
on to meet the next. The expected copies of a document stay what they were
and the words of the pair stay together what they were, so a source misses
its target by no more than its last open document. Documents meet within
blocks of bounded size, the longest first, each with the shorter ones as one
partner, so that a short one is left open; it meets what the other blocks
leave in the next levels of a reduction tree. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import helper_names, materialise, row_key, sized_join
from platewise.operators.validate import with_ordinal

#: Documents that meet in one block.
BLOCK = 256
#: No document is taken more often than this.
MOST_COPIES = 3
#: Weights by position in the order of the sources' names, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_SEED = 20_240_607


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that follows from the columns alone."""
    return (F.xxhash64(F.lit(_SEED), *cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Weights follow the sources' code-point order, null last. A target above
    ``MOST_COPIES`` times its source's size stops there and the excess is
    shared anew by weight: with the sources sorted by limit over weight, the
    stopped ones come first, and a source is stopped when its fair share of
    what the earlier ones leave exceeds its limit. Works on one row per
    source. Sources without words get 0."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = with_ordinal(by.orderBy(F.col("source").isNull(), "source"), "place")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    by = by.withColumn("weight", F.element_at(weights, (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int")))
    by = materialise(by.withColumn("limit", (F.lit(MOST_COPIES) * F.col("source_size")).cast("double")), "mix-sources")
    # the level, words per weight, that the open sources share; more stop as it rises
    level, stopped, before = 0.0, F.lit(False), -1
    while True:
        left, open_, count = by.agg(
            F.sum("source_size") - F.sum(F.when(stopped, F.col("limit")).otherwise(0.0)),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))), F.count_if(stopped)).first()
        if count == before:
            break
        level, before = (left / open_ if open_ else level), count
        stopped = F.col("limit") / F.col("weight") < F.lit(level)
    return by.select("source", "source_size",
                     F.when(stopped, F.col("limit")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


_STATE = "struct<key:bigint,words:bigint,part:double>"


def _settle(items: Column, part: Column, words: Column) -> Column:
    """Fold an array of (key, words), the longest first, whose fractions are
    all ``part`` and whose words are ``words`` together: each document meets
    those after it, whose fractions stay equal, as one partner. Gives what
    ``_meet`` gives."""
    start = F.struct(F.expr("cast(array() as array<struct<key:bigint,copies:int>>)").alias("done"),
                     F.lit(None).cast(_STATE).alias("rest"), part.cast("double").alias("part"),
                     words.cast("bigint").alias("words"))

    def step(state: Column, x: Column) -> Column:
        g, z, others = state["part"], x["words"], state["words"] - x["words"]
        up = F.least((1 - g) * z, g * others)  # words that x can take from the others
        down = F.least(g * z, (1 - g) * others)  # words that the others can take from x
        gains = _uniform(x["key"]) * (up + down) < down

        def after(copies: Column | None, open_: Column | None, left: Column) -> Column:
            done = state["done"] if copies is None else F.concat(
                state["done"], F.array(F.struct(x["key"].alias("key"), copies.cast("int").alias("copies"))))
            rest = state["rest"] if open_ is None else F.struct(
                x["key"].alias("key"), z.alias("words"), open_.alias("part"))
            return F.struct(done.alias("done"), rest.cast(_STATE).alias("rest"), left.cast("double").alias("part"),
                            others.cast("bigint").alias("words"))

        return (F.when((g <= 0) | (g >= 1), after(g, None, g))  # all that follow are settled
                .when(others <= 0, after(None, g, F.lit(0.0)))
                .when(gains & ((1 - g) * z <= g * others), after(F.lit(1), None, F.greatest(g - up / others, F.lit(0.0))))
                .when(gains, after(None, g + up / z, F.lit(0.0)))
                .when(g * z <= (1 - g) * others, after(F.lit(0), None, F.least(g + down / others, F.lit(1.0))))
                .otherwise(after(None, g - down / z, F.lit(1.0))))

    return F.aggregate(items, start, step)


def _meet(items: Column) -> Column:
    """Fold an array of (key, words, part) in its order: the open document
    meets the next one. Gives (done: array of (key, copies), rest: the open
    document or null)."""
    item = _STATE
    start = F.struct(F.expr("cast(array() as array<struct<key:bigint,copies:int>>)").alias("done"),
                     F.lit(None).cast(item).alias("rest"))

    def settled(key: Column, copies: int) -> Column:
        return F.array(F.struct(key.alias("key"), F.lit(copies).alias("copies")))

    def opened(x: Column, part: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["words"].alias("words"), part.alias("part"))

    def step(state: Column, x: Column) -> Column:
        a = state["rest"]
        up = F.least((1 - a["part"]) * a["words"], x["part"] * x["words"])  # words that a can take from x
        down = F.least(a["part"] * a["words"], (1 - x["part"]) * x["words"])  # words that x can take from a
        a_gains = _uniform(a["key"], x["key"]) * (up + down) < down
        fills = (1 - a["part"]) * a["words"] <= x["part"] * x["words"]
        empties = a["part"] * a["words"] <= (1 - x["part"]) * x["words"]

        def after(done: Column, rest: Column) -> Column:
            return F.struct(F.concat(state["done"], done).alias("done"), rest.alias("rest"))

        met = (F.when(a_gains & fills, after(settled(a["key"], 1), opened(x, x["part"] - up / x["words"])))
               .when(a_gains, after(settled(x["key"], 0), opened(a, a["part"] + up / a["words"])))
               .when(empties, after(settled(a["key"], 0), opened(x, x["part"] + down / x["words"])))
               .otherwise(after(settled(x["key"], 1), opened(a, a["part"] - down / a["words"]))))
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), x.cast(item).alias("rest"))).otherwise(met)

    return F.aggregate(items, start, step)


def _round(parts: DataFrame) -> DataFrame:
    """(source, key, copies) for every row of ``parts`` (source, key, words,
    part in (0, 1), words over 0): level by level, blocks fold and their open
    documents go on, until one is open in each source; a draw decides it."""
    decided, rest, first = [], materialise(parts, "mix-level"), True
    while True:
        counts = materialise(rest.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
        if counts.isEmpty():
            break
        most = counts.agg(F.max("n")).first()[0]
        blocks = counts.select(F.col("source").alias("_source"),
                               F.ceil(F.col("n") / BLOCK).alias("_blocks"))
        dealt = rest.join(F.broadcast(blocks) if counts.count() <= 100_000 else blocks,
                          F.col("source").eqNullSafe(F.col("_source")))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(F.lit(most), "key"), F.col("_blocks")))
        folded = dealt.groupBy("source", "_block").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("at"), "key", "words", "part"))).alias("items"))
        items = F.transform("items", lambda x: F.struct(
            x["key"].alias("key"), x["words"].alias("words"), x["part"].alias("part")))
        # in the first level all fractions of a source are the same
        m = _settle(items, items[0]["part"], F.aggregate(items, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])) \
            if first else _meet(items)
        folded, first = folded.select("source", m.alias("m")), False
        folded = materialise(folded.select("source", "m.done", "m.rest"), "mix-level")
        decided.append(folded.select("source", F.inline("done")))
        rest = folded.filter(F.col("rest").isNotNull()).select("source", "rest.*")
        if most <= BLOCK:  # one block, so one open document, in every source
            decided.append(rest.select("source", "key", (_uniform(F.col("key")) < F.col("part")).cast("int").alias("copies")))
            break
    if not decided:
        return parts.select("source", "key", F.lit(0).alias("copies"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are
    ignored): doc_id, size, source, source_size, target, copies, taken, row_key.

    A size counts the words of the text (null: none). ``copies`` is 0 to 3;
    ``taken`` is copies times size. A null source is a source of its own.
    Rows that repeat doc_id, text and source are one document with the words
    of all, and all get its copies. Documents without words get their
    source's whole copies and a draw for the rest. An empty table gives an
    empty result; sources without words have target 0 and no copies. The same
    rows give the same copies, whatever their order and partitions."""
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key().alias("row_key")), "mix-rows")
    rows = rows.withColumn("key", F.xxhash64("doc_id", "row_key", "source"))
    targets = materialise(source_targets(rows.select("source", "size")), "mix-targets")
    targets = targets.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                 .otherwise(F.lit(0.0)))
    named = targets.select(F.col("source").alias("_source"), "source_size", "target", "due")
    rows = rows.join(F.broadcast(named) if targets.count() <= 100_000 else named,
                     F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    units = rows.groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("due").alias("due"))
    units = units.withColumn("part", F.col("due") - F.floor("due")).filter("part > 0 and words > 0")
    rounded = materialise(_round(units.select("source", "key", "words", "part")).select(
        "key", F.col("copies").alias("_more")), "mix-rounded")
    out = sized_join(rows, rounded, ["key"], "left")
    part = F.col("due") - F.floor("due")
    more = F.coalesce("_more", (_uniform(F.col("key")) < part).cast("int"))
    copies = (F.floor("due") + more).cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"), "row_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say.
    Null texts, and texts without words, have no words to take and get their
    source's copies like others; a null source is one of its own; rows that
    repeat doc_id, text and source get the same copies each. ``docs`` may have
    any other columns; they come back as they are."""
    id_, key, source, copies, own, copy = helper_names("id", "key", "source", "copies", "own", "copy")
    plan = mix(docs).groupBy("doc_id", "row_key", "source").agg(F.max("copies").alias("copies"))
    plan = materialise(plan.filter("copies > 0").select(
        F.col("doc_id").alias(id_), F.col("row_key").alias(key), F.col("source").alias(source),
        F.col("copies").alias(copies)), "mix-plan")
    match = [F.col("doc_id").eqNullSafe(F.col(id_)), F.col(own) == F.col(key),
             F.col("source").eqNullSafe(F.col(source))]
    small = plan.count() <= 300_000
    out = docs.withColumn(own, row_key()).join(F.broadcast(plan) if small else plan, match)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.drop(id_, key, source, copies, own, copy)
