"""Display labels as a dimension table (SRC-8, JON-6).

The nested ``lang -> section -> key -> label`` dictionaries become one long
table; overlays resolve section by section on the layer precedence (a later
layer's section replaces an earlier one's). The table is a fixed dictionary of a few hundred rows, so joining it
is a broadcast by construction; with the overlay resolved in the dictionaries
(``label_map``), a lookup is a map literal in the projection and needs no join.
"""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.constants import LABEL_LAYERS, LABELS


def label_rows(layers: dict = LABELS) -> list[tuple]:
    return [(layer, LABEL_LAYERS.get(layer, 1), lang, section, key, label)
            for layer, langs in layers.items()
            for lang, sections in langs.items()
            for section, entries in sections.items()
            for key, label in entries.items()]


def label_table(spark: SparkSession, layers: dict = LABELS) -> DataFrame:
    """SRC-8: all layers in long form."""
    return spark.createDataFrame(
        label_rows(layers),
        "layer string, precedence int, lang string, section string, key string, label string")


def effective_labels(labels: DataFrame, page: str | None = None) -> DataFrame:
    """SRC-8: ``common`` overlaid by ``page``: a section that the page has
    replaces the whole section (what only ``common`` has in it is a miss)."""
    use = ["common"] + ([page] if page else [])
    used = labels.filter(F.col("layer").isin(*use))
    last = used.groupBy("lang", "section").agg(F.max("precedence").alias("precedence"))
    return used.join(F.broadcast(last), ["lang", "section", "precedence"]).select("lang", "section", "key", "label")


def read_label_files(spark: SparkSession, paths: dict[str, str]) -> dict:
    """SRC-8: layers (``common`` or a page: path) of JSON dictionaries ``lang
    -> section -> key -> label``, as ``label_rows`` and ``label_map`` take
    them. One small document per layer."""
    out = {}
    for layer, path in paths.items():
        doc = spark.read.text(path, wholetext=True).first()
        if doc is None:
            raise ValueError(f"no label dictionary at {path}")
        out[layer] = json.loads(doc[0])
    return out


def label_map(layers: dict, lang: str, section: str, page: str | None = None) -> dict[str, str]:
    """One section's labels: the page's, if it has the section, else ``common``'s."""
    sections = [layers.get(layer, {}).get(lang, {}).get(section) for layer in ([page] if page else []) + ["common"]]
    return dict(next((s for s in sections if s is not None), {}))


def lookup(column: Column, labels: dict[str, str], on_miss: str = "null") -> Column:
    """JON-6 as an expression: ``column`` looked up in a resolved section."""
    if on_miss not in ("null", "key"):
        raise ValueError("on_miss must be 'null' or 'key'")
    if not labels:
        return column if on_miss == "key" else F.lit(None).cast("string")
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])[column]
    return F.coalesce(found, column) if on_miss == "key" else found


def translate(df: DataFrame, column: str, labels: DataFrame, lang: str, section: str,
              out: str | None = None, on_miss: str = "null", lower_key: bool = False) -> DataFrame:
    """JON-6: look ``column`` up in a label section.

    ``on_miss='null'`` gives null for unknown keys (a ``.map`` lookup);
    ``on_miss='key'`` keeps the original value (a ``.get(k, k)`` lookup).
    ``lower_key`` lower-cases the value before the lookup.
    """
    if on_miss not in ("null", "key"):
        raise ValueError("on_miss must be 'null' or 'key'")
    out = out or f"{column}_label"
    dim = (labels.filter((F.col("lang") == lang) & (F.col("section") == section))
                 .select(F.col("key").alias(f"_k_{out}"), F.col("label").alias(f"_l_{out}")))
    key: Column = F.lower(F.col(column)) if lower_key else F.col(column)
    j = df.join(F.broadcast(dim), key == F.col(f"_k_{out}"), "left")
    value = F.col(f"_l_{out}") if on_miss == "null" else F.coalesce(F.col(f"_l_{out}"), F.col(column))
    return j.withColumn(out, value).drop(f"_k_{out}", f"_l_{out}")

