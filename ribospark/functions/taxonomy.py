"""Lineage strings and consensus arrays, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kmers import let

#: Rank names, first to last.
RANKS = ("Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species")


def split_lineage(lineage: Column) -> Column:
    return F.split(lineage, ";")


def lineage_prefixes(lineage: Column) -> Column:
    """The lineage cut after each rank, shortest first."""
    return let(F.split(lineage, ";"), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ";")))


def fix_taxonomy(lineage: Column, n_levels: int = 6) -> Column:
    """Trailing ``;`` stripped, missing ranks filled with ``{last}_unclassified``."""
    parts = F.split(F.regexp_replace(lineage, ";+$", ""), ";")
    fill = F.array_repeat(F.concat(F.element_at(parts, -1), F.lit("_unclassified")), F.greatest(F.lit(n_levels) - F.size(parts), F.lit(0)))
    return F.array_join(F.concat(parts, fill), ";")


def fix_qiime_taxa(lineage: Column) -> Column:
    """Rank prefixes such as ``g__`` deleted, with blanks before them."""
    return F.regexp_replace(lineage, "(?U)\\s*\\w+__", "")


def filter_confidence(taxonomy: Column, min_confidence: int = 80) -> Column:
    """Of an array of (taxon, confidence): every rank at or above the threshold, later ones shifting left; the first rank if none is."""
    kept = F.filter(taxonomy, lambda x: x["confidence"] >= min_confidence)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(taxonomy, 1, 1))


def format_taxonomy(taxonomy: Column, n_levels: int = 6) -> Column:
    """``name(conf);...``, padded with ``{last}_unclassified`` at the last confidence; never truncated."""
    shown = F.transform(taxonomy, lambda x: F.concat(x["taxon"], F.lit("("), x["confidence"].cast("string"), F.lit(")")))
    last = F.element_at(taxonomy, -1)
    fill = F.array_repeat(F.concat(last["taxon"], F.lit("_unclassified("), last["confidence"].cast("string"), F.lit(")")), F.greatest(F.lit(n_levels) - F.size(taxonomy), F.lit(0)))
    return F.array_join(F.concat(shown, fill), ";")


def format_unsplit(lineage: Column, n_levels: int = 6, compat: bool = False) -> Column:
    """A plain lineage padded. ``compat`` pads with the lineage's last character instead of its last rank."""
    parts = F.split(lineage, ";")
    last = F.right(lineage, F.lit(1)) if compat else F.element_at(parts, -1)
    fill = F.array_repeat(F.concat(last, F.lit("_unclassified")), F.greatest(F.lit(n_levels) - F.size(parts), F.lit(0)))
    return F.array_join(F.concat(parts, fill), ";")


def strip_confidence(taxon: Column) -> Column:
    return F.regexp_replace(taxon, "\\(\\d+\\)", "")


def coded_lineage(names: Column, n_levels: int = 6) -> Column:
    """``k__...;p__...`` from an array of names."""
    codes = F.array(*[F.lit(f"{r[0].lower()}__") for r in RANKS[:n_levels]])
    return F.array_join(F.zip_with(codes, names, lambda c, x: F.concat(c, x)), ";")


def incertae_fill(ranks: list[Column]) -> Column:
    """Lineage of rank columns, a missing rank named after its parent with ``_incertae_sedis``, blanks as ``_``."""
    filled: list[Column] = []
    for i, r in enumerate(ranks):
        given = F.when(F.trim(r) != "", F.replace(F.trim(r), F.lit(" "), F.lit("_")))
        if i == 0:
            filled.append(F.coalesce(given, F.lit("incertae_sedis")))
        else:
            parent = F.regexp_replace(filled[-1], "_incertae_sedis$", "")
            filled.append(F.coalesce(given, F.concat(parent, F.lit("_incertae_sedis"))))
    return F.concat_ws(";", *filled)


def rank_field(text: Column, rank: str) -> Column:
    """The value of a ``rank__value;`` field, or null."""
    found = F.regexp_extract(text, f"(?:^|;)\\s*{rank}__([^;]*)", 1)
    return F.when(found != "", found)


def keys_to_int(pairs: Column) -> Column:
    return F.transform_keys(pairs, lambda k, _: k.cast("int"))


def sort_by(values: Column, order: Column) -> Column:
    """One array in the order of another (stable)."""
    indexed = F.transform(F.arrays_zip(order.alias("o"), values.alias("v")), lambda x, i: F.struct(x["o"].alias("o"), i.alias("i"), x["v"].alias("v")))
    return F.transform(F.array_sort(indexed), lambda x: x["v"])
