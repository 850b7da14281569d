"""Functions on ordered lists of tools: arrays in, arrays or numbers out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a known misspelling in the corpus.
ALIASES = {"g'et_item_info": "get_item_info"}


def minus(a: Column, b: Column) -> Column:
    """The elements of a that b lacks, in order, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def is_unique(a: Column) -> Column:
    return F.size(a) == F.size(F.array_distinct(a))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def inversions(gold: Column, shown: Column) -> Column:
    """Pairs of gold tools that the shown list has in the other order."""
    at = F.filter(F.transform(gold, lambda g: F.array_position(shown, g)), lambda p: p > 0)
    later = F.transform(at, lambda p, i: F.size(F.filter(F.slice(at, i + 2, F.size(at)), lambda q: q < p)))
    return F.aggregate(later, F.lit(0), lambda s, x: s + x)


def swap_next(a: Column, i: Column) -> Column:
    """Elements i and i + 1 (from 1) exchanged."""
    return F.concat(F.slice(a, 1, i - 1), F.slice(a, i + 1, 1), F.slice(a, i, 1), F.slice(a, i + 2, F.size(a)))


def delete_at(a: Column, i: Column) -> Column:
    return F.concat(F.slice(a, 1, i - 1), F.slice(a, i + 1, F.size(a)))


def insert_at(a: Column, i: Column, x: Column) -> Column:
    return F.concat(F.slice(a, 1, i - 1), F.array(x), F.slice(a, i, F.size(a)))


def replace_at(a: Column, i: Column, x: Column) -> Column:
    return F.concat(F.slice(a, 1, i - 1), F.array(x), F.slice(a, i + 1, F.size(a)))


def unalias(a: Column, aliases: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (aliases or ALIASES).items() for x in kv])
    return F.transform(a, lambda t: F.coalesce(F.element_at(table, t), t))


def as_list(string: Column, array: Column) -> Column:
    """A field that holds a list, or else one string."""
    return F.coalesce(array, F.when(string.isNotNull(), F.array(string)))
