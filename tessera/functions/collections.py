"""Maps as in hstore, integer arrays as in intarray."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Maps of strings.


def hstore(keys: Column, values: Column) -> Column:
    """A map of two arrays; of repeated keys the first counts, null keys are left out."""
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull())
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda d: d["k"] == e["k"]))
    return F.map_from_entries(first)


def hstore_get(h: Column, key: Column | str) -> Column:
    return F.try_element_at(h, F.lit(key) if isinstance(key, str) else key)


def hstore_get_all(h: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.try_element_at(h, k))


def hstore_concat(a: Column, b: Column) -> Column:
    """Both maps' entries, the second's where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def hstore_has(h: Column, key: str) -> Column:
    return F.map_contains_key(h, key)


def hstore_defined(h: Column, key: str) -> Column:
    return F.coalesce(hstore_get(h, key).isNotNull(), F.lit(False)) & h.isNotNull()


def hstore_delete(h: Column, keys: Column) -> Column:
    return F.map_filter(h, lambda k, v: ~F.array_contains(keys, k))


def hstore_delete_pairs(h: Column, other: Column) -> Column:
    return F.map_filter(h, lambda k, v: ~(F.map_contains_key(other, k) & F.try_element_at(other, k).eqNullSafe(v)))


def hstore_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def hstore_slice(h: Column, keys: Column) -> Column:
    return F.map_filter(h, lambda k, v: F.array_contains(keys, k))


def hstore_keys(h: Column) -> Column:
    return F.array_sort(F.map_keys(h))


def hstore_values(h: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(hstore_keys(h), lambda k: F.element_at(h, k))


def hstore_matrix(h: Column) -> Column:
    return F.transform(hstore_keys(h), lambda k: F.array(k, F.element_at(h, k)))


def hstore_to_json(h: Column) -> Column:
    return F.to_json(h, {"ignoreNullFields": "false"})


# Arrays of integers.


def icount(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def sort(a: Column, descending: bool = False) -> Column:
    return F.sort_array(a, not descending)


def uniq(a: Column) -> Column:
    """Leaves out elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.try_element_at(a, F.when(i > 0, i).otherwise(1))))


def idx(a: Column, x: Column) -> Column:
    """The 1-based place of an element, 0 if it isn't there."""
    return F.array_position(a, x).cast("int")


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    """Counts from 1, from the end if ``start`` is negative; a negative length leaves out so many at the end."""
    first = F.greatest(F.size(a) + start + 1, F.lit(1)) if start < 0 else F.lit(max(start, 1))
    left = F.size(a) - first + 1
    n = left if length is None else left + length if length < 0 else F.least(F.lit(length), left)
    return F.slice(a, first, F.greatest(n, F.lit(0)))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def without(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def contains(a: Column, b: Column) -> Column:
    return F.forall(b, lambda x: F.array_contains(a, x))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)
