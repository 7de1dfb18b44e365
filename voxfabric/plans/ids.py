"""Reassignment of setup and attribute ids when data sets are merged.

The id tables have one row per setup, whatever the size of the images.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def free_ids(old: Iterable[int], used: Iterable[int]) -> dict[int, int]:
    """Each id, in order, to the first free one that is not smaller."""
    taken, out = set(used), {}
    for i in old:
        new = i
        while new in taken:
            new += 1
        taken.add(new)
        out[i] = new
    return out


def free_attribute_ids(old: Mapping[str, Iterable[int]], used: Mapping[str, Iterable[int]]) -> dict[str, dict[int, int]]:
    """The same for each attribute's entities."""
    return {name: free_ids(dict.fromkeys(ids), used.get(name, ())) for name, ids in old.items()}


def timepoint_offsets(extents: Iterable[tuple[int, int]]) -> list[int]:
    """First timepoint of each data set (first, last) when they follow each other: its own, or the next one free."""
    out, last = [], -1
    for first, end in extents:
        start = max(last + 1, first)
        out.append(start)
        last = start + end - first
    return out
