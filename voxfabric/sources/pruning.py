"""Filters on whole-number columns, kept by data sources to skip what can't match before it is opened."""

from __future__ import annotations

import operator
from collections.abc import Collection, Iterable, Iterator

from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

_COMPARE = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


class Wanted:
    """Conditions by column name; a column without one wants every value."""

    def __init__(self, names: Collection[str]):
        self.names, self.sets, self.bounds = set(names), {}, {}

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keeps the filters it can apply in full and gives back the others."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.names and isinstance(f, In):
                self.sets[name] = self.sets.get(name, set(f.value)) & set(f.value)
            elif name in self.names and type(f) in _COMPARE and isinstance(f.value, int):
                self.bounds.setdefault(name, []).append((_COMPARE[type(f)], f.value))
            else:
                yield f

    def __call__(self, name: str, value: int) -> bool:
        return (name not in self.sets or value in self.sets[name]) and all(op(value, b) for op, b in self.bounds.get(name, ()))

    def among(self, name: str, values: Iterable[int]) -> list[int]:
        return [v for v in values if self(name, v)]
