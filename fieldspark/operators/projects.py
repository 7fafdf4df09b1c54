"""Fields by id: a project holds fitted fields in the order in which they were given and evaluates them by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldspark.errors import InputError
from fieldspark.operators.fields import FittedField


@dataclass(frozen=True)
class Project:
    """(id, field) pairs: at least one, ids that are not blank and do not repeat."""

    fields: tuple[tuple[str, FittedField], ...]

    def __post_init__(self):
        names = self.names
        if not names or any(not n.strip() for n in names) or len(set(names)) < len(names):
            raise InputError("a project needs fields with ids of their own", ids=names)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields]

    def field(self, name: str) -> FittedField:
        for own, field in self.fields:
            if own == name:
                return field
        raise InputError("no such field", id=name)

    def reference(self, name: str, points: DataFrame, columns: Sequence[str] | None = None, order: int = 0) -> DataFrame:
        """points with the value, gradient and Hessian of a field, as columns that begin with its id."""
        return self.field(name).evaluate(points, columns, order, name)

    def evaluate(self, points: DataFrame, columns: Sequence[str] | None = None, order: int = 0) -> DataFrame:
        """points with the columns of every field, in the project's order: a map, nothing is shuffled."""
        for name in self.names:
            points = self.reference(name, points, columns, order)
        return points
