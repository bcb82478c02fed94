"""Immutable rows for callbacks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any


class Row(Mapping):
    """A mapping from names to values; changes give new rows."""

    __slots__ = ("_values",)

    def __init__(self, values: Mapping[str, Any] | None = None, **more: Any):
        self._values = {**(values or {}), **more}

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def __repr__(self) -> str:
        return f"Row({self._values!r})"

    def update(self, patch: Mapping[str, Any] | None = None, **more: Any) -> Row:
        """A row with new values; keyword values win over the patch."""
        return Row({**self._values, **(patch or {}), **more})

    def drop(self, *names: str) -> Row:
        """A row without the names; names it does not have are passed over."""
        return Row({k: v for k, v in self._values.items() if k not in names})

    def pop(self, name: str, *default: Any) -> tuple[Any, Row]:
        """The value of a name, and a row without it."""
        if name not in self._values and not default:
            raise KeyError(name)
        return self._values.get(name, *default), self.drop(name)

    def to_dict(self) -> dict[str, Any]:
        return dict(self._values)
