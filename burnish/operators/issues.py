"""What is odd about a column: rules over its counts, each with its own remark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: A column is mostly empty above this part of nulls, and looks like a key above this part of distinct values.
MOSTLY_EMPTY, NEARLY_UNIQUE = 50.0, 95.0


@dataclass(frozen=True)
class ColumnFacts:
    """The counts of one column; ``values`` are its distinct values with null as one, ``spellings`` those that casing may vary."""

    name: str
    rows: int
    nulls: int
    values: int
    spellings: int = 0
    folded: int = 0
    layouts: frozenset[str] = field(default_factory=frozenset)
    beyond: int = 0

    def part(self, n: int) -> float:
        return 100.0 * n / self.rows if self.rows else 0.0


def _empty(c: ColumnFacts) -> str | None:
    return f"{c.part(c.nulls):.0f} % of the cells are null" if c.part(c.nulls) > MOSTLY_EMPTY else None


def _repeated_key(c: ColumnFacts) -> str | None:
    named_key = "id" in c.name.lower()
    return f"named like a key, but {c.rows - c.values:,} rows repeat one" if named_key and NEARLY_UNIQUE < c.part(c.values) and c.values < c.rows else None


def _casings(c: ColumnFacts) -> str | None:
    return f"{c.spellings:,} spellings, {c.folded:,} without regard to casing" if c.folded < c.spellings else None


def _dates(c: ColumnFacts) -> str | None:
    return f"dates are written as {' and '.join(sorted(c.layouts))}" if len(c.layouts) > 1 else None


def _far(c: ColumnFacts) -> str | None:
    return f"{c.beyond:,} values lie beyond the quartile fences" if c.beyond else None


RULES: tuple[Callable[[ColumnFacts], str | None], ...] = (_empty, _repeated_key, _casings, _dates, _far)


def remarks(column: ColumnFacts) -> list[str]:
    """What the rules say about the column."""
    return [said for rule in RULES if (said := rule(column)) is not None]
