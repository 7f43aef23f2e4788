"""Results as text: a ruled table with a row count."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.functions.scalars import number_text


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(cell, value)) + "]"
    return str(value)


def table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    texts = [[cell(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in texts)]) for i, c in enumerate(columns)]
    rule = lambda left, mid, right: left + mid.join("─" * (w + 2) for w in widths) + right
    line = lambda r: "│" + "│".join(f" {x.ljust(w)} " for x, w in zip(r, widths, strict=True)) + "│"
    body = [line(r) for r in texts]
    count = f"({len(rows)} row{'' if len(rows) == 1 else 's'})"
    return "\n".join([rule("┌", "┬", "┐"), line(columns), rule("├", "┼", "┤"), *body, rule("└", "┴", "┘"), count])
