"""Fixed-width lines for the command line; a row is as wide as its header."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def table(header: Sequence[str], rows: Iterable[Sequence[object]], digits: int = 4) -> str:
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else "-" if x is None else str(x)
    cells = [[show(x) for x in r] for r in rows]
    width = [max(len(h), *(len(r[k]) for r in cells)) if cells else len(h) for k, h in enumerate(header)]
    line = lambda r: "  ".join(f"{x:<{w}}" if k == 0 else f"{x:>{w}}" for k, (x, w) in enumerate(zip(r, width, strict=True)))
    return "\n".join([line(header), *map(line, cells)])
