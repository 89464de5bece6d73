"""File masks whose # signs stand for the digits of a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled_mask(mask: str, number: Column) -> Column:
    """The mask with a zero-padded number dealt over all its # signs from the left."""
    parts = mask.split("#")
    digits = F.lpad(number.cast("string"), len(parts) - 1, "0")
    out = [F.lit(parts[0])]
    for k, part in enumerate(parts[1:]):
        out += [F.substring(digits, k + 1, 1), F.lit(part)]
    return F.concat(*out)


def file_names(mask: str) -> list[str]:
    """All expansions of a mask, in order."""
    parts = mask.split("#")
    n = len(parts) - 1
    return ["".join(p + c for p, c in zip(parts, f"{k:0{n}d}" if n else "", strict=False)) + parts[-1] for k in range(10**n)]
