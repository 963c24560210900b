"""Durations and sizes as text."""

from __future__ import annotations

import re
from datetime import timedelta

from tidewright.errors import EngineError

# Units of durations in milliseconds and of sizes in bytes.
UNITS = {"ms": 1, "millisecond": 1, "s": 1000, "sec": 1000, "second": 1000, "m": 60_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000, "w": 604_800_000, "week": 604_800_000}
SIZES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


def milliseconds(value: int | str | timedelta) -> int:
    """An int counts milliseconds; a text has a number and a unit from ms to weeks."""
    if isinstance(value, bool):
        raise EngineError("a duration can't be a boolean")
    if isinstance(value, timedelta):
        return int(value.total_seconds() * 1000)
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", value)
    unit = (m[2].lower() or "ms") if m else ""
    unit = unit if unit in UNITS else unit.rstrip("s")
    if m is None or unit not in UNITS:
        raise EngineError(f"{value!r} is no duration")
    return int(float(m[1]) * UNITS[unit])


def size_bytes(value: int | str) -> int:
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", value)
    if m is None or (m[2].lower() or "b") not in SIZES:
        raise EngineError(f"{value!r} is no size")
    return int(float(m[1]) * SIZES[m[2].lower() or "b"])
