"""Operators beyond one Spark call: joins on time, windows, changelogs, map-reduce, placement."""
