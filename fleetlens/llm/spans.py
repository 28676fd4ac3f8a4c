"""Spans of findings in a text: kept as three arrays (kinds, starts, ends; code points, end exclusive), ordered by start,
then by the kind's place in a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "kinds array<string>, starts array<int>, ends array<int>"
Span = tuple[int, int, str, int]  # start, place of the kind, kind, end


def columns(found: list[list[Span]]) -> dict[str, list]:
    ordered = [sorted(f) for f in found]
    return {"kinds": [[s[2] for s in f] for f in ordered], "starts": [[s[0] for s in f] for f in ordered], "ends": [[s[3] for s in f] for f in ordered]}


def count(spans: str, kind: str) -> Column:
    return F.expr(f"CAST(size(filter({spans}.kinds, k -> k = '{kind}')) AS BIGINT)")


def joined(spans: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined; of the given kinds only."""
    items = f"transform({spans}.kinds, (k, i) -> named_struct('k', k, 's', concat_ws(':', k, {spans}.starts[i], {spans}.ends[i])))"
    chosen = f"filter({items}, x -> x.k IN ({', '.join(map(repr, kinds))}))" if kinds else items
    return F.expr(f"array_join(transform({chosen}, x -> x.s), ',')")


def replaced(text: str, kinds: list[str], starts: list[int], ends: list[int]) -> str:
    """The text with each span as <kind>; of overlapping spans, the first names the whole stretch."""
    out, at, until = [], 0, -1
    for kind, a, b in zip(kinds, starts, ends, strict=True):
        if a >= until:
            out += [text[at:a], f"<{kind}>"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])
