"""Windows of loaded samples with their figures, from one pass over the chunks of a series.

A chunk is cut into stretches of loaded and other samples and summed up in a few segments: what lies between two windows
of a chunk is final there; the stretches up to its first and from its last window on may still join those of the
neighbouring chunks. Segments add up (sums, largest and least values), so the run-wide step sees at most seven rows per
chunk and series, and no sample is joined back to a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import written
from .series import RUN, chunk_of

LOADED, OTHER, CUT, DONE = 1, 0, -1, 2
SEGMENT = (
    "run_id string, label string, kind int, start_idx long, end_idx long, least long, gap long, "
    "sums array<double>, peaks array<double>, lows array<double>"
)


@dataclass
class Series:
    """One series of a chunk: which samples are loaded, and the columns to add up over a window.

    ``least``: samples that a window must have; ``gap``: index distance up to which windows join.
    """

    label: str
    loaded: Any
    least: int
    gap: int
    sums: list = field(default_factory=list)
    peaks: list = field(default_factory=list)
    lows: list = field(default_factory=list)


def measured_windows(
    rows: DataFrame, series: Callable[[Any], Iterable[Series]], names: dict[str, list[str]], joins_first: bool = False
) -> DataFrame:
    """run_id, label, start_idx, end_idx and the figures ``names`` (of sums, peaks, lows) of every window.

    ``rows``: run_id, idx and what ``series`` reads; it gets the samples of a chunk in order. Stretches shorter than
    ``least`` are dropped before windows are joined, or after it with ``joins_first``.
    """

    def chunk(frame):
        import pandas as pd

        frame = frame.sort_values("idx")
        run, base = frame["run_id"].iloc[0], int(frame["idx"].iloc[0])
        out = []
        for one in series(frame):
            parts = stretches(one, joins_first)
            figures = measured(one, parts)
            out += [(run, one.label, kind, base + a, base + b, one.least, one.gap, *f) for (kind, a, b), f in zip(parts, figures, strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    def whole(frame):
        import pandas as pd

        frame = frame.sort_values("start_idx")
        run, label, least, gap = (frame[c].iloc[0] for c in ("run_id", "label", "least", "gap"))
        parts = [list(p) for p in zip(*(frame[c] for c in ("kind", "start_idx", "end_idx", "sums", "peaks", "lows")), strict=True)]
        out = [(run, label, DONE, a, b, least, gap, *f) for _, a, b, *f in joined(parts, least, gap, joins_first)]
        return pd.DataFrame(out, columns=frame.columns)

    parts = written(rows.withColumn("_chunk", chunk_of("idx")).groupBy(*RUN, "_chunk").applyInPandas(chunk, SEGMENT))
    done = F.col("kind") == DONE
    windows = parts.filter(~done).groupBy("run_id", "label").applyInPandas(whole, SEGMENT).unionByName(parts.filter(done))
    value = lambda c: F.when(~F.isnan(c), c)
    figures = [value(F.col(kind)[i]).alias(n) for kind, listed in names.items() for i, n in enumerate(listed)]
    return windows.select("run_id", "label", "start_idx", "end_idx", *figures)


def stretches(one: Series, joins_first: bool) -> list[tuple[int, int, int]]:
    """Kind, first and last sample of a chunk's segments, in order; those that are `DONE` lie inside a `CUT`."""
    import numpy as np

    n = len(one.loaded)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(one.loaded, np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2] - 1
    fits = np.full(len(starts), joins_first) | (ends - starts + 1 >= one.least)
    first, last = starts[fits], ends[fits]
    far = np.flatnonzero(first[1:] - last[:-1] > one.gap)
    first, last = first[np.concatenate([[0], far + 1])[: len(first)]], last[np.concatenate([far, [len(last) - 1]])[: len(last)]]
    windows = list(zip(first.tolist(), last.tolist(), strict=True))
    marked = [(LOADED, a, b) for a, b in (windows if len(windows) < 3 else [windows[0], windows[-1]])]
    # A stretch at the border that is too short so far may go on in the next chunk.
    marked += [(LOADED, int(a), int(b)) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k in (0, len(starts) - 1) and not fits[k] and (a == 0 or b == n - 1)]
    out, at = [], 0
    for kind, a, b in sorted(set(marked), key=lambda s: s[1]):
        if a > at:
            cut = len(windows) > 2 and a == windows[-1][0]
            out.append((CUT if cut else OTHER, at, a - 1))
        out.append((kind, a, b))
        at = b + 1
    if at < n:
        out.append((OTHER, at, n - 1))
    return out + [(DONE, a, b) for a, b in windows[1:-1] if b - a + 1 >= one.least]


def measured(one: Series, parts: list[tuple[int, int, int]]) -> list[tuple[list, list, list]]:
    """Sums, largest and least values of each segment."""
    import numpy as np

    at = np.array([(a, b + 1) for _, a, b in parts]).ravel()

    def over(how, columns):
        padded = (np.concatenate([np.asarray(c, np.float64), [0.0]]) for c in columns)
        return np.array([how.reduceat(c, at)[::2] for c in padded]).T.reshape(len(parts), len(columns)).tolist()

    return list(zip(over(np.add, one.sums), over(np.fmax, one.peaks), over(np.fmin, one.lows), strict=True))


def added(a: list, b: list) -> list:
    """Two neighbouring segments as one of the kind of the first."""
    pick = lambda better, x, y: y if x != x or y == y and better(x, y) == y else x
    return [
        a[0], min(a[1], b[1]), max(a[2], b[2]), [x + y for x, y in zip(a[3], b[3], strict=True)],
        [pick(max, x, y) for x, y in zip(a[4], b[4], strict=True)], [pick(min, x, y) for x, y in zip(a[5], b[5], strict=True)],
    ]


def joined(parts: list[list], least: int, gap: int, joins_first: bool) -> list[list]:
    """Windows of the segments of a whole series, which are in order."""
    out: list[list] = []
    line: list[list] = []
    for part in parts:
        if line and part[0] == line[-1][0] == LOADED:
            line[-1] = added(line[-1], part)
        else:
            line.append(part)
    if not joins_first:
        line = [[OTHER, *p[1:]] if p[0] == LOADED and p[2] - p[1] + 1 < least else p for p in line]
    window = between = None
    for part in [*line, [CUT, 0, 0]]:
        if part[0] == OTHER:
            between = added(between, part) if between else part
        elif part[0] == LOADED and window and part[1] - window[2] <= gap:
            window = added(added(window, between) if between else window, part)
            between = None
        else:
            if window and window[2] - window[1] + 1 >= least:
                out.append(window)
            window, between = (part if part[0] == LOADED else None), None
    return out

