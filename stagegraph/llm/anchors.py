"""Content-defined anchors: every window of W tokens owns exactly one anchor, chosen from the window's content alone.

A window's anchor is the leftmost k-gram of least hash inside it, so equal windows have equal anchors at equal offsets. Windows that
share an anchor occurrence are consecutive; that occurrence *owns* the run of window starts ``[first, first + count)`` and the tokens
``[first, first + count + W - 1)``.
"""

from __future__ import annotations

import numpy as np

from stagegraph.llm.tokens import mix, span_hashes

_TOP, _LOW = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)


def owned_runs(values: np.ndarray, bounds: np.ndarray, k: int, width: int) -> tuple[np.ndarray, ...]:
    """values: tokens of concatenated documents; bounds: their n+1 offsets.

    Returns (document index, hash, first window start in the document, number of windows owned), ordered by position. Documents with
    fewer than ``width`` tokens have no windows.
    """
    none = np.zeros(0, dtype=np.int64)
    n, w = len(values), width - k + 1
    if n < width:
        return none, none.astype(np.uint64), none, none
    if n > int(_LOW):  # a very long document alone: two parts that overlap by what the windows across the cut need
        cut = n // 2
        parts = owned_runs(values[: cut + width - 1], np.array([0, cut + width - 1]), k, width), owned_runs(values[cut:], np.array([0, n - cut]), k, width)
        return tuple(np.concatenate((x, y + cut * (i == 2))) for i, (x, y) in enumerate(zip(*parts, strict=True)))
    at = np.arange(n - k + 1)
    grams = span_hashes(values, at, at + k)
    low = (mix(grams) & _TOP) | at.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    anchor = (low & _LOW).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
    whole = np.arange(len(anchor)) + width <= bounds[doc + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    return doc[first], grams[anchor[first]], first - bounds[doc[first]], count
