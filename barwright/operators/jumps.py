"""Resetting sums by jumps from one fire to the next.

A one-sided sum that is kept above zero is its running total less the least total so far, so the next fire is the first
place where that exceeds the limit: found by vector operations on stretches of growing length.  Python takes a step per
fire, not per row.  For a block of rows with an unknown sum at its beginning, every row's next fire is found at once and
pointers are doubled, which tells what the block makes of any incoming sum.
"""

from __future__ import annotations

import numpy as np

#: Rows looked at first; doubled while nothing fires.
STRETCH, LONGEST = 64, 1 << 16


def upward(steps: np.ndarray, limit: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Where max(0, sum + step) exceeds the limit, and the sum at the end; a fire and a missing step leave 0 behind."""
    fires, at, size = np.zeros(len(steps), bool), 0, STRETCH
    while at < len(steps):
        part = steps[at:at + size]
        gap = np.flatnonzero(np.isnan(part))
        part = part[:gap[0]] if len(gap) else part
        run = np.cumsum(part)
        above = run - np.minimum(np.minimum.accumulate(run), -total) if len(run) else run
        hit = np.flatnonzero(above > limit[at:at + len(part)])
        if len(hit):
            fires[at + hit[0]] = True
            at, total, size = at + hit[0] + 1, 0.0, STRETCH
        elif len(gap):
            at, total = at + len(part) + 1, 0.0
        else:
            at, total, size = at + len(part), float(above[-1]), min(2 * size, LONGEST)
    return fires, total


def either(steps: np.ndarray, limit: np.ndarray, up: float, down: float) -> tuple[np.ndarray, float, float]:
    """Where one of both sums passes a limit of its own row; a fire sets both to 0, a missing step too."""
    fires, at, size = np.zeros(len(steps), bool), 0, STRETCH
    while at < len(steps):
        part = steps[at:at + size]
        gap = np.flatnonzero(np.isnan(part))
        part = part[:gap[0]] if len(gap) else part
        run, bar = np.cumsum(part), limit[at:at + len(part)]
        above = run - np.minimum(np.minimum.accumulate(run), -up) if len(run) else run
        below = run - np.maximum(np.maximum.accumulate(run), -down) if len(run) else run
        hit = np.flatnonzero((above > bar) | (below < -bar))
        if len(hit):
            fires[at + hit[0]] = True
            at, up, down, size = at + hit[0] + 1, 0.0, 0.0, STRETCH
        elif len(gap):
            # A missing step makes both sums 0, which a negative limit would let fire.
            fires[at + len(part)] = limit[at + len(part)] < 0.0
            at, up, down = at + len(part) + 1, 0.0, 0.0
        else:
            at, up, down, size = at + len(part), float(above[-1]), float(below[-1]), min(2 * size, LONGEST)
    return fires, up, down


def next_fires(total: np.ndarray, limit: float) -> np.ndarray:
    """For running totals (the first is 0) the place where a sum that is 0 at a place fires next; their number if never."""
    n = len(total)
    first = np.full(n, n)
    for a in range(1, n, 256):
        z = min(a + 256, n)
        lower = total[None, :z] < (total[a:z, None] - limit)
        lower &= np.arange(z)[None, :] < np.arange(a, z)[:, None]
        some = np.flatnonzero(lower.any(axis=1))
        latest = z - 1 - np.argmax(lower[some, ::-1], axis=1)  # starts up to here fire here, if not before
        np.minimum.at(first, latest, a + some)
    return np.minimum.accumulate(first[::-1])[::-1]


def block_effect(steps: np.ndarray, limit: float) -> dict[str, list[float]]:
    """What a block makes of an incoming sum: new lows and highs of its running total, each with its place and the sum at
    the end of the block if the incoming one is cleared there, and the total."""
    total = np.concatenate([[0.0], np.cumsum(steps)])
    n = len(total)
    following = next_fires(total, limit)
    last = np.where(following < n, following, np.arange(n))  # the last fire after a place, by doubled pointers
    while ((further := last[last]) != last).any():
        last = further
    lowest = np.minimum.accumulate(total[::-1])[::-1]
    ends = total[-1] - lowest[last]
    falls = np.flatnonzero(total[1:] < np.minimum.accumulate(total)[:-1]) + 1
    rises = np.flatnonzero(total[1:] > np.maximum.accumulate(total)[:-1]) + 1
    return {"low": (-total[falls]).tolist(), "low_at": falls.astype(float).tolist(), "low_end": ends[falls].tolist(),
            "high": total[rises].tolist(), "high_at": rises.astype(float).tolist(), "high_end": ends[rises].tolist(), "total": [float(total[-1])]}


def after_block(effect: dict[str, np.ndarray], entering: float, limit: float) -> float:
    """The sum behind a block: it is cleared where the total first falls by it or first rises beyond the limit."""
    cleared = np.searchsorted(effect["low"], entering, side="left")
    fired = np.searchsorted(effect["high"], limit - entering, side="right")
    clear_at = effect["low_at"][cleared] if cleared < len(effect["low"]) else np.inf
    fire_at = effect["high_at"][fired] if fired < len(effect["high"]) else np.inf
    if clear_at == fire_at == np.inf:
        return float(entering + effect["total"][0])
    return float(effect["low_end"][cleared] if clear_at < fire_at else effect["high_end"][fired])
