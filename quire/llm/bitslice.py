"""Bit-sliced Hamming comparison of 64-bit fingerprints inside cells.

Fingerprints stand in cell order. Bit plane b holds bit b of 64 neighbouring fingerprints in one machine word (a block).
A query is compared with a block by adding its 64 difference planes into vertical counters: three planes go through a
full adder (carry save), sum and carry then ripple into the counter planes. The counters start so high that they
overflow exactly when a distance exceeds the radius; an overflow kills its lane, and a block whose lanes are all dead
is abandoned. One pass serves many (query, block) pairs at once as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BELOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: (query, block) pairs handled at once.
PAIRS = 1 << 13
#: Planes between two looks at which blocks are still alive.
LOOK = 12


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """uint64 (64, blocks): word w of plane b has bit b of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.packbits(bits.T.reshape(64, -1, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view("<u8").reshape(64, -1)


def _add(counter: list[np.ndarray], carry: np.ndarray, at: int) -> np.ndarray:
    """Adds one bit per lane with weight 2**at; returns the overflow."""
    for k in range(at, len(counter)):
        carry, counter[k] = counter[k] & carry, counter[k] ^ carry
    return carry


def _compare(planes: np.ndarray, fps: np.ndarray, q: np.ndarray, w: np.ndarray, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = max(2, int(radius).bit_length())
    start = (1 << size) - 1 - radius
    counter = [np.full(len(q), _ALL if start >> k & 1 else 0, dtype=np.uint64) for k in range(size)]
    value = fps[q]

    def differ(b: int) -> np.ndarray:
        return planes[b][w] ^ (np.uint64(0) - (value >> np.uint64(b) & np.uint64(1)))

    for b in range(0, 64, 3):
        if b == 63:
            dead = _add(counter, differ(63), 0)
        else:
            x, y, z = differ(b), differ(b + 1), differ(b + 2)
            xy = x ^ y
            dead = _add(counter, xy ^ z, 0)
            dead |= _add(counter, (x & y) | (z & xy), 1)
        live &= ~dead
        if b % LOOK == LOOK - 3:
            stay = np.flatnonzero(live)
            if len(stay) < 0.75 * len(live):
                q, w, live, value = q[stay], w[stay], live[stay], value[stay]
                counter = [c[stay] for c in counter]
                if not len(stay):
                    break
    stay = np.flatnonzero(live)
    return q[stay], w[stay], live[stay]


def close_pairs(cells: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of index pairs (a, b), a < b, in one cell and at most ``radius`` bits apart. ``cells`` is sorted."""
    n = len(fps)
    if n < 2:
        return
    fps = fps.astype(np.uint64, copy=False)
    ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    rows = np.flatnonzero(end - np.arange(n) > 1)
    if not len(rows):
        return
    planes = bit_planes(fps)
    first = (rows + 1) // 64
    each = (end[rows] - 1) // 64 - first + 1
    total = np.cumsum(each)
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        k = each[at:to]
        q = np.repeat(rows[at:to], k)
        w = np.repeat(first[at:to], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
        live = _BELOW[np.clip(end[q] - 64 * w, 0, 64)] & ~_BELOW[np.clip(q + 1 - 64 * w, 0, 64)]
        q, w, live = _compare(planes, fps, q, w, live, radius)
        if len(q):
            row, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], w[row] * 64 + lane
        at = to


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] for every i; ``label`` maps a row to its class's first row."""
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
