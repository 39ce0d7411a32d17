"""Hashes of the words of many texts at once, in numpy.

Words are cut from the UTF-8 bytes by a table of 256 flags. A word's hash is a
polynomial over its bytes modulo 2**64, read from running sums, so a batch
costs a few passes over its bytes and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}
WINDOW = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = held = np.multiply.accumulate(steps)
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _long_word(word: np.ndarray, n: int) -> np.uint64:
    """Running sum of the first ``n`` bytes of a word of any length, in parts."""
    total, start = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, n, WINDOW):
        part = word[at : min(n, at + WINDOW)]
        total += start * (_BYTES[part] * _power(_BASE, len(part))[: len(part)]).sum(dtype=np.uint64)
        start *= np.array([pow(_BASE, len(part), 1 << 64)], np.uint64)
    return total


def _windows(data: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, alone) of slices of at most WINDOW bytes that cut no word;
    a longer word is a slice alone."""
    at, size = 0, len(data)
    while at < size:
        stop = min(size, at + WINDOW)
        if stop < size and not gap[data[stop]]:
            blank = np.flatnonzero(gap[data[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:
                while stop < size and not (later := gap[data[stop : stop + WINDOW]]).any():
                    stop = min(size, stop + WINDOW)
                stop += int(later.argmax()) if stop < size else 0
                yield at, stop, True
                at = stop
                continue
        yield at, stop, False
        at = stop


def _window_hashes(data: np.ndarray, gap: np.ndarray, prefixes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(hashes, where each word starts)] of the words of a slice and of their prefixes."""
    blank = gap[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    back = _power(_INVERSE, len(data))[starts]
    out = [(mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64)), starts)]
    for n in prefixes:
        long_ = np.flatnonzero(ends - starts > n)
        at = starts[long_]
        out.append((mix((sums[at + n] - sums[at]) * back[long_] + np.uint64(n + 7919)), at))
    return out


def word_hashes(texts: list[bytes], gap: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(hashes, text of each, prefix hashes) of all words of ``texts``.

    ``prefixes`` asks for hashes of the first n bytes of the words that have
    more; each is (hashes, text of each). Memory beyond the texts and hashes
    has a bound, as the bytes are read in slices of WINDOW.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for _ in range(1 + len(prefixes))]
    for start, stop, alone in _windows(data, gap):
        if alone:
            part, n = data[start:stop], stop - start
            got = [(mix(_long_word(part, n) + np.uint64(n)), np.zeros(1, np.int64))]
            got += [(mix(_long_word(part, p) + np.uint64(p + 7919)), np.zeros(1, np.int64)) for p in prefixes]
        else:
            got = _window_hashes(data[start:stop], gap, prefixes)
        for held, (hashes, at) in zip(found, got, strict=True):
            held.append((hashes, np.searchsorted(stops, at + start, side="right")))
    joined = [(np.concatenate([h for h, _ in held]), np.concatenate([o for _, o in held])) for held in found]
    return *joined[0], joined[1:]


def by_text(owner: np.ndarray, texts: int) -> Iterator[slice]:
    """The slice of each text in arrays ordered by ``owner``."""
    edges = np.searchsorted(owner, np.arange(texts + 1))
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))
