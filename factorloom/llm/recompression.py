"""Recompression of token sequences: equal substrings get equal symbols inside, wherever they stand.

Tokens are named by 64-bit hashes. First, runs of one token are named by the token and the run's length. Then rounds of pairing
follow: a bit of every name puts it on the left or the right side, and a left symbol followed by a right one becomes the name of
the two. Names and sides are functions of the content alone, so all tasks of all rounds agree on them without an exchange: the
naming is global. Symbols beyond ``LONGEST`` tokens pair no more, which keeps several of them inside a window.

Whether a symbol stands where it does depends on its own tokens and on some around it. The rounds carry that extent along, so it is
known exactly which symbols of a window must stand in every other occurrence of the window too. Of these, the one with the smallest
name stands for the window: it is the same one in every occurrence.

Several documents are parsed side by side, with the token ``SEPARATOR`` before, between and behind them. It never joins a symbol, and
an extent that reaches it lies in no window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from factorloom.llm.word_hashes import mix

ROUNDS = 8
LONGEST = 12


SEPARATOR = np.uint64(0)


@dataclass(frozen=True)
class Symbols:
    """Names, with the tokens they span and the extent ``[low, high)`` of tokens that fix them."""

    names: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def side_by_side(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all documents between separators, and the place where each document starts."""
    gap = np.array([SEPARATOR])
    lengths = np.array([len(d) for d in documents], np.int64)
    tokens = np.concatenate([gap, *(part for d in documents for part in (d, gap))])
    return tokens, np.cumsum(lengths + 1) - lengths


def _runs(tokens: np.ndarray) -> Symbols:
    """Each maximal run is a symbol; that it ends depends on the tokens beside it."""
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]).astype(np.int32)
    end = np.append(start[1:], np.int32(len(tokens)))
    length = (end - start).astype(np.uint64)
    names = np.where(length > 1, mix(tokens[start], length), tokens[start])
    return Symbols(names, start, end, start - 1, end + 1)


def _pairs(s: Symbols, number: int, longest: int) -> Symbols:
    side = (mix(s.names, np.uint64(number)) & np.uint64(1 << 40)) != 0
    able = (s.end - s.start <= longest) & (s.names != SEPARATOR)
    left, right = able & ~side, able & side
    joins = np.append(left[:-1] & right[1:], False)
    # A left symbol looks at the next one and a right symbol at the one before, whether they join or not.
    low, high = s.low.copy(), s.high.copy()
    low[1:][right[1:]] = np.minimum(s.low[1:], s.low[:-1])[right[1:]]
    high[:-1][left[:-1]] = np.maximum(s.high[:-1], s.high[1:])[left[:-1]]
    first = np.flatnonzero(np.append(True, ~joins[:-1]))
    joined = joins[first]
    last = first + joined
    names = s.names[first]
    names[joined] = mix(names[joined], s.names[last[joined]])
    return Symbols(names, s.start[first], s.end[last], np.minimum(low[first], s.low[last]), np.maximum(high[last], s.high[first]))


def recompress(tokens: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> Symbols:
    symbols = _runs(tokens)
    for number in range(1, rounds + 1):
        symbols = _pairs(symbols, number, longest)
    return symbols


def window_symbols(documents: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that one symbol stands for: ``document, first, end, name, known``.

    ``first`` and ``end`` count the windows of a document; ``known`` is false for windows that fix no symbol. Documents have at
    least ``window`` tokens.
    """
    tokens, places = side_by_side(documents)
    s = recompress(tokens)
    owner = np.searchsorted(places, s.start, side="right") - 1
    lengths = np.array([len(d) for d in documents], np.int64)
    floor, ceiling = places[owner], (places + lengths)[owner]
    first, end = np.maximum(s.high - window, floor), np.minimum(s.low, ceiling - window) + 1
    use = np.flatnonzero((s.low >= floor) & (s.high <= ceiling) & (first < end) & (s.names != SEPARATOR))
    use = use[np.argsort(s.names[use], kind="stable")[::-1]]
    # The smallest name is written last and so stays.
    chosen = np.full(len(tokens), -1, np.int64)
    for symbol, a, b in zip(use.tolist(), first[use].tolist(), end[use].tolist()):
        chosen[a:b] = symbol
    names = np.where(chosen >= 0, s.names[chosen], SEPARATOR)
    starts = np.concatenate([np.arange(p, p + n - window + 1) for p, n in zip(places, lengths)])
    document = np.repeat(np.arange(len(documents)), lengths - window + 1)
    held = names[starts]
    breaks = np.flatnonzero(np.r_[True, (held[1:] != held[:-1]) | (document[1:] != document[:-1])])
    ends = np.append(breaks[1:], len(starts))
    local = starts - places[document]
    return document[breaks], local[breaks], local[ends - 1] + 1, held[breaks], held[breaks] != SEPARATOR
