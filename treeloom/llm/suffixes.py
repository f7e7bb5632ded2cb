"""Suffix order, wavelet matrix and an FM-index over integer symbols, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_ranks(first: np.ndarray, depth: int, ended: np.ndarray) -> np.ndarray:
    """Rank of every suffix, by doubling the compared depth.

    ``first`` has a key for each suffix that orders it by its first ``depth``
    symbols up to a terminator; ``ended`` marks those that meet one, whose
    equals go by position.  Only suffixes that are still equal to another are
    sorted again.
    """
    n = len(first)
    order = np.argsort(first)
    done = np.flatnonzero(ended[order])
    short = order[done]
    order[done] = short[np.lexsort((short, first[short]))]
    rank = np.empty(n, np.int64)
    at, slot, group = _regroup(order, np.arange(n), first[order], rank, ended[order])
    while len(at):
        key = (group << 32) | rank[at + depth]
        order = np.argsort(key)
        at, slot, group = _regroup(at[order], slot, key[order], rank)
        depth *= 2
    return rank


def _regroup(at: np.ndarray, slot: np.ndarray, key: np.ndarray, rank: np.ndarray, ended: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Give the suffixes ``at``, sorted by ``key`` into the places ``slot``, the place of the first of their equals.

    Those that have equals are returned, with their places and ranks.
    """
    fresh = np.empty(len(at), bool)
    fresh[:1] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    if ended is not None:
        fresh |= ended
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(at)))
    new = np.repeat(slot[starts], sizes)
    rank[at] = new
    more = np.repeat(sizes > 1, sizes)
    return at[more], slot[more], new[more]


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` ones."""
        low = np.zeros_like(at)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            up, down = ones[at], ones[low]
            at = np.where(bit, zeros + up, at - up)
            low = np.where(bit, zeros + down, low - down)
        return at - low


class FmIndex:
    """FM-index of a text of symbols from 1 up; each 0 is a terminator of its own, and the last symbol is one."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        text = text.astype(np.int64)
        n = len(text)
        place = np.arange(n)
        ends = text == 0
        rank = suffix_ranks(text, 1, ends)
        sa = np.empty(n, np.int64)
        sa[rank] = place
        before = text[sa - 1]  # the first suffix wraps to the last terminator
        self.wavelet = WaveletMatrix(before)
        self.bwt = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=2))])
        # A walk stops at a sampled suffix; those after a terminator are sampled, so it never steps over one.
        held = (sa % sample == 0) | (before == 0)
        self.held_rank = np.concatenate([[0], np.cumsum(held)])
        self.held, self.samples = held, sa[held]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the row ranges of patterns of one length, a row each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        known = len(self.first) - 1
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            live = live[symbol < known]
            symbol = symbol[symbol < known]
            start = self.first[symbol]
            lo = start + self.wavelet.rank(symbol, low[live])
            hi = start + self.wavelet.rank(symbol, high[live])
            low[:], high[:], last = 0, 0, live
            low[last], high[last] = lo, hi
            live = last[lo < hi]
        done = np.zeros(len(patterns), bool)
        done[live] = True
        return np.where(done, low, 0), np.where(done, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking to the next sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        open_at, steps = np.arange(len(rows)), 0
        while len(open_at):
            at = rows[open_at]
            here = self.held[at]
            out[open_at[here]] = self.samples[self.held_rank[at[here]]] + steps
            open_at, at = open_at[~here], at[~here]
            symbol = self.bwt[at]
            rows = rows.copy()
            rows[open_at] = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of byte strings, with common-prefix samples at the ends of its runs.

    Every string ends in a terminator of its own.  Within a run, a step to the
    preceding byte lengthens the match with the neighbouring suffix by one; at
    the ends of a run it is sampled.  So the statistics of all matches stream
    from the runs alone, a step of all strings at a time.
    """

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.lengths = lengths
        text = np.frombuffer(b"\xff".join(strings) + b"\xff" * 9, np.uint8)
        text = np.where(text == 255, 0, text + 1).astype(np.uint8)  # no byte of UTF-8 is 255
        n = int(lengths.sum()) + len(strings)
        ends = np.cumsum(lengths + 1) - 1
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols before the terminator
        key = np.ndarray((n,), ">u8", buffer=text.tobytes(), strides=(1,)).astype(np.uint64)
        ended = left < 8
        keep = left[ended].astype(np.uint64)
        key[ended] &= ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * keep) % np.uint64(64)) - np.uint64(1)) * (keep > 0)
        rank = suffix_ranks(key, 8, ended)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = text[sa - 1]  # the first suffix wraps around to a terminator
        bwt[sa == 0] = 0
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        self.run_starts = np.flatnonzero(head)
        self.run_lengths = np.diff(np.append(self.run_starts, n))
        self.run_symbols = bwt[self.run_starts]
        # Where the first row of each run goes.
        order = np.argsort(self.run_symbols, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.cumsum(self.run_lengths[order]) - self.run_lengths[order]
        self.to = to
        last = to + self.run_lengths - 1
        self.above = self._common(text, sa, left, to, to - 1)
        self.below = self._common(text, sa, left, last, last + 1)
        self.begin = rank[ends]

    @staticmethod
    def _common(text: np.ndarray, sa: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes of rows ``a`` and ``b``, 0 where there is no row ``b``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero((b >= 0) & (b < len(sa)))
        x, y = sa[a[live]], sa[b[live]]
        most = np.minimum(left[x], left[y])
        eight = np.ndarray((len(text) - 7,), "<u8", buffer=text.tobytes(), strides=(1,))
        done = np.zeros(len(live), np.int64)
        at = np.arange(len(live))
        while len(at):
            differ = eight[x[at] + done[at]] ^ eight[y[at] + done[at]]
            same = np.where(differ == 0, 8, (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3))
            done[at] += same
            at = at[(same == 8) & (done[at] < most[at])]
        out[live] = np.minimum(done, most)
        return out

    def statistics(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the strings ``which``, from their last suffixes to their first.

        Each step yields strings, an offset in each, and how many bytes the suffix there shares with another suffix of
        the index.
        """
        row = self.begin[which]
        run = np.searchsorted(self.run_starts, row, "right") - 1
        offset = row - self.run_starts[run]
        place = self.lengths[which].copy()
        up, down = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        more = place > 0
        while more.any():
            if not more.all():
                which, run, offset, place, up, down = (v[more] for v in (which, run, offset, place, up, down))
            up = np.where(offset == 0, self.above[run], up + 1)
            down = np.where(offset == self.run_lengths[run] - 1, self.below[run], down + 1)
            row = self.to[run] + offset
            run = np.searchsorted(self.run_starts, row, "right") - 1
            offset = row - self.run_starts[run]
            place = place - 1
            yield which, place, np.maximum(up, down)
            more = place > 0
