"""Re-Pair grammars of id sequences in NumPy.

The most frequent pairs of neighbouring ids become nonterminals, again and again, until
no pair is frequent. A round replaces all pairs whose count is within a factor of the
largest, more frequent ones first where two overlap, so that a round costs a few passes
over an array. Rules of a round use ids and rules of earlier rounds only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A rule takes the room of about so many symbols' savings.
LEAST_PAIRS = 8
#: Pairs of one round differ in count by this factor at most.
WITHIN = 4
_BUCKETS = 1 << 20


@dataclass
class Grammar:
    """`symbols` derive the sequence: ids below `base`, or base + number of a rule.

    `rules` has the two symbols of each rule, `lengths` how many ids each derives,
    `rounds` the number of rules after each round.
    """

    base: int
    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    rounds: np.ndarray

    def __post_init__(self) -> None:
        self._ends: np.ndarray | None = None
        self._table: np.ndarray | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        sizes[rule] = self.lengths[symbols[rule] - self.base]
        return sizes

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids that each symbol derives, one after the other, and where they begin."""
        if self._table is None:
            ends = self.base + np.cumsum(self.lengths)
            self._begins = np.concatenate((np.arange(self.base), ends - self.lengths))
            table = np.empty(int(ends[-1]) if len(ends) else self.base, np.uint32)
            table[: self.base] = np.arange(self.base)
            done = 0
            for until in self.rounds.tolist():
                left, right = self.rules[done:until].T
                at = self._begins[self.base + done : self.base + until]
                for side, to in ((left, at), (right, at + self._sizes(left))):
                    sizes = self._sizes(side)
                    table[spread(to, sizes)] = table[spread(self._begins[side], sizes)]
                done = until
            self._table = table
        return self._table, self._begins

    def __len__(self) -> int:
        return int(self._sizes(self.symbols).sum())

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin..end of the sequence; only the symbols that derive them are expanded."""
        table, begins = self._expansions()
        if self._ends is None:
            self._ends = np.cumsum(self._sizes(self.symbols))
        end = int(self._ends[-1]) if end is None and len(self._ends) else end or 0
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self._ends, [begin, end - 1], "right")
        symbols = self.symbols[first : last + 1]
        sizes = self._sizes(symbols)
        skipped = begin - int(self._ends[first] - sizes[0])
        return table[spread(begins[symbols], sizes)][skipped : skipped + end - begin]


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each of several runs."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(total)


def compressed(ids: np.ndarray, base: int, least: int = LEAST_PAIRS) -> Grammar:
    """Grammar of `ids`, which are all below `base`."""
    symbols = ids.astype(np.uint32)
    rules = np.zeros((0, 2), np.int64)
    lengths = np.zeros(0, np.int64)
    rounds: list[int] = []
    top = len(symbols)
    while top >= least and len(symbols) > 1:
        pairs, at, of, top = _frequent(symbols, top, least)
        chosen = _apart(at, of)
        uses = np.bincount(of[chosen], minlength=len(pairs))
        worth = uses >= least
        chosen = chosen[worth[of[chosen]]]
        if len(chosen):
            made = np.cumsum(worth) - 1 + base + len(rules)
            new = pairs[worth]
            symbols[at[chosen]] = made[of[chosen]]
            stays = np.ones(len(symbols), bool)
            stays[at[chosen] + 1] = False
            symbols = symbols[stays]
            sizes = np.concatenate((np.ones(base, np.int64), lengths))
            rules = np.concatenate((rules, new))
            lengths = np.concatenate((lengths, sizes[new].sum(axis=1)))
            rounds.append(len(rules))
        top = top // WITHIN if len(chosen) * 50 < len(symbols) or not len(chosen) else top
    return Grammar(base, symbols.astype(np.int64), rules, lengths, np.array(rounds, np.int64))


def _frequent(symbols: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of at least a quarter of the largest count up to `top`, most frequent first, with the
    places where they stand; and that count."""
    left, right = symbols[:-1], symbols[1:]
    bucket = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)
    held = np.bincount(bucket, minlength=_BUCKETS)
    top = min(top, int(held.max()))
    at = np.flatnonzero((held >= max(least, top // WITHIN))[bucket])
    keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
    kinds, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
    top = min(top, int(counts.max(initial=0)))
    often = np.flatnonzero(counts >= max(least, top // WITHIN))
    often = often[np.argsort(-counts[often], kind="stable")]
    rank = np.full(len(kinds), -1)
    rank[often] = np.arange(len(often))
    of = rank[of]
    at, of = at[of >= 0], of[of >= 0]
    kinds = kinds[often]
    return np.stack((kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)), axis=1).astype(np.int64), at, of, top


def _apart(at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Pairs that overlap no pair before them in rank; of a run of one pair, every other."""
    if not len(at):
        return at
    next_ = np.zeros(len(at), bool)
    next_[1:] = at[1:] == at[:-1] + 1
    index = np.arange(len(at))
    chain = np.maximum.accumulate(np.where(next_, 0, index))
    order = 2 * of + ((index - chain) & 1)
    first = np.ones(len(at), bool)
    first[1:] &= ~next_[1:] | (order[1:] < order[:-1])
    first[:-1] &= ~next_[1:] | (order[:-1] < order[1:])
    return np.flatnonzero(first)
