"""Double-array tries over word sequences, built and walked in numpy.

A word has a code, a code is written as a fixed number of base-256 digits, and each digit is one
transition: from state ``s`` by digit ``c`` to ``t = base[s] + c`` if ``check[t] == s``. With
256 symbols a state needs at most one window of 256 places, so the arrays have at most 256 places
for each state, and states are at most the digits of all words of the entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 256
_PROBES = 128


@dataclass
class Trie:
    """``words`` have codes 1, 2, ...; ``roots`` holds the start state of each label; ``accept`` the entry of a state, or -1."""
    words: list[bytes]
    roots: dict[str, int]
    digits: int
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes + self.accept.nbytes + sum(map(len, self.words)) + 64 * len(self.words)


def _digit(codes: np.ndarray, place: int, digits: int) -> np.ndarray:
    return codes >> 8 * (digits - 1 - place) & 255


def _place(parents: np.ndarray, symbols: np.ndarray, roots: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Base of each node and place of each node; nodes are the roots and then one for each edge (edges ordered by parent)."""
    total = roots + len(parents)
    base, place = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    first = SYMBOLS  # places before it keep single symbols from going below zero
    place[:roots] = first + np.arange(roots)
    end = first + roots
    used = np.zeros(max(4096, 2 * total) + 4 * SYMBOLS, bool)
    used[:end] = True
    heads, at, size = np.unique(parents, return_index=True, return_counts=True)
    rng = np.random.default_rng(len(parents))
    for k in np.argsort(-size, kind="stable"):
        if size[k] == 1:
            break
        edges = slice(at[k], at[k] + size[k])
        own = symbols[edges]
        tries = rng.integers(first, end, _PROBES) if size[k] < 64 else ()
        free = np.flatnonzero(~used[np.asarray(tries, np.int64)[:, None] + own].any(1)) if len(tries) else ()
        if len(free):
            start = tries[free[0]]
        else:
            start, end = end, end + SYMBOLS
        base[heads[k]] = start
        place[roots + at[k]:roots + at[k] + size[k]] = start + own
        end = max(end, int(start + own[-1]) + 1)
        if end + 2 * SYMBOLS > len(used):
            used = np.concatenate([used, np.zeros(len(used), bool)])
        used[start + own] = True
    single = size == 1
    need = int(single.sum())
    holes = np.flatnonzero(~used[:end])[:need]
    holes = np.concatenate([holes, np.arange(end, end + need - len(holes))])
    place[roots + at[single]] = holes
    base[heads[single]] = holes - symbols[at[single]]
    return base, place, int(max(end, holes[-1] + 1 if need else 0)) + SYMBOLS


def build(labels: list[str], entries: list[list[bytes]]) -> Trie:
    """The trie of distinct ``(label, words)``; the entry of an accepting state is its index in the lists."""
    names = sorted(set(labels))
    words, inverse = np.unique(np.array([w for e in entries for w in e], object), return_inverse=True)
    inverse = inverse.astype(np.int64)
    often = np.argsort(-np.bincount(inverse, minlength=len(words)), kind="stable")  # frequent words get low codes
    code = np.empty(len(words), np.int64)
    code[often] = np.arange(1, len(words) + 1)
    codes = code[inverse]
    lengths = np.array([len(e) for e in entries], np.int64)
    starts = np.cumsum(lengths) - lengths
    digits = 1 if len(words) < 256 else 2 if len(words) < 1 << 16 else 3 if len(words) < 1 << 24 else 4
    node = np.searchsorted(np.array(names, object), np.array(labels, object)).astype(np.int64)
    total, parents, symbols = len(names), [], []
    ends = np.full(len(entries), -1)
    for depth in range(lengths.max(initial=0)):
        active = np.flatnonzero(lengths > depth)
        own = codes[starts[active] + depth]
        for place in range(digits):
            edges, child = np.unique(node[active] * SYMBOLS + _digit(own, place, digits), return_inverse=True)
            parents.append(edges // SYMBOLS)
            symbols.append(edges % SYMBOLS)
            node[active] = total + child
            total += len(edges)
        ends[lengths == depth + 1] = node[lengths == depth + 1]
    parents = np.concatenate(parents) if parents else np.zeros(0, np.int64)
    symbols = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
    base, place, size = _place(parents, symbols, len(names))
    out = Trie([bytes(w) for w in words[often]], {n: int(place[k]) for k, n in enumerate(names)}, digits,
               np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32))
    out.base[place] = base
    out.check[place[len(names):]] = place[parents]
    out.accept[place[ends]] = np.arange(len(entries))
    return out


def walk(trie: Trie, states: np.ndarray, codes: np.ndarray, until: np.ndarray, longest: int) -> np.ndarray:
    """Entries met from all positions, repeats included: states advance one word at a time, all positions at once.

    ``states`` holds a start state for each position (below 0: none), ``codes`` the word codes (0: unknown)
    and ``until`` the first position that a sequence from here must not reach.
    """
    at = np.flatnonzero((states >= 0) & (codes > 0))
    state = states[at]
    met = []
    for depth in range(longest):
        here = at + depth
        go = here < until[at]
        at, state, here = at[go], state[go], here[go]
        code = codes[here]
        go = code > 0
        at, state, code = at[go], state[go], code[go]
        for place in range(trie.digits):
            to = trie.base[state] + _digit(code, place, trie.digits)
            go = trie.check[to] == state
            at, state, code = at[go], to[go], code[go]
        found = trie.accept[state]
        met.append(found[found >= 0])
    return np.concatenate(met)
