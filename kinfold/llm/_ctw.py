"""Context-tree weighting over bytes, in whole arrays.

A byte is eight binary decisions from its highest bit down; each decision, after the bits before it,
has a context tree of its own over the bytes before. A node of depth d holds how often its bit was 0
and 1 after the last d bytes. Its Krichevsky-Trofimov estimate and the product of its children's
weighted probabilities are mixed half and half, from the leaves up; the mixture's posterior weights
then give each node's prediction as a mix of the estimates on the path from the root.
"""

from __future__ import annotations

import numpy as np

from kinfold.llm._common import Table

U = np.uint64
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series at x + 7, taken back by the recurrence."""
    y = x + 7
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = x.copy()
    for k in range(1, 7):
        low *= x + k
    return out - np.log(low)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def node_key(context: np.ndarray, depth: int, node: np.ndarray) -> np.ndarray:
    """A node's name: depth, the last ``depth`` bytes, and 1 followed by the bits decided so far."""
    return (U(depth) << U(60)) | (context << U(8)) | node


def deepest(grams: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, ...]:
    """The deepest nodes of one of the eight decisions from sorted grams (context bytes, then the byte).

    Keys are (context << 8 | node); with them how often, how often a 1, and ln of the weighted probability.
    """
    byte = grams & U(255)
    key = (grams & ~U(255)) | (U(1) << U(bit)) | (byte >> U(8 - bit))
    one = ((byte >> U(7 - bit)) & U(1)).astype(np.float64)
    first = runs(key)
    if not len(first):
        return key, *(np.zeros(0) for _ in range(3))
    n, n1 = np.add.reduceat(counts.astype(np.float64), first), np.add.reduceat(counts * one, first)
    return key[first], n, n1, estimate(n - n1, n1)


def climb(key: np.ndarray, n: np.ndarray, n1: np.ndarray, weighted: np.ndarray, depth: int, top: int) -> tuple[list, np.ndarray]:
    """From the nodes of a depth up to those of ``top``.

    Returns the tiers (depth, key, n, n1, weight of a node's own estimate, place of its parent), deepest
    first, and ln of the weighted probabilities at ``top``.
    """
    tiers, beta = [], np.ones(len(key))
    for d in range(depth - 1, top - 1, -1):
        parent, up = np.unique(((key >> U(8)) & U((1 << (8 * d)) - 1)) << U(8) | (key & U(255)), return_inverse=True)
        tiers.append((d + 1, key, n, n1, beta, up))
        n, n1, below = (np.bincount(up, weights=x, minlength=len(parent)) for x in (n, n1, weighted))
        own = estimate(n - n1, n1)
        weighted = np.logaddexp(HALF + own, HALF + below)
        key, beta = parent, np.exp(HALF + own - weighted)
    tiers.append((top, key, n, n1, beta, None))
    return tiers, weighted


def descend(tiers: list, sure: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Node keys, counts and predictions (a 1's probability where the path ends at the node), from the top down.

    Above one half a prediction is minus a 0's probability, so that single precision never makes a bit impossible.
    ``sure`` and ``left``: what the path above has put together, and the weight it passes on. Returns
    also what the deepest tier passes on.
    """
    keys, seen, predictions, up = [], [], [], None
    for d, key, n, n1, beta, place in reversed(tiers):
        if up is not None:
            sure, left = passed[0][place], passed[1][place]
        kt = (n1 + 0.5) / (n + 1.0)
        keys.append(node_key(key >> U(8), d, key & U(255)))
        seen.append(n)
        p = sure + left * kt
        predictions.append(np.where(p > 0.5, p - 1, p).astype(np.float32))
        passed = (sure + left * beta * kt, left * (1 - beta))
        up = True
    return np.concatenate(keys), np.concatenate(seen), np.concatenate(predictions), passed


class Model:
    """The nodes' predictions, and what they gave for the grams met lately."""

    def __init__(self, keys: np.ndarray, p1: np.ndarray, depth: int, most: int = 1_500_000) -> None:
        self.depth, self.nodes, self.p1, self.most = depth, Table(keys, p1), np.append(p1, np.float32(0.5)), most
        self.clear()

    def clear(self) -> None:
        self.met, self.met_log, self.new = np.zeros(0, U), np.zeros(0), []
        self.table = Table(self.met, self.met_log)

    def byte_log(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others, by its eight decisions."""
        context, byte = grams >> U(8), grams & U(255)
        out = np.zeros(len(grams))
        for bit in range(8):
            node = (U(1) << U(bit)) | (byte >> U(8 - bit))
            one = ((byte >> U(7 - bit)) & U(1)).astype(bool)
            p = np.full(len(grams), 0.5)
            left = np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                ctx = context[left] & U((1 << (8 * d)) - 1)
                at = self.nodes.find(node_key(ctx, d, node[left]))
                hit = at >= 0
                p[left[hit]] = self.p1[at[hit]]
                left = left[~hit]
                if not len(left):
                    break
            out += np.log10(np.where(one == (p > 0), np.abs(p), 1 - np.abs(p)))
        return out

    def log(self, grams: np.ndarray) -> np.ndarray:
        """The same for many grams, most of which come again and again."""
        at = self.table.find(grams)
        out = np.append(self.met_log, 0.0)[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            own, back = np.unique(grams[miss], return_inverse=True)
            logs = self.byte_log(own)
            out[miss] = logs[back]
            self.new.append((own, logs))
            if 4 * sum(len(x) for x, _ in self.new) > len(self.met):
                if len(self.met) > self.most:
                    self.clear()
                    self.new = [(own, logs)]
                keys, first = np.unique(np.concatenate([self.met, *(x for x, _ in self.new)]), return_index=True)
                self.met, self.met_log, self.new = keys, np.concatenate([self.met_log, *(y for _, y in self.new)])[first], []
                self.table = Table(self.met, self.met_log)
        return out


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of each text and its end: the ``depth`` bytes before it and itself; and how many per text.

    The byte 0xFF, which UTF-8 never has, stands before a text's start and for its end.
    """
    pad = b"\xff" * depth
    data = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if not len(texts):
        return np.zeros(0, U), sizes
    whole = np.zeros(len(data) - depth, U)
    for k in range(depth + 1):
        whole = (whole << U(8)) | data[k : len(data) - depth + k]
    # a text's windows begin at its padding; those that run into the next text's padding are left out
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    mark = np.zeros(len(whole) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, np.minimum(starts + sizes, len(whole)), -1)
    return whole[np.cumsum(mark[:-1]) > 0], sizes
