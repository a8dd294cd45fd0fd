"""Signature trees: which pairs of sets reach a Jaccard similarity of 0.8, found by bitmaps and sizes and then exactly.

A set's signature is a bitmap with one bit per element's hash. A tree node holds the OR of its signatures, the range of
sizes, and the largest excess (size minus bits set). Elements that two sets share lie on bits that both have, and at
most ``excess`` more elements than bits lie on any bits of a set, so the overlap of any pair under two nodes is at most

    popcount(OR_p & OR_q) + min(excess_p, excess_q),

while a link needs 4/9 of the summed sizes and sizes within 0.8 of each other. The dual traversal goes down level by level,
all node pairs of a level at once, and drops those that cannot reach this and those that lie in one component already.
The sets themselves are the lowest level. What is left is counted element by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of a signature for each element of a set, about, and at least; sets and nodes under a node.
SPARSE, BITS = 4, 64
LEAF, FAN = 16, 8
#: Words of bitmaps that are held against each other at once, and that a tree's sets have in all, about.
AT_ONCE, MOST = 1 << 21, 1 << 23
_U = np.uint64


def signature(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit hashes: a power of two of bits, by its size."""
    bits = max(BITS, 1 << (SPARSE * len(s) - 1).bit_length())
    out = np.zeros(bits // 64, _U)
    bit = (s >> _U(13)) & _U(bits - 1)
    np.bitwise_or.at(out, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return out


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the set has with so many words, which are no more than it has."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether the bitmaps of two sets of these sizes allow a link."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    most = min(na - int(count(a)), nb - int(count(b))) + int(count(a & b))
    return 180 * min(most, na, nb) >= 80 * (na + nb)


def count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The link rule: 100 * intersection >= 80 * union."""
    return 180 * overlap >= 80 * (a + b)


class Tree:
    """Levels of nodes over sets, in order of their smallest hash (which near copies mostly share)."""

    def __init__(self, size: np.ndarray, least: np.ndarray, bitmaps: list[np.ndarray], group: np.ndarray, words: int):
        self.order = np.argsort(least, kind="stable")
        size, one = size[self.order], group[self.order]
        fit = [folded(bitmaps[i], words) for i in self.order]
        low, high, excess = size, size, size - np.array([count(f) for f in fit], np.int64)
        # a narrower bitmap is tiled: it holds the bits that its elements have in a wider one, and counts so many times as it has tiles
        union, tiles = np.stack([np.tile(f, words // len(f)) for f in fit]), np.array([words // len(f) for f in fit], np.int64)
        self.levels, self.spans = [(low, high, excess, union, one, tiles)], []
        while len(low) > 1:
            self.spans.append(FAN if self.spans else LEAF)
            at = np.arange(0, len(low), self.spans[-1])
            first, last = np.minimum.reduceat(one, at), np.maximum.reduceat(one, at)
            one = np.where(first == last, first, -1)
            low, high, excess = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)
            union, tiles = np.bitwise_or.reduceat(union, at, axis=0), np.minimum.reduceat(tiles, at)
            self.levels.append((low, high, excess, union, one, tiles))


def _may(p: Tree, q: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets under the nodes may link and lie in different groups."""
    (lp, hp, ep, up, gp, tp), (lq, hq, eq, uq, gq, tq) = p.levels[level], q.levels[level]
    ok = ((gp[i] < 0) | (gp[i] != gq[j])) & (5 * hp[i] >= 4 * lq[j]) & (5 * hq[j] >= 4 * lp[i])
    at = np.flatnonzero(ok)
    step = max(1, AT_ONCE // up.shape[1])
    for a in range(0, len(at), step):
        k = at[a : a + step]
        x, y = i[k], j[k]
        most = count(up[x] & uq[y]) // np.minimum(tp[x], tq[y]) + np.minimum(ep[x], eq[y])
        ok[k] = linked(np.minimum(most, np.minimum(hp[x], hq[y])), lp[x], lq[y])
    return ok


def pairs(p: Tree, q: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (of the input order) of sets that may link and lie in different groups; ``same``: p is q.

    Nodes of the top level are gone down one by one, so what is held at once is bounded by their children.
    """
    top = min(len(p.levels), len(q.levels)) - 1
    for i in range(len(p.levels[top][0])):
        for j in range(i if same else 0, len(q.levels[top][0])):
            x, y = np.array([i]), np.array([j])
            for level in range(top, -1, -1):
                ok = _may(p, q, level, x, y)
                x, y = x[ok], y[ok]
                if not level or not len(x):
                    break
                span = p.spans[level - 1]
                a, b = np.divmod(np.arange(span * span), span)
                x, y = (x[:, None] * span + a).ravel(), (y[:, None] * span + b).ravel()
                inner = (x < len(p.levels[level - 1][0])) & (y < len(q.levels[level - 1][0]))
                if same:
                    inner &= x <= y if level > 1 else x < y
                x, y = x[inner], y[inner]
            if len(x) and (top or not same):
                yield p.order[x], q.order[y]


def trees(left: list[tuple], right: list[tuple], same: bool) -> tuple[Tree, Tree, np.ndarray] | None:
    """The trees over (name, component, size, smallest hash, bitmap) rows and their components as numbers, left before right; None where
    all are of one."""
    rows = left if same else [*left, *right]
    group = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)[1]
    if not rows or group.max() == 0:
        return None
    words, n = min(max(len(r[4]) for r in rows), 1 << (MOST // len(rows)).bit_length() - 1), len(left)
    make = lambda some, g: Tree(np.array([r[2] for r in some], np.int64), np.array([r[3] for r in some], _U), [r[4] for r in some], g, words)
    p = make(left, group[:n])
    return p, p if same else make(right, group[n:]), group


def partnered(left: list[tuple], right: list[tuple], same: bool) -> list:
    """The names, of rows as for ``trees``, that may link with another component's. ``same``: right is left, else pairs of one side are
    not looked at."""
    built = trees(left, right, same)
    if built is None:
        return []
    shift = 0 if same else len(left)
    hit = np.zeros(shift + len(right), bool)
    for x, y in pairs(*built[:2], same):
        hit[x] = hit[y + shift] = True
    return [r[0] for r, on in zip(left if same else [*left, *right], hit) if on]


def search(left: list[tuple], right: list[tuple], same: bool) -> list[tuple]:
    """(name, name) of linked sets among (name, component, elements) rows, until all that links reach is joined: of every two sets that
    link, either the pair is given or others join them."""
    described = lambda rows: [(name, c, len(s), s[0], signature(s)) for name, c, s in rows]
    a = described(left)
    built = trees(a, a if same else described(right), same)
    if built is None:
        return []
    p, q, group = built
    shift, out, words = 0 if same else len(left), [], None
    for x, y in pairs(p, q, same):
        if words is None:  # the right side's elements by number
            words, code = np.unique(np.concatenate([s for *_, s in right]), return_inverse=True)
            ends = np.cumsum([len(s) for *_, s in right])
            code, flag = np.split(code.astype(np.int32), ends[:-1]), np.zeros(len(words), bool)
            size = np.array([len(s) for *_, s in right])
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        edge = np.flatnonzero(np.diff(x, prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(x)]):
            name, _, own = left[x[a]]
            others = y[a:b]
            others = others[group[others + shift] != group[x[a]]]
            if not len(others):
                continue
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            at = at[words[at] == own]
            flag[at] = True
            step = max(1, (1 << 22) // int(size[others].max()))
            for k in range(0, len(others), step):
                some = others[k : k + step]
                hits = np.add.reduceat(flag[np.concatenate([code[m] for m in some])].astype(np.int64), np.cumsum([0, *size[some][:-1]]))
                for m in some[linked(hits, len(own), size[some])]:
                    if group[m + shift] != group[x[a]]:
                        out.append((name, right[m][0]))
                        group[group == group[m + shift]] = group[x[a]]
            flag[at] = False
    return out
