"""The one-to-one assignment of two sides of listings without a table of their pairs: a listing looks its best partners up
among those sorted by area or price, some at a time, and again when these are taken by others.

Scores are those of matching.candidates(), bit by bit: weighted means of what two listings under one key both have, to three
places. Ids are replaced by their ranks, so that a score and a partner are one number, larger for the better one.
"""

from __future__ import annotations

import heapq
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np

#: Partners that a listing keeps at a time.
KEPT = 32
#: Partners that a lookup may end with, if more aren't certain yet.
FEWEST = 4
#: Listings to either side of a listing's own area or price where a lookup begins.
NEAR = 64


class Rows:
    """Listings of one side. node: the rank of the id; state: 1 with locality, 2 with bedrooms, 3 with both; kind: 1 with area,
    2 with price, 3 with both; codes: for each of the four states that two listings can share, what they must have alike."""

    def __init__(self, node: np.ndarray, state: np.ndarray, area: np.ndarray, price: np.ndarray, codes: list[np.ndarray]):
        self.node, self.state, self.area, self.price, self.codes = node, state, area, price, codes
        self.kind = np.where(np.isnan(area) | (area != 0), 1, 0) + np.where(np.isnan(price) | (price != 0), 2, 0)
        self.value = (node, area, price)

    def __len__(self) -> int:
        return len(self.node)


class Index:
    """Listings whose ids aren't taken, by state, kind and code, in the order of their rank, area or price."""

    def __init__(self, rows: Rows, alive: np.ndarray):
        self.rows, self.alive, self.parts = rows, alive, {}
        self.there = np.flatnonzero(alive[rows.node])

    def part(self, state: int, kind: int, shared: int, by: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
        """Their places and values in order, and where each code has its own. Made when it is first asked for."""
        name = (state, kind, shared, by)
        if name not in self.parts:
            rows, value = self.rows, self.rows.value[by]
            at = self.there[(rows.state[self.there] == state) & (rows.kind[self.there] == kind)]
            at = at[np.lexsort((value[at], rows.codes[shared][at]))]
            codes, starts = np.unique(rows.codes[shared][at], return_index=True)
            ends = [*starts[1:].tolist(), len(at)][: len(starts)]
            self.parts[name] = at, value[at], dict(zip(codes.tolist(), zip(starts.tolist(), ends, strict=True), strict=True))
        return self.parts[name]


@lru_cache(1 << 16)
def _by_decimals(x: float) -> int:
    if x != x:
        return 0
    return int(Decimal(repr(x)).quantize(Decimal("1e-10"), ROUND_HALF_UP).quantize(Decimal("0.001"), ROUND_HALF_UP) * 1000)


def thousandths(x: np.ndarray) -> np.ndarray:
    """matching._thousandths() times 1000; 0 for what is no number."""
    scaled = x * 1000.0
    out = np.floor(scaled + 0.5).astype(np.int64)
    for k in np.flatnonzero(~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-4)).tolist():
        out[k] = _by_decimals(float(x[k]))
    return out


def _ratio(x: float, y: float) -> float:
    """The ratio of the smaller one to the larger one, 1 where there is none: a bound of what lies beyond y."""
    if x != x or y != y or x == y:
        return 1.0
    return min(x, y) / max(x, y)


#: By what two listings share (0 to 3: locality, bedrooms) and both have (0 to 3: area, price): the weights of locality, area,
#: bedrooms and price, their sum, and in which order partners are looked through (0: rank, 1: area, 2: price).
_WEIGHTS = [[(0.5 * (s & 1), 0.25 * (k & 1), 0.15 * (s >> 1), 0.1 * (k >> 1)) for k in range(4)] for s in range(4)]
_WEIGHTS = [[(*w, w[0] + w[1] + w[2] + w[3], 1 if w[1] else 2 if w[3] else 0) for w in of] for of in _WEIGHTS]


def _partners(index: Index, state: int, kind: int, area: float, price: float, codes: list[int], least: int, n: int) -> tuple[np.ndarray, bool]:
    """The best partners of a listing, best first, as thousandths of the score times n plus their rank, and whether these are all."""
    rows, alive, near = index.rows, index.alive, NEAR
    while True:
        found, weights, low = [], [], -1  # what is above low is certain: all that wasn't looked at is at most that good
        for other in range(4):
            shared = other & state
            for k in range(4):
                place, areas, rooms, prices, total, by = w = _WEIGHTS[shared][k & kind]
                if total == 0.0:
                    continue
                at, value, spans = index.part(other, k, shared, by)
                span = spans.get(codes[shared])
                if span is None:
                    continue
                first, end = start, stop = span
                if end - first > 4 * near:
                    if by == 0:  # all are equally good: the largest ids
                        start = end - 2 * near
                        low = max(low, int(thousandths(np.array([(place + rooms) / total]))[0]) * n + int(value[start - 1]))
                    else:
                        own = area if by == 1 else price
                        middle = first + int(value[first:end].searchsorted(own))
                        start, stop = max(first, middle - near), min(end, middle + near)
                        beyond = max(_ratio(own, float(value[start - 1])) if start > first else 0.0, _ratio(own, float(value[stop])) if stop < end else 0.0)
                        bound = (place + beyond * 0.25 + rooms + prices if by == 1 else place + rooms + beyond * 0.1) / total
                        t = int(bound * 1000.0 + 0.5 + 1e-6)
                        low = max(low, (t + 1) * n - 1)
                found.append(at[start:stop])
                weights.append(w)
        keys = np.zeros(0, np.int64)
        if found:
            here = np.concatenate(found)
            place, areas, rooms, prices, total, _ = np.repeat(np.array(weights).T, [len(x) for x in found], axis=1)
            x, y = rows.area[here], rows.price[here]
            by_area = np.where(areas > 0, np.minimum(x, area) / np.maximum(x, area) * 0.25, 0.0)
            by_price = np.where(prices > 0, np.minimum(y, price) / np.maximum(y, price) * 0.1, 0.0)
            t = thousandths((place + by_area + rooms + by_price) / total)
            nodes = rows.node[here]
            keys = t * n + nodes
            keys = keys[alive[nodes] & (keys > low) & (t >= least)]
        if low < least * n or len(keys) >= FEWEST:
            break
        near *= 4
    whole = low < least * n and len(keys) <= 2 * KEPT
    keys = np.unique(keys if len(keys) <= 2 * KEPT else np.partition(keys, -2 * KEPT)[-2 * KEPT :])
    return keys[: -KEPT - 1 : -1].copy(), whole and len(keys) <= KEPT


def assigned(a: Rows, b: Rows, n_a: int, n_b: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """matching.assigned() of all pairs of a and b with at least that score: the ranks of both, and thousandths.

    Listings of the smaller side that are alike in all that counts are one group with one list of partners. A heap holds the best
    pair of each group; what it gives is the best one of all if neither end is taken, and else makes way for the next of its group."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return _assigned(a, b, n_a, n_b, next((t for t in range(1001) if t / 1000.0 >= least), 1001))


def _assigned(a: Rows, b: Rows, n_a: int, n_b: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    turned = len(b) < len(a)
    (x, n_x), (y, n_y) = ((b, n_b), (a, n_a)) if turned else ((a, n_a), (b, n_b))
    free_x, held = bytearray(b"\1" * n_x), bytearray(b"\1" * n_y)
    free_y = np.frombuffer(held, dtype=bool)
    index, left, since = Index(y, free_y), n_y, n_y
    order = np.lexsort((-x.node, x.price, x.area, x.codes[3]))
    same = lambda v: v[order][1:] == v[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~(same(x.codes[3]) & same(x.area) & same(x.price))])) if len(x) else np.zeros(0, np.int64)
    members, ends = x.node[order].tolist(), [*starts[1:].tolist(), len(x)]
    first = order[starts]
    states, kinds, areas, prices = (v[first].tolist() for v in (x.state, x.kind, x.area, x.price))
    codes = list(zip(*(c[first].tolist() for c in x.codes), strict=True))
    member, lists, at, whole = starts.tolist(), [None] * len(first), [0] * len(first), [False] * len(first)

    def ahead(g: int) -> int:
        """The best pair of a group as one number, -1 if it has none."""
        k, end = member[g], ends[g]
        while k < end and not free_x[members[k]]:
            k += 1
        member[g] = k
        if k == end:
            lists[g] = None
            return -1
        found, j = lists[g], at[g]
        while True:
            if found is not None:
                while j < len(found) and not held[found[j] % n_y]:
                    j += 1
                if j < len(found):
                    break
                if whole[g]:
                    lists[g] = None
                    return -1
            found, whole[g] = _partners(index, states[g], kinds[g], areas[g], prices[g], codes[g], least, n_y)
            lists[g], j = found, 0
            if not len(found):
                return -1
        at[g] = j
        t, other = divmod(int(found[j]), n_y)
        own = members[k]
        return (t * n_a + other) * n_b + own if turned else (t * n_a + own) * n_b + other

    heap = [(-key, g) for g in range(len(first)) if (key := ahead(g)) >= 0]
    heapq.heapify(heap)
    taken = []
    while heap:
        key, g = heap[0]
        t, own, other = -key // n_b // n_a, -key // n_b % n_a, -key % n_b
        if turned:
            own, other = other, own
        if free_x[own] and held[other]:
            taken.append((other, own, t) if turned else (own, other, t))
            free_x[own] = held[other] = 0
            left -= 1
            if left * 2 < since:
                index, since = Index(y, free_y), left
        key = ahead(g)
        if key >= 0:
            heapq.heapreplace(heap, (-key, g))
        else:
            heapq.heappop(heap)
    out = np.array(taken, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def sides(side: np.ndarray, ids: np.ndarray, city: np.ndarray, plain: np.ndarray, rooms: np.ndarray, area: np.ndarray, price: np.ndarray) -> tuple[Rows, Rows, np.ndarray, np.ndarray]:
    """Rows of side 0 and 1 and the ids of their ranks. Codes of cities are from 0, those of localities and bedrooms too or -1;
    area and price are 0 where there is none."""
    codes = []
    for shared in range(4):
        code = city
        for part, has in ((plain, shared & 1), (rooms, shared & 2)):
            if has:
                _, code = np.unique(code * (part.max(initial=0) + 2) + part + 1, return_inverse=True)
        codes.append(code)
    state = np.where(plain >= 0, 1, 0) + np.where(rooms >= 0, 2, 0)
    out, names = [], []
    for k in (0, 1):
        at = np.flatnonzero(side == k)
        known, node = np.unique(ids[at], return_inverse=True)
        out.append(Rows(node, state[at], area[at], price[at], [c[at] for c in codes]))
        names.append(known)
    return out[0], out[1], names[0], names[1]
