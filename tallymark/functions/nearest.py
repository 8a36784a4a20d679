"""Settling one bounded group of ledger rows against its events.

Called inside tasks on the rows of one group; the grouping, the ordering and
the exchange between groups are Spark jobs (`operators.fuzzy`).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

# Stands for an unknown time, so that times stay 64-bit integers.
UNKNOWN = -(1 << 62)


class FreeSlots:
    """Events in time order; finds the nearest one not yet taken."""

    def __init__(self, times: list[int], orders: list[int]):
        self.times, self.orders = times, orders
        size = len(times)
        self._up = list(range(size + 1))  # next free at or after; size = none
        self._down = list(range(size + 1))  # previous free at or before, shifted by one; 0 = none

    @staticmethod
    def _find(parent: list[int], i: int) -> int:
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    def take(self, i: int) -> None:
        self._up[i] = i + 1
        self._down[i + 1] = i

    def is_free(self, i: int) -> bool:
        return self._up[i] == i

    def nearest(self, t: int, tolerance: int) -> tuple[int, int]:
        """(position, distance) of the best free event, or (-1, 0).

        Smallest distance first, then the earliest arrival.
        """
        times, orders = self.times, self.orders
        best, gap = -1, tolerance + 1
        at = bisect_left(times, t)
        right = self._find(self._up, at)
        if right < len(times) and times[right] - t < gap:
            best, gap = right, times[right] - t
        left = self._find(self._down, at) - 1
        if left >= 0 and t - times[left] <= gap and t - times[left] <= tolerance:
            # Among equal times the earliest arrival sits first in its run.
            left = self._find(self._up, bisect_left(times, times[left]))
            distance = t - times[left]
            if best < 0 or distance < gap or orders[left] < orders[best]:
                best, gap = left, distance
        return (best, gap) if best >= 0 else (-1, 0)


def serve(l_ord, l_ts, e_ord, e_ts, tolerance, claim_event, claim_by):
    """Serve ledger rows in arrival order; returns (l_ord, e_ord, distance) lists.

    `claim_event[i]` was taken in a neighbouring group by ledger row
    `claim_by[i]`; it is not available to later ledger rows here.
    """
    known = np.nonzero(e_ts != UNKNOWN)[0]
    known = known[np.lexsort((e_ord[known], e_ts[known]))]
    times, orders = e_ts[known], e_ord[known]
    slots = FreeSlots(times.tolist(), orders.tolist())
    timeless = np.sort(e_ord[e_ts == UNKNOWN]).tolist()
    position = {o: i for i, o in enumerate(slots.orders)}
    arrival = sorted(slots.orders + timeless)
    taken: set[int] = set()
    head = first = 0
    by_claimant = np.argsort(claim_by, kind="stable")
    claims = list(zip(claim_by[by_claimant].tolist(), claim_event[by_claimant].tolist()))
    next_claim = 0
    out_l, out_e, out_d = [], [], []

    def pick(event: int) -> None:
        taken.add(event)
        i = position.get(event)
        if i is not None and slots.is_free(i):
            slots.take(i)

    serve = np.argsort(l_ord, kind="stable")
    for order, t in zip(l_ord[serve].tolist(), l_ts[serve].tolist()):
        while next_claim < len(claims) and claims[next_claim][0] < order:
            pick(claims[next_claim][1])
            next_claim += 1
        while head < len(timeless) and timeless[head] in taken:
            head += 1
        distance = 0
        if t == UNKNOWN:
            while first < len(arrival) and arrival[first] in taken:
                first += 1
            if first == len(arrival):
                continue
            event = arrival[first]
        elif head < len(timeless):
            # An event without a time is taken at once; the distance reported
            # is that of the nearest free event that arrived before it.
            event = timeless[head]
            lo, hi = np.searchsorted(times, [t - tolerance, t + tolerance + 1])
            near = [
                abs(slots.times[i] - t)
                for i in range(lo, hi)
                if slots.orders[i] < event and slots.is_free(i)
            ]
            distance = min(near, default=0)
        else:
            i, distance = slots.nearest(t, tolerance)
            if i < 0:
                continue
            event = slots.orders[i]
        pick(event)
        out_l.append(order)
        out_e.append(event)
        out_d.append(distance)
    return out_l, out_e, out_d


def nearest_between(l_ord, l_ts, low, high, e_ord, e_ts, tolerance):
    """Distance from each ledger row to the nearest event with low <= ord < high.

    Both limits grow along the ledger rows. Returns (l_ord, distance) for the
    rows that have such an event within the tolerance.
    """
    arrival = np.argsort(e_ord, kind="stable")
    orders, times = e_ord[arrival].tolist(), e_ts[arrival].tolist()
    live: list[int] = []
    entered = left = 0
    out_l, out_d = [], []
    for k in np.argsort(high, kind="stable").tolist():
        while entered < len(orders) and orders[entered] < high[k]:
            if entered >= left:
                insort(live, times[entered])
            entered += 1
        while left < len(orders) and orders[left] < low[k]:
            if left < entered:
                del live[bisect_left(live, times[left])]
            left += 1
        t = int(l_ts[k])
        at = bisect_left(live, t)
        near = [abs(x - t) for x in live[max(at - 1, 0) : at + 1]]
        if near and min(near) <= tolerance:
            out_l.append(int(l_ord[k]))
            out_d.append(min(near))
    return out_l, out_d


def scan_in_order(l_ord, e_ord, gone_at):
    """Rows without a time take events in arrival order.

    Each takes the next event that no earlier row took and that is not gone:
    `gone_at[i]` is the arrival of the ledger row that took event i.
    """
    out_l, out_e = [], []
    waiting = np.sort(l_ord).tolist()
    served = 0
    arrival = np.argsort(e_ord, kind="stable")
    for event, gone in zip(e_ord[arrival].tolist(), gone_at[arrival].tolist()):
        if served == len(waiting):
            break
        if gone > waiting[served]:
            out_l.append(waiting[served])
            out_e.append(event)
            served += 1
    return out_l, out_e
