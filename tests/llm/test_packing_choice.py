"""Every piece goes to the cheapest sequence that has room for it."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_of_all_with_room(seed):
    rng = np.random.default_rng(seed)
    plan = packing.Plan(capacity=64)
    lengths = rng.integers(1, [20, 60, 200, 64][seed] + 1, 300)
    room = packing.capacities(int(lengths.sum()), plan.capacity)
    filled, cost = [0] * len(room), [0.0] * len(room)
    got = packing.pack(lengths, plan)
    for _, _, n, s, offset in got:
        assert offset == filled[s]
        if n < plan.capacity:
            fits = [(cost[k], k) for k in range(len(room)) if room[k] - filled[k] >= n and (filled[k] or room[k] < plan.capacity or cost[k] == 0)]
            free = [(c, k) for c, k in fits if cost[k] < 1e8]
            assert (cost[s], s) == min(free)
        filled[s] += n
        cost[s] += plan.linear * n + plan.quadratic * n * n if n < plan.capacity else 1e9
    assert filled == room


def test_open_sequences_by_room():
    o = packing.Open(8)
    o.add(8, 2.0, 0)
    o.add(3, 1.0, 1)
    o.add(5, 1.0, 2)
    assert o.cheapest(1) == (1.0, 1) and o.cheapest(4) == (1.0, 2) and o.cheapest(6) == (2.0, 0)
    o.take(5)
    assert o.cheapest(4) == (2.0, 0)
    o.take(8)
    assert o.cheapest(4) == o.NONE


def test_fewer_pieces_than_asking_eight():
    lengths = np.random.default_rng(1).integers(1, 1500, 4000)
    assert len(packing.pack(lengths)) < 5300
