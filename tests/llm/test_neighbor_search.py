import time

import numpy as np
import pytest

from lodestone.llm import neighbors


def plain_search(x, graph, queries, starts, beam):
    """The search with all neighbours of a step sorted into the beam, also those that can't enter it."""
    n, none = len(queries), len(x)
    seen = np.zeros((n, none + 1), bool)
    seen[:, none] = True
    held, sims, live, near = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.arange(n), starts.astype(np.int32)
    while len(live):
        near[near < 0] = none
        near.sort(1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        every = np.full((len(live), beam + near.shape[1]), -np.inf, np.float32)
        every[:, :beam] = sims[live]
        every[r, beam + c] = np.einsum("nd,nd->n", x[near[r, c]], queries[live[r]])
        line = np.arange(len(live))[:, None]
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        top = top[line, np.argsort(-every[line, top], axis=1)]
        entry, sims[live] = np.concatenate([held[live], near * 2], 1)[line, top], every[line, top]
        entry[sims[live] == -np.inf] = -1
        turn = np.cumsum(entry & 1 == 0, 1)
        pick = (entry & 1 == 0) & (turn <= neighbors.EXPAND)
        held[live] = entry | pick
        more = np.flatnonzero(pick.any(1))
        r, c = np.nonzero(pick[more])
        slot = np.full((len(more), neighbors.EXPAND), -1, np.int32)
        slot[r, turn[more[r], c] - 1] = entry[more[r], c] >> 1
        near, live = np.where(slot[:, :, None] >= 0, graph[slot], -1).reshape(len(more), neighbors.EXPAND * graph.shape[1]), live[more]
    return np.where(sims > -np.inf, held >> 1, -1), sims


def plain_prune(x, cand, sims, degree, alpha):
    out = np.full((len(cand), degree), -1)
    for row, c, s in zip(out, cand, sims):
        kept: list = []
        for i, to in zip(c, s):
            if i >= 0 and len(kept) < degree and all(alpha * (1 - x[j] @ x[i]) > 1 - to for j in kept):
                kept.append(i)
        row[: len(kept)] = kept
    return out


def test_search_finds_the_same_for_less():
    rng = np.random.default_rng(6)
    x = neighbors.unit((rng.normal(0, 1, (30, 64))[rng.integers(0, 30, 3000)] + rng.normal(0, 0.7, (3000, 64))).astype(np.float32))
    graph, _ = neighbors.build_graph(x)
    queries = x[rng.permutation(3000)[:128]]
    spent: dict = {}
    for _ in range(5):
        for search in (plain_search, neighbors.beam_search):
            began = time.thread_time()
            found = search(x, graph, queries, neighbors.entries(x, queries), neighbors.BEAM)
            spent.setdefault(search, []).append((time.thread_time() - began, *found))
    (_, ids, sims), (_, got, near) = (spent[search][0] for search in (plain_search, neighbors.beam_search))
    assert (np.sort(got, 1) == np.sort(ids, 1)).mean() > 0.999 and np.allclose(near, sims, atol=1e-6)  # ties may differ
    assert min(t for t, *_ in spent[neighbors.beam_search]) < 0.85 * min(t for t, *_ in spent[plain_search])
    few, none = neighbors.beam_search(x[:5], np.full((5, 3), -1, np.int32), x[:2], np.array([[0, 1, -1], [-1, -1, -1]]), 4)
    assert set(few[0]) == {0, 1, -1} and (few[1] == -1).all() and (none[0, 2:] == -np.inf).all() and none.dtype == np.float32


@pytest.mark.parametrize("width", [1, 36, 70, 130])
def test_pruning_of_any_number_of_rows_and_candidates(width):
    rng = np.random.default_rng(width)
    x = neighbors.unit((rng.normal(0, 1, (8, 64))[rng.integers(0, 8, 400)] + rng.normal(0, 0.6, (400, 64))).astype(np.float32))
    rows = np.arange(300)
    s = x[rows] @ x.T
    s[rows, rows] = -np.inf
    cand = np.argsort(-s, axis=1)[:, :width]
    sims = np.take_along_axis(s, cand, 1)
    cand[::3, width // 2 :] = -1
    got = neighbors.robust_prune(x, cand, sims, 24, 1.2)
    assert got.shape == (len(rows), 24) and (got == plain_prune(x, cand, sims, 24, 1.2)).all(1).mean() > 0.98  # rounding may decide
    assert neighbors.robust_prune(x, cand[:0], sims[:0]).shape == (0, neighbors.DEGREE)
