"""The branch and bound against planted perfect packings, exhaustive search and best fit."""

from functools import lru_cache

import numpy as np
import pytest

from dossier.llm.bin_completion import best_fit, lower_bound, pack


def bins(patterns):
    return sum(n for _, n in patterns)


def packed(counts, cap, **options):
    found = pack(counts, cap, **options)
    back = np.zeros_like(counts)
    for content, times in found:
        assert times > 0 and sum(s * k for s, k in content) <= cap
        for s, k in content:
            back[s] += k * times
    assert (back == counts).all()
    return found


@pytest.mark.parametrize("parts", [3, 4, 5])
@pytest.mark.parametrize("cap", [100, 2048])
def test_perfect_packings_are_found(cap, parts):
    beaten = 0
    for seed in range(5):
        rng = np.random.default_rng(seed)
        sizes = np.concatenate([np.diff([0, *np.sort(rng.choice(np.arange(1, cap), parts - 1, replace=False)), cap]) for _ in range(12)])
        counts = np.bincount(sizes, minlength=cap + 1)
        assert bins(packed(counts, cap)) == 12
        beaten += bins(best_fit(counts, cap)) > 12
    assert beaten > 0


def test_as_few_bins_as_exhaustive_search():
    @lru_cache(maxsize=None)
    def fewest(left, rooms):
        if not left:
            return len(rooms)
        size, rest = left[0], left[1:]
        best = fewest(rest, tuple(sorted((*rooms, 12 - size))))
        for i, room in enumerate(rooms):
            if room >= size:
                best = min(best, fewest(rest, tuple(sorted((*rooms[:i], room - size, *rooms[i + 1 :])))))
        return best

    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = sorted((int(x) for x in rng.integers(2, 9, rng.integers(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=13)
        assert bins(packed(counts, 12)) == fewest(tuple(sizes), ())
        assert lower_bound(counts, 12) <= fewest(tuple(sizes), ())


def test_many_alike_items_go_together():
    counts = np.zeros(2049, np.int64)
    counts[[1100, 948, 700, 648]] = 1_000_000, 1_000_000, 3_000_000, 10
    found = packed(counts, 2048)  # two items of 700 fill a bin, whatever the volume says
    assert bins(found) == 2_500_000 and len(found) < 50


def test_the_budget_ends_the_search():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(300, 1401, 400), minlength=2049)
    few, many = packed(counts, 2048, steps=100), packed(counts, 2048)
    assert lower_bound(counts, 2048) <= bins(many) <= bins(few) <= bins(best_fit(counts, 2048))
