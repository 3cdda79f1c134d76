"""Bin packing of a size histogram by bin completion with branch and bound.

Items of one size are alike, so the search works on counts. Each node takes the
largest size left and completes its bin with the undominated fillings of the
room beside it, least waste first; a branch ends when its waste, or the lower
bound of what is left, rules out the wanted number of bins, and the search steps
back to the next filling. States that failed are remembered. The first incumbent
is best-fit decreasing; targets are halved between it and the lower bound.

The search is exact as long as its budget of steps lasts; beyond it the best
packing found so far stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: (items of each size in the bin, how many such bins)
Pattern = tuple[tuple[tuple[int, int], ...], int]
#: Steps that one call may spend in all: one for an item tried in a filling, NODE_STEPS and a quarter for each size left at a node.
SEARCH_STEPS = 300_000
NODE_STEPS = 20


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Bins that any packing needs: by volume, and by items above half a bin with what can't lie beside them."""
    sizes = np.arange(cap + 1)
    n = np.zeros(cap + 1, np.int64)
    n[: len(counts)] = counts
    weight = n * sizes
    n_upto, w_upto = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(weight))  # of sizes below the index
    k = np.arange(1, cap // 2 + 1)
    if not len(k):
        return int(n.sum())
    half = cap // 2
    large = n_upto[-1] - n_upto[cap - k + 1]
    middle = n_upto[cap - k + 1] - n_upto[half + 1]
    room = middle * cap - (w_upto[cap - k + 1] - w_upto[half + 1])
    small = w_upto[half + 1] - w_upto[k]
    return max(-(-int(w_upto[-1]) // cap), int((large + middle + np.maximum(0, -(-(small - room) // cap))).max()))


def best_fit(counts: np.ndarray, cap: int) -> list[Pattern]:
    """Best-fit decreasing; bins of one residual and content are handled together.

    A pass uses up a size or a group of bins and opens one group at most, so there are 2 * cap patterns at most.
    """
    open_bins: dict[int, list[list]] = {}  # residual: [content, how many]
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            rest = min((r for r in open_bins if r >= size), default=None)
            if rest is None:
                each = min(cap // size, left)
                bins, content = left // each, {size: each}
                open_bins.setdefault(cap - each * size, []).append([content, bins])
                left -= bins * each
                continue
            content, bins = open_bins[rest].pop()
            each = min(rest // size, left)
            used = min(bins, left // each)
            if used < bins:
                open_bins[rest].append([content, bins - used])
            if not open_bins[rest]:
                del open_bins[rest]
            open_bins.setdefault(rest - each * size, []).append([content | {size: content.get(size, 0) + each}, used])
            left -= used * each
    return [(tuple(sorted(c.items(), reverse=True)), n) for group in open_bins.values() for c, n in group]


def _reachable(sizes: list[int], counts: np.ndarray, room: int) -> list[int]:
    """For each place i, the sums up to room (as bits) that items of sizes[i:] can make."""
    full = (1 << (room + 1)) - 1
    out = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums, left, take = out[i + 1], min(int(counts[sizes[i]]), room // sizes[i]), 1
        while left:
            take = min(take, left)
            sums |= (sums << (take * sizes[i])) & full
            left -= take
            take *= 2
        out[i] = sums
    return out


def _dominated(filling: tuple[int, ...], slack: int, others: int) -> bool:
    """Whether some items of the filling could give way to one larger item (of `others`, as bits) within the slack."""
    one, many = 0, 0  # sums of one item; of two or more
    for x in filling:
        many |= (many << x) | (one << x)
        one |= 1 << x
    replaced, reach, step = many, (one | many) << 1, 1
    left = slack
    while left > 0:  # sums plus 1 to slack
        step = min(step, left)
        replaced |= reach
        for shift in range(1, step):
            replaced |= reach << shift
        reach <<= step
        left -= step
    return bool(replaced & others)


class _Search:
    def __init__(self, counts: np.ndarray, cap: int, steps: int):
        self.counts, self.cap, self.steps = counts.astype(np.int64).copy(), cap, steps
        self.failed: dict[bytes, int] = {}  # digest of the counts left: most waste that didn't do

    def _state(self) -> bytes:
        return hashlib.blake2b(self.counts, digest_size=16).digest()

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of a room that leave `waste` at most: least waste first, larger items first."""
        counts = self.counts
        sizes = [int(s) for s in np.flatnonzero(counts[: room + 1]) if s][::-1]
        if not sizes:
            if room <= waste:
                yield ()
            return
        self.steps -= NODE_STEPS + len(sizes) // 4
        reach = _reachable(sizes, counts, room)
        available = sum(1 << s for s in sizes)

        def exactly(target: int, i: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
            if target == 0:
                yield taken
                return
            for j in range(i, len(sizes)):
                if not reach[j] >> target & 1:
                    return
                size = sizes[j]
                if size > target:
                    continue
                self.steps -= 1
                if self.steps < 0:
                    return
                if counts[size] > taken.count(size):
                    yield from exactly(target - size, j, (*taken, size))

        for target in range(room, max(0, room - waste) - 1, -1):
            if self.steps < 0:
                return
            if not reach[0] >> target & 1:
                continue
            for found in exactly(target, 0, ()):
                others = available
                for x in set(found):
                    if counts[x] <= found.count(x):
                        others &= ~(1 << x)
                if not _dominated(found, room - target, others):
                    yield found

    def run(self, bins: int) -> list[Pattern] | None:
        """A packing in `bins` bins, or None where there is none or the steps ran out."""
        cap, counts = self.cap, self.counts
        volume = int(counts @ np.arange(len(counts)))
        waste = bins * cap - volume
        self.failed.clear()
        path: list[tuple[Pattern, int]] = []  # what was placed, its waste
        stack: list[Iterator[tuple[Pattern, int]]] = [self._choices(waste)]
        while stack and self.steps >= 0:
            choice = next(stack[-1], None)
            if choice is None:
                stack.pop()
                if path:
                    state = self._state()
                    self.failed[state] = max(waste, self.failed.get(state, -1))
                    (content, times), lost = path.pop()
                    for s, k in content:
                        counts[s] += k * times
                    waste += lost
                continue
            (content, times), lost = choice
            for s, k in content:
                counts[s] -= k * times
            path.append((choice[0], lost))
            waste -= lost
            if not counts.any():
                return [p for p, _ in path]
            hopeless = self.failed.get(self._state(), -1) >= waste
            if not hopeless and len(path) % 4 == 0:
                rest = int(counts @ np.arange(len(counts)))
                hopeless = lower_bound(counts, cap) * cap - rest > waste
            stack.append(iter(()) if hopeless else self._choices(waste))
        return None

    def _choices(self, waste: int) -> Iterator[tuple[Pattern, int]]:
        """What the bin of the largest item may hold: as often as the counts allow, and once."""
        top = int(np.flatnonzero(self.counts)[-1])
        self.counts[top] -= 1
        room = self.cap - top
        found = self.fillings(room, waste)
        while True:
            filling = next(found, None)
            if filling is None:
                break
            content: dict[int, int] = {top: 1}
            for x in filling:
                content[x] = content.get(x, 0) + 1
            lost = room - sum(filling)
            pattern = tuple(sorted(content.items(), reverse=True))
            self.counts[top] += 1
            most = min(int(self.counts[s]) // k for s, k in content.items())
            if lost:
                most = max(1, min(most, waste // lost))
            yield (pattern, most), lost * most
            if most > 1:
                yield (pattern, 1), lost
            self.counts[top] -= 1
        self.counts[top] += 1


def pack(counts: np.ndarray, cap: int, steps: int = SEARCH_STEPS) -> list[Pattern]:
    """Patterns that hold each counted item once; counts[s] is the number of items of size s, s <= cap."""
    bins = lambda patterns: sum(n for _, n in patterns)
    best, bound = best_fit(counts, cap), lower_bound(counts, cap)
    low, shares = bound, max(1, (bins(best) - bound).bit_length())
    while low < bins(best):
        target = (low + bins(best)) // 2
        found = _Search(counts, cap, steps // shares).run(target)
        if found is not None:
            best = found
        else:
            low = target + 1
    return best
