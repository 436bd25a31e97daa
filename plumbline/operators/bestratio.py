"""The best partner of each name by the ratio of matching blocks, with exact ratios only where two bounds leave a chance.

The ratio of two names is 2 m / (la + lb), with m the signs in matching blocks. Those blocks stand in the same order in both names, so m is at
most the length of the longest common subsequence, and that is at most the number of signs that both names hold, order aside. The latter
is one matrix product for all bags of signs of a tile, the former bit-parallel for all partners of a name at once. Partners that stay below the best
ratio so far, or level with it under a greater name, are left out; all others are compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Bags whose partners are compared first, bags that are then taken at a time, signs of a name that the subsequence is bounded with, classes of signs, cells of a matrix of signs.
FIRST, AT_A_TIME, WIDE, CLASSES, CELLS = 64, 2048, 128, 128, 1 << 22


def codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, the length of each name."""
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, names), np.int64, len(names))


def bags(classes: np.ndarray, lengths: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of counts by class, the row of each name."""
    counts = np.bincount(np.repeat(np.arange(len(lengths)), lengths) * n_classes + classes, minlength=len(lengths) * n_classes).reshape(-1, n_classes)
    rows, which = np.unique(counts.astype(np.uint32), axis=0, return_inverse=True)
    return rows, which.reshape(-1)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs that both bags hold, for all pairs of rows."""
    most = np.minimum(a.max(0), b.max(0))
    signs = [(c, k) for c, m in enumerate(most) for k in range(1, m + 1)]
    out = np.zeros((len(a), len(b)), np.min_scalar_type(int(a.sum(1).max())))
    for s in range(0, len(signs), 256):  # sums of products of ones and zeros: exact
        part = signs[s : s + 256]
        x = np.stack([a[:, c] >= k for c, k in part], 1).astype(np.float32)
        step = max(1, CELLS // max(len(part), len(a)))
        for t in range(0, len(b), step):
            y = np.stack([b[t : t + step, c] >= k for c, k in part]).astype(np.float32)
            out[:, t : t + step] += (x @ y).astype(out.dtype)
    return out


def ratio_of(signs, length) -> np.ndarray:
    """As SequenceMatcher has it, bit by bit."""
    return np.where(length > 0, 2.0 * signs / np.maximum(length, 1), 1.0)


class Partners:
    """Names to be found, each once."""

    def __init__(self, names: list[str], least: float):
        self.names, self.least = sorted(names), least
        self.place = {x: i for i, x in enumerate(self.names)}

    def best(self, others: list[str]) -> list[tuple[int, str, float]]:
        """(place in others, name, ratio) of those of others that have a partner with `least` or more; ties go to the smaller name, equal names have 1."""
        out = [(i, x, 1.0) for i, x in enumerate(others) if x in self.place]
        rest = [i for i, x in enumerate(others) if x not in self.place]
        if not rest or not self.names:
            return out
        (flat_a, la), (flat_b, self.lengths) = codes([others[i] for i in rest]), codes(self.names)
        signs, coded = np.unique(np.concatenate([flat_a, flat_b]), return_inverse=True)
        coded = coded.reshape(-1)
        classes = coded % CLASSES  # signs in one class can only share more
        n_classes = min(len(signs), CLASSES) or 1
        a_bags, a_which = bags(classes[: len(flat_a)], la, n_classes)
        b_bags, b_which = bags(classes[len(flat_a) :], self.lengths, n_classes)
        # names by bag; their first signs as a matrix, 0 past the end
        self.members, counts = np.argsort(b_which, kind="stable"), np.bincount(b_which, minlength=len(b_bags))
        self.ends = np.cumsum(counts)
        self.starts, bag_length = self.ends - counts, b_bags.sum(1).astype(np.int64)
        width = int(min(WIDE, self.lengths.max()))
        at = np.arange(len(flat_b)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        row, near = np.repeat(np.arange(len(self.names)), self.lengths), at < width
        self.signs = np.zeros((width, len(self.names)), np.int32)
        self.signs[at[near], row[near]] = coded[len(flat_a) :][near] + 1
        starts = np.cumsum(la) - la
        by_bag = np.argsort(a_which, kind="stable")
        for low in range(0, len(a_bags), 256):
            both = shared(a_bags[low : low + 256], b_bags)
            mine = by_bag[np.searchsorted(a_which[by_bag], low) : np.searchsorted(a_which[by_bag], low + 256)]
            before, bound = -1, None
            for k in mine:
                if a_which[k] != before:
                    before = a_which[k]
                    bound = ratio_of(both[before - low].astype(np.int64), bag_length + la[k])
                found = self.search(others[rest[k]], coded[starts[k] : starts[k] + la[k]], bound, len(signs))
                if found:
                    out.append((rest[k], *found))
        return out

    def search(self, name: str, own: np.ndarray, bound: np.ndarray, n_signs: int) -> tuple[str, float] | None:
        best, place = self.least, len(self.names)
        masks = None
        if 0 < len(own) < 64:
            masks = np.zeros(n_signs + 1, np.uint64)
            np.bitwise_or.at(masks, own + 1, np.uint64(1) << np.arange(len(own), dtype=np.uint64))
        first = np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else np.arange(len(bound))
        best, place = self.compare(name, own, masks, first, bound, best, place)
        left = bound >= best
        left[first] = False
        left = np.flatnonzero(left)
        left = left[np.argsort(-bound[left], kind="stable")]
        for s in range(0, len(left), AT_A_TIME):
            if bound[left[s]] < best:
                break
            best, place = self.compare(name, own, masks, left[s : s + AT_A_TIME], bound, best, place)
        return (self.names[place], best) if place < len(self.names) else None

    def compare(self, name: str, own: np.ndarray, masks: np.ndarray | None, chosen: np.ndarray, bound: np.ndarray, best: float, place: int) -> tuple[float, int]:
        """The best ratio and its place, with the names of the chosen bags."""
        chosen = chosen[bound[chosen] >= best]
        n = self.ends[chosen] - self.starts[chosen]
        ids = self.members[np.repeat(self.starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        most = np.repeat(bound[chosen], n)
        if masks is not None and len(ids):
            whole = self.lengths[ids] <= len(self.signs)
            free = np.full(len(ids), ~np.uint64(0))
            for signs in self.signs[: self.lengths[ids].max()]:
                met = free & masks[signs[ids]]
                free = (free + met) | (free - met)
            common = np.bitwise_count(~free & np.uint64((1 << len(own)) - 1)).astype(np.int64)
            most = np.where(whole, ratio_of(common, self.lengths[ids] + len(own)), most)
        keep = np.flatnonzero(most >= best)
        for k in keep[np.lexsort((ids[keep], -most[keep]))]:
            i = int(ids[k])
            if most[k] < best:
                break
            if most[k] == best and i > place:
                continue
            r = SequenceMatcher(None, name, self.names[i]).ratio()
            if r > best or (r == best and i < place):
                best, place = r, i
        return best, place
