"""A small upper-confidence tree search over independent actions."""

from __future__ import annotations

import math
import random


class Node:
    def __init__(self, parent: Node | None, action, untried: list):
        self.parent, self.action, self.untried = parent, action, untried
        self.children: list[Node] = []
        self.visits, self.value = 0, 0.0

    def best(self, c: float) -> Node:
        return max(self.children, key=lambda n: n.value / n.visits + c * math.sqrt(math.log(self.visits) / n.visits))


def search(actions: list[tuple], depth: int, rounds: int, seed: int, c: float = 1.4) -> tuple | None:
    """(buyer, seller, visits) of the most visited first action; a rollout's value is the share of the best possible gain."""
    if not actions:
        return None
    rng = random.Random(seed)
    top = sum(sorted((abs(a[2]) for a in actions), reverse=True)[:depth]) or 1.0
    root = Node(None, None, list(actions))
    for _ in range(rounds):
        node, taken = root, []
        while not node.untried and node.children and len(taken) < depth:
            node = node.best(c)
            taken.append(node.action)
        if node.untried and len(taken) < depth:
            action = node.untried.pop(rng.randrange(len(node.untried)))
            taken.append(action)
            child = Node(node, action, [a for a in actions if a not in taken])
            node.children.append(child)
            node = child
        rest = [a for a in actions if a not in taken]
        taken += rng.sample(rest, min(len(rest), depth - len(taken)))
        value = sum(a[2] for a in taken) / top
        while node:
            node.visits += 1
            node.value += value
            node = node.parent
    best = max(root.children, key=lambda n: (n.visits, n.action))
    return best.action[0], best.action[1], best.visits
