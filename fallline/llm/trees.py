"""Trees under numbers, and their alignment by simple tree matching.

A tree is a label and an ordered tuple of trees.  Equal trees have one number, so comparing them is comparing
numbers, and what was found out about two trees is found again by their numbers.  Nothing here recurses: a page
may nest its elements as deep as it likes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np

from fallline.llm.html_tree import Node

#: Tables of more pairs of children than these are made by rows of arrays, of which some are kept and the others made again.
PAIRS = 40_000
#: A task starts afresh when it knows so many trees.
LIMIT = 200_000


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """The element's children; like siblings in a row are one run."""
    out: list[tuple[str, list[Node]]] = []
    for item in node.items:
        if isinstance(item, Node):
            if out and out[-1][0] == item.label:
                out[-1][1].append(item)
            else:
                out.append((item.label, [item]))
    return out


class Rows:
    """The table of :meth:`Trees._table` where it is wide: every so many rows one is kept, and those between are made again
    from it when they are asked for, one stretch at a time."""

    def __init__(self, value: Callable[[int, int], int], p: tuple[int, ...], q: tuple[int, ...]):
        self.value, self.p = value, p
        self.other, self.code = list(dict.fromkeys(q)), {}
        number = {v: k for k, v in enumerate(self.other)}
        self.at = np.array([number[v] for v in q])
        self.every = max(1, math.isqrt(len(p)))
        self.kept, row = [np.zeros(len(q) + 1, np.int64)], np.zeros(len(q) + 1, np.int64)
        for i, u in enumerate(p, 1):
            row = self._next(row, u)
            if i % self.every == 0:
                self.kept.append(row)
        self.last, self.stretch, self.rows = row, -1, []

    def _next(self, above: np.ndarray, u: int) -> np.ndarray:
        if u not in self.code:
            self.code[u] = np.array([self.value(u, v) for v in self.other])
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + self.code[u][self.at]), out=row[1:])
        return row

    def __len__(self) -> int:
        return len(self.p) + 1

    def __getitem__(self, i: int) -> np.ndarray:
        if i < 0 or i == len(self.p):
            return self.last
        stretch, k = divmod(i, self.every)
        if k == 0:
            return self.kept[stretch]
        if stretch != self.stretch:
            self.stretch, self.rows = stretch, [self.kept[stretch]]
            for u in self.p[stretch * self.every : (stretch + 1) * self.every - 1]:
                self.rows.append(self._next(self.rows[-1], u))
        return self.rows[k]


class Trees:
    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.matched: dict[tuple[int, int], int] = {}
        self.aligned: dict[tuple[int, int], tuple[int, ...]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.loaded: dict[str, int] = {}

    @property
    def full(self) -> bool:
        return len(self.label) + len(self.matched) // 4 + len(self.aligned) // 4 > LIMIT

    def make(self, label: str, kids: tuple[int, ...] = ()) -> int:
        key = label, kids
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.label)
            self.label.append(label)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return n

    def skeletons(self, root: Node) -> dict[int, int]:
        """The tree of every element, by its id(): runs of like siblings become one child that holds them all."""
        order = [root]
        for node in order:
            order += [i for i in node.items if isinstance(i, Node)]
        out: dict[int, int] = {}
        for node in reversed(order):
            kids = []
            for _, members in runs(node):
                one = out[id(members[0])]
                for other in members[1:]:
                    one = self.merge(one, out[id(other)])
                kids.append(one)
            out[id(node)] = self.make(node.label, tuple(kids))
        return out

    def walk(self, t: int) -> Iterator[tuple[int, int, int]]:
        """(place, tree, place of its parent) of every node; places count from 0, parents before children."""
        stack = [(t, 0, -1)]
        while stack:
            node, at, up = stack.pop()
            yield at, node, up
            first = at + 1
            for k in self.kids[node]:
                stack.append((k, first, at))
                first += self.size[k]

    def dump(self, t: int) -> str:
        flat: list = []
        stack = [(t, 0)]
        while stack:
            node, depth = stack.pop()
            flat += (depth, self.label[node])
            stack += [(k, depth + 1) for k in reversed(self.kids[node])]
        return json.dumps(flat, separators=(",", ":"), ensure_ascii=False)

    def load(self, source: str) -> int:
        if source not in self.loaded:
            flat = json.loads(source)
            waiting: dict[int, list[int]] = {}
            for i in range(len(flat) - 2, -1, -2):
                n = self.make(flat[i + 1], tuple(reversed(waiting.pop(flat[i] + 1, ()))))
                waiting.setdefault(flat[i], []).append(n)
            self.loaded[source] = waiting[0][0]
        return self.loaded[source]

    def _ends(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int]:
        """Lengths of the equal beginnings and ends, which a best alignment can always pair."""
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
        return head, tail

    def _value(self, x: int, y: int) -> int:
        if x == y:
            return self.size[x]
        return self.matched[x, y] if self.label[x] == self.label[y] else 0

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most pairs of nodes that a mapping of the two trees can have which keeps roots,
        parents, order and labels."""
        if self.label[a] != self.label[b]:
            return 0
        stack = [(a, b)] if a != b else []
        while stack:
            x, y = stack[-1]
            if (x, y) in self.matched:
                stack.pop()
                continue
            p, q = self.kids[x], self.kids[y]
            head, tail = self._ends(p, q)
            some = ((u, v) for u in set(p[head : len(p) - tail]) for v in set(q[head : len(q) - tail]) if self.label[u] == self.label[v])
            todo = [uv for uv in some if uv[0] != uv[1] and uv not in self.matched]
            if todo:
                stack += todo
                continue
            inner = int(self._table(x, y, head, tail)[-1][-1])
            self.matched[x, y] = 1 + sum(self.size[k] for k in p[:head]) + sum(self.size[k] for k in p[len(p) - tail :]) + inner
            stack.pop()
        return self._value(a, b)

    def _table(self, x: int, y: int, head: int, tail: int) -> list[list[int]] | Rows:
        """Values of the best alignments of the first i and j children between the equal ends."""
        p, q = self.kids[x], self.kids[y]
        p, q = p[head : len(p) - tail], q[head : len(q) - tail]
        if len(p) * len(q) > PAIRS:
            return Rows(self._value, p, q)
        best = [[0] * (len(q) + 1)]
        for u in p:
            above, row = best[-1], [0]
            for j, v in enumerate(q):
                row.append(max(row[j], above[j + 1], above[j] + self._value(u, v)))
            best.append(row)
        return best

    def align(self, a: int, b: int) -> tuple[int, ...]:
        """For each child of ``b`` the place of the child of ``a`` that it matches, or -1."""
        out = self.aligned.get((a, b))
        if out is None:
            out = self.aligned[a, b] = self._align(a, b)
        return out

    def _align(self, x: int, y: int) -> tuple[int, ...]:
        p, q = self.kids[x], self.kids[y]
        if p == q:
            return tuple(range(len(q)))
        head, tail = self._ends(p, q)
        out = [-1] * len(q)
        out[:head] = range(head)
        for k in range(1, tail + 1):
            out[-k] = len(p) - k
        others = set(q[head : len(q) - tail])
        for u in set(p[head : len(p) - tail]):
            for v in others:
                self.match(u, v)
        best = self._table(x, y, head, tail)
        i, j = len(best) - 1, len(best[0]) - 1
        while i and j:
            score = self._value(p[head + i - 1], q[head + j - 1])
            if score and best[i][j] == best[i - 1][j - 1] + score:
                out[head + j - 1] = head + i - 1
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return tuple(out)

    def merge(self, a: int, b: int) -> int:
        """The smallest tree found that holds both: matched children are merged, the others keep their order."""
        stack = [(a, b)] if a != b else []
        while stack:
            x, y = stack[-1]
            if (x, y) in self.merged:
                stack.pop()
                continue
            p, q, how = self.kids[x], self.kids[y], self.align(x, y)
            todo = [(p[i], v) for v, i in zip(q, how) if i >= 0 and p[i] != v and (p[i], v) not in self.merged]
            if todo:
                stack += todo
                continue
            kids, done = [], 0
            for v, i in zip(q, how):
                if i < 0:
                    kids.append(v)
                else:
                    kids += p[done:i]
                    kids.append(v if p[i] == v else self.merged[p[i], v])
                    done = i + 1
            self.merged[x, y] = self.make(self.label[x], (*kids, *p[done:]))
            stack.pop()
        return a if a == b else self.merged[a, b]

    def firsts(self, t: int, at: int) -> list[int]:
        """Places of the children of the tree whose own place is ``at``."""
        out = []
        for k in self.kids[t]:
            out.append(at + 1 if not out else out[-1] + last)
            last = self.size[k]
        return out

    def places(self, root: Node, shape: dict[int, int], t: int) -> dict[int, int]:
        """Place in the tree ``t`` of each element of the page that matches a node of it, by the element's id()."""
        out = {id(root): 0}
        stack = [(root, t, 0)]
        while stack:
            node, mine, at = stack.pop()
            groups = runs(node)
            if not groups:
                continue
            first = self.firsts(mine, at)
            for (_, members), i in zip(groups, self.align(mine, shape[id(node)])):
                if i >= 0:
                    for m in members:
                        out[id(m)] = first[i]
                        stack.append((m, self.kids[mine][i], first[i]))
        return out

    def carried(self, t: int, mine: int) -> Iterator[tuple[int, int, bool]]:
        """(place in ``mine``, place in ``t``, whether it matches) of every node of ``mine``; one that matches none has the
        place of the nearest node above it that does."""
        stack = [(mine, 0, t, 0)]
        while stack:
            node, at, there, place = stack.pop()
            yield at, place, there >= 0
            kids, first = self.kids[node], self.firsts(node, at)
            if there < 0:
                stack += [(k, f, -1, place) for k, f in zip(kids, first)]
                continue
            goal = self.firsts(there, place)
            for k, f, i in zip(kids, first, self.align(there, node)):
                stack.append((k, f, self.kids[there][i], goal[i]) if i >= 0 else (k, f, -1, place))
