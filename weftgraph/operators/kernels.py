"""Sequential algorithms over one small graph: pandas frames in, a frame out."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd


def near(a: float, b: float) -> bool:
    """Equal path lengths up to rounding."""
    return abs(a - b) <= 1e5 * np.finfo(float).eps * max(1.0, abs(a), abs(b))


def strong_components(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
    """Two depth-first passes: finishing order, then components of the reversed graph in that order backwards."""
    ids = sorted(v["id"].tolist())
    out, back = defaultdict(list), defaultdict(list)
    for a, b in zip(e.get("src", []), e.get("dst", [])):
        out[a].append(b)
        back[b].append(a)
    finished, seen = [], set()
    for root in ids:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            at, todo = stack[-1]
            for nxt in todo:
                if nxt not in seen:
                    seen.add(nxt)
                    stack.append((nxt, iter(out[nxt])))
                    break
            else:
                finished.append(at)
                stack.pop()
    rows, owned = [], set()
    for root in reversed(finished):
        if root in owned:
            continue
        owned.add(root)
        members, todo = [root], [root]
        while todo:
            for nxt in back[todo.pop()]:
                if nxt not in owned:
                    owned.add(nxt)
                    members.append(nxt)
                    todo.append(nxt)
        low = min(members)
        rows += [(m, low) for m in members]
    return pd.DataFrame(rows, columns=["id", "component"])


def shortest(arcs: dict[int, list], start: int) -> tuple[dict, dict, list]:
    """Distances, tied predecessors (id, edge) and vertices in order of distance, from arcs {id: [(other, edge, cost)]}."""
    dist, preds, order, done, heap = {start: 0.0}, defaultdict(list), [], set(), [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        order.append(at)
        for other, edge, cost in arcs.get(at, ()):
            new = d + cost
            if other in done:
                continue
            if other not in dist or new < dist[other] and not near(new, dist[other]):
                dist[other], preds[other] = new, [(at, edge)]
                heapq.heappush(heap, (new, other))
            elif near(new, dist[other]):
                preds[other].append((at, edge))
    return dist, preds, order


def dependencies(arcs: dict[int, list], sources: list[int]) -> tuple[dict, dict]:
    """Sums over the sources of how far each vertex and edge lies on shortest paths (Brandes' accumulation)."""
    on_vertex, on_edge = defaultdict(float), defaultdict(float)
    for s in sources:
        _, preds, order = shortest(arcs, s)
        paths = {s: 1.0}
        for at in order[1:]:
            paths[at] = sum(paths[p] for p, _ in preds[at])
        share = defaultdict(float)
        for at in reversed(order):
            for p, edge in preds[at]:
                part = paths[p] / paths[at] * (1 + share[at])
                on_edge[edge] += part
                share[p] += part
            if at != s:
                on_vertex[at] += share[at]
    return on_vertex, on_edge


class Compact:
    """Arcs by tail in arrays: places of vertices and edges stand for their ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, eid: np.ndarray) -> None:
        self.ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        tail, head = at[: len(src)], at[len(src) :]
        self.eids, edge = np.unique(eid, return_inverse=True)
        order = np.argsort(tail, kind="stable")
        self.head, self.edge = head[order], edge[order]
        self.first = np.searchsorted(tail[order], np.arange(len(self.ids) + 1))

    def arcs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arc, which of the ``places`` it leaves) for all arcs out of the places."""
        many = self.first[places + 1] - self.first[places]
        owner = np.repeat(np.arange(len(places)), many)
        begun = np.cumsum(many) - many
        return np.arange(len(owner)) - begun[owner] + self.first[places][owner], owner


#: Vertices times sources of one batch: what its arrays hold, some 100 MB.
BATCH_CELLS = 4_000_000


def dependencies_by_steps(g: Compact, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``dependencies`` where every arc costs 1, by places: a batch of sources advances level by level together.

    A cell is a vertex as one source sees it. ``sources``: places.
    """
    n, on_vertex, on_edge = len(g.ids), np.zeros(len(g.ids)), np.zeros(len(g.eids))
    width = max(1, BATCH_CELLS // max(n, 1))
    for begin in range(0, len(sources), width):
        starts = sources[begin : begin + width]
        starts = starts + n * np.arange(len(starts))
        reached, paths, share = np.zeros(n * len(starts), bool), np.zeros(n * len(starts)), np.zeros(n * len(starts))
        reached[starts], paths[starts] = True, 1.0
        front, levels = starts, []
        while len(front):
            place = front % n
            arc, owner = g.arcs_of(place)
            to = (front - place)[owner] + g.head[arc]
            fresh = ~reached[to]  # all arcs to vertices not seen before lie on shortest paths
            tail, to, edge = front[owner[fresh]], to[fresh], g.edge[arc[fresh]]
            front, at = np.unique(to, return_inverse=True)
            paths[front] = np.bincount(at, paths[tail], len(front))
            reached[front] = True
            levels.append((tail, to, edge))
        for tail, to, edge in reversed(levels):
            part = paths[tail] / paths[to] * (1 + share[to])
            np.add.at(on_edge, edge, part)
            np.add.at(share, tail, part)
        share[starts] = 0
        on_vertex += share.reshape(len(starts), n).sum(axis=0)
    return on_vertex, on_edge


class Residual:
    """Arcs in pairs: arc ``i`` and its reverse ``i ^ 1``."""

    def __init__(self) -> None:
        self.head: list[int] = []
        self.room: list[float] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def add(self, a: int, b: int, forth: float, back: float) -> int:
        at = len(self.head)
        self.head += [b, a]
        self.room += [forth, back]
        self.out[a].append(at)
        self.out[b].append(at + 1)
        return at

    def levels(self, source: int, least: float = 0.0) -> dict[int, int]:
        level, queue = {source: 0}, deque([source])
        while queue:
            at = queue.popleft()
            for i in self.out[at]:
                if self.room[i] > least and self.head[i] not in level:
                    level[self.head[i]] = level[at] + 1
                    queue.append(self.head[i])
        return level

    def saturate(self, source: int, sink: int) -> float:
        """Maximum flow: blocking flows in level graphs until the sink is out of reach."""
        total = 0.0
        while sink in (level := self.levels(source)):
            todo = {v: list(self.out[v]) for v in level}
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    push = min(self.room[i] for i in path)
                    total += push
                    for i in path:
                        self.room[i] -= push
                        self.room[i ^ 1] += push
                    first = next(k for k, i in enumerate(path) if self.room[i] <= 0)
                    at = self.head[path[first] ^ 1]
                    del path[first:]
                    continue
                while todo[at]:
                    i = todo[at][-1]
                    if self.room[i] > 0 and level.get(self.head[i], -1) == level[at] + 1:
                        break
                    todo[at].pop()
                if todo[at]:
                    path.append(todo[at][-1])
                    at = self.head[path[-1]]
                elif path:
                    at = self.head[path.pop() ^ 1]
                    todo[at].pop()
                else:
                    break
        return total


def max_flow(v: pd.DataFrame, e: pd.DataFrame, sources: list[int], sinks: list[int], directed: bool) -> tuple[float, dict[int, int], dict[int, float]]:
    """Value, labels (1 source side, 2 sink side, 3 out of the sources' reach from the start) and flow by edge."""
    net, arc_of = Residual(), {}
    for eid, a, b, c in zip(e["eid"], e["src"], e["dst"], e["capacity"]):
        if a != b:
            arc_of[eid] = net.add(a, b, float(c), 0.0 if directed else float(c))
    top = 1.0 + sum(map(float, e["capacity"]))
    first, last = object(), object()
    for s in sources:
        net.add(first, s, top, 0.0)
    for t in sinks:
        net.add(t, last, top, 0.0)
    before = dict(net.levels(first))
    start = list(net.room)
    value = net.saturate(first, last)
    after = net.levels(first, 1e-12 * top)
    labels = {i: 1 if i in after else 2 if i in before else 3 for i in v["id"]}
    flows = {eid: (start[i] - net.room[i]) if directed else (net.room[i ^ 1] - net.room[i]) / 2 for eid, i in arc_of.items()}
    return value, labels, flows


def min_cut(v: pd.DataFrame, e: pd.DataFrame) -> tuple[float, set[int]]:
    """Weight of the smallest global cut and one side of it: maximum-adjacency phases and merging of the last two."""
    near_of: dict[int, dict[int, float]] = {i: {} for i in sorted(v["id"].tolist())}
    for a, b, w in zip(e["src"], e["dst"], e["weight"]):
        if a != b:
            near_of[a][b] = near_of[a].get(b, 0.0) + float(w)
            near_of[b][a] = near_of[b].get(a, 0.0) + float(w)
    merged = {i: {i} for i in near_of}
    best, side = float("inf"), set()
    while len(near_of) > 1:
        tied, done, heap = dict.fromkeys(near_of, 0.0), [], [(0.0, i) for i in near_of]
        heapq.heapify(heap)
        seen = set()
        while heap:
            w, at = heapq.heappop(heap)
            if at in seen or -w != tied[at]:
                continue
            seen.add(at)
            done.append(at)
            for other, weight in near_of[at].items():
                if other not in seen:
                    tied[other] += weight
                    heapq.heappush(heap, (-tied[other], other))
        last, keep = done[-1], done[-2]
        if tied[last] < best:
            best, side = tied[last], set(merged[last])
        for other, weight in near_of.pop(last).items():
            near_of[other].pop(last)
            if other != keep:
                near_of[keep][other] = near_of[keep].get(other, 0.0) + weight
                near_of[other][keep] = near_of[keep][other]
        merged[keep] |= merged.pop(last)
    return best, side
