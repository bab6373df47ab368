"""Union boundary of many groups of segments at once, and linking of boundaries to WKB.

Works on numpy arrays of one Arrow batch; Spark decides which segments are together.
The union is found from depth, the number of pieces covering a point. Segments of one
group are split where they meet, and a part is on the boundary of the union when one of
its sides has depth 0 and the other has not. Adding up the directions of coinciding
segments beforehand does not change any depth, so that step can run in Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from terrane.functions.wkb import (
    COLLECTION,
    LINE,
    MULTILINE,
    MULTIPOINT,
    MULTIPOLYGON,
    POINT,
    POLYGON,
    signed_area,
)

PAIRS_PER_BLOCK = 1 << 20
# Orientation determinants below this share of their terms are rounding noise.
NOISE = 1e-15


@dataclass
class Segments:
    """Segments of several groups: group number, dimension, end points, net direction weight."""

    group: np.ndarray
    dim: np.ndarray
    xy: np.ndarray
    weight: np.ndarray

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(self.group[rows], self.dim[rows], self.xy[rows], self.weight[rows])

    def directed(self) -> Segments:
        """Same segments with the lexicographically smaller end first."""
        a, b = self.xy[:, :2], self.xy[:, 2:]
        swap = (b[:, 0] < a[:, 0]) | ((b[:, 0] == a[:, 0]) & (b[:, 1] < a[:, 1]))
        xy = np.where(swap[:, None], self.xy[:, [2, 3, 0, 1]], self.xy)
        return Segments(self.group, self.dim, xy, np.where(swap, -self.weight, self.weight))


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j) for all j in [low[i], high[i])."""
    counts = np.maximum(high - low, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(counts):
        done = total[start - 1] if start else 0
        stop = max(int(np.searchsorted(total, done + PAIRS_PER_BLOCK, side="right")), start + 1)
        block = counts[start:stop]
        i = np.repeat(np.arange(start, stop), block)
        j = np.arange(len(i)) - np.repeat(np.cumsum(block) - block, block) + np.repeat(low[start:stop], block)
        if len(i):
            yield i, j
        start = stop


def _count_before(
    group: np.ndarray, value: np.ndarray, at_group: np.ndarray, at_value: np.ndarray, ties: bool
) -> np.ndarray:
    """How many (group, value) entries come before each (at_group, at_value); ``ties`` counts equals."""
    kind = np.r_[np.zeros(len(group), int), np.ones(len(at_group), int)]
    if not ties:
        kind = 1 - kind
    order = np.lexsort((kind, np.r_[value, at_value], np.r_[group, at_group]))
    counted = np.cumsum(order < len(group))
    before = np.empty(len(order), int)
    before[order] = counted
    return before[len(group) :]


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Signed area of a, b, c; 0 where it is within rounding of 0. Positive: c is left of a->b."""
    left = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1])
    right = (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    value = left - right
    return np.where(np.abs(value) <= NOISE * (np.abs(left) + np.abs(right)), 0.0, value)


def _inside_box(xy: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points in the box of a segment that are not one of its ends."""
    a, b = xy[:, :2], xy[:, 2:]
    within = ((p >= np.minimum(a, b)) & (p <= np.maximum(a, b))).all(axis=1)
    return within & (p != a).any(axis=1) & (p != b).any(axis=1)


def _meeting_points(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(segment, point) for every place where a segment must be split. ``s`` is sorted by group and x."""
    ends = _count_before(s.group, s.xy[:, 0], s.group, s.xy[:, 2], ties=True)
    at, points = [np.zeros(0, int)], [np.zeros((0, 2))]
    low, high = np.minimum(s.xy[:, 1], s.xy[:, 3]), np.maximum(s.xy[:, 1], s.xy[:, 3])
    for i, j in _ranges(np.arange(len(ends)) + 1, ends):
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        p, q = s.xy[i], s.xy[j]
        sides = [
            _side(p[:, :2], p[:, 2:], q[:, :2]),
            _side(p[:, :2], p[:, 2:], q[:, 2:]),
            _side(q[:, :2], q[:, 2:], p[:, :2]),
            _side(q[:, :2], q[:, 2:], p[:, 2:]),
        ]
        touches = [(sides[0], i, p, q[:, :2]), (sides[1], i, p, q[:, 2:]), (sides[2], j, q, p[:, :2]), (sides[3], j, q, p[:, 2:])]
        for side, target, segment, end in touches:
            hit = (side == 0) & _inside_box(segment, end)
            at.append(target[hit])
            points.append(end[hit])
        cross = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0)
        share = sides[2][cross] / (sides[2][cross] - sides[3][cross])
        where = p[cross, :2] + share[:, None] * (p[cross, 2:] - p[cross, :2])
        at += [i[cross], j[cross]]
        points += [where, where]
    return np.concatenate(at), np.concatenate(points)


def _border_points(s: Segments, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments cross their group's horizontal border."""
    y1, y2 = s.xy[:, 1], s.xy[:, 3]
    hit = np.flatnonzero((np.minimum(y1, y2) < border) & (np.maximum(y1, y2) > border) & np.isfinite(border))
    x1, x2 = s.xy[hit, 0], s.xy[hit, 2]
    x = x1 + (border[hit] - y1[hit]) * ((x2 - x1) / (y2[hit] - y1[hit]))
    return hit, np.stack([x, border[hit]], axis=1)


def _split(s: Segments, at: np.ndarray, points: np.ndarray) -> Segments:
    """Cut segments at the given points."""
    count = len(s.group)
    owner = np.r_[np.arange(count), at, np.arange(count)]
    where = np.concatenate([s.xy[:, :2], points, s.xy[:, 2:]])
    step = s.xy[:, 2:] - s.xy[:, :2]
    along = np.r_[
        np.full(count, -np.inf), ((points - s.xy[at, :2]) * step[at]).sum(axis=1), np.full(count, np.inf)
    ]
    order = np.lexsort((along, owner))
    owner, where = owner[order], where[order]
    follows = np.flatnonzero(owner[:-1] == owner[1:])
    rows = owner[follows]
    cut = Segments(s.group[rows], s.dim[rows], np.hstack([where[follows], where[follows + 1]]), s.weight[rows])
    moved = (cut.xy[:, :2] != cut.xy[:, 2:]).any(axis=1)
    # A point is kept whole: it has no length to begin with.
    whole = np.flatnonzero(s.dim == 0)
    return _joined(cut.take(moved & (cut.dim > 0)).directed(), s.take(whole))


def _joined(a: Segments, b: Segments) -> Segments:
    return Segments(
        np.r_[a.group, b.group], np.r_[a.dim, b.dim], np.concatenate([a.xy, b.xy]), np.r_[a.weight, b.weight]
    )


def _merged(s: Segments) -> tuple[Segments, np.ndarray]:
    """Coinciding segments as one: weights of areas added up; the flag says a line is among them."""
    order = np.lexsort((s.xy[:, 3], s.xy[:, 2], s.xy[:, 1], s.xy[:, 0], s.group))
    s = s.take(order)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (s.group[1:] != s.group[:-1]) | (s.xy[1:] != s.xy[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    if not len(first):
        return s, np.zeros(0, bool)
    weight = np.add.reduceat(np.where(s.dim == 2, s.weight, 0), first)
    lines = np.add.reduceat((s.dim == 1).astype(int), first) > 0
    kept = s.take(first)
    kept.weight = weight
    return kept, lines


def _depth(walls: Segments, group: np.ndarray, point: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Depth just above ``point`` and left of wall ``own``: signed walls met by a ray to the left."""
    order = np.lexsort((point[:, 1], group))
    group, point, own = group[order], point[order], own[order]
    upright = np.flatnonzero(walls.xy[:, 1] != walls.xy[:, 3])
    up = walls.xy[upright, 3] > walls.xy[upright, 1]
    xy = np.where(up[:, None], walls.xy[upright], walls.xy[upright][:, [2, 3, 0, 1]])
    weight = np.where(up, walls.weight[upright], -walls.weight[upright])
    low = _count_before(group, point[:, 1], walls.group[upright], xy[:, 1], ties=False)
    high = _count_before(group, point[:, 1], walls.group[upright], xy[:, 3], ties=False)
    depth = np.zeros(len(group))
    for wall, query in _ranges(low, high):
        right_of = (_side(xy[wall, :2], xy[wall, 2:], point[query]) < 0) & (upright[wall] != own[query])
        depth += np.bincount(query[right_of], weights=-weight[wall[right_of]], minlength=len(group))
    result = np.empty(len(group))
    result[order] = depth
    return np.rint(result).astype(int)


def union_boundary(s: Segments, low: np.ndarray, high: np.ndarray, closed: np.ndarray) -> Segments:
    """Boundary of each group's union inside its strip ``low <= y < high`` (one value per group).

    Area parts come out with the interior on their left, lines and points that no area
    covers come out once. ``closed`` groups get the strip's own edges added where the
    strip is covered, so that the strip is a polygon of its own.
    """
    s = s.directed()
    s = s.take(np.lexsort((s.xy[:, 0], s.group)))
    at, points = _meeting_points(s)
    for border in (low, high):
        more_at, more_points = _border_points(s, border[s.group])
        at, points = np.r_[at, more_at], np.concatenate([points, more_points])
    parts = _split(s, at, points)

    spots = parts.take(parts.dim == 0)
    edges, is_line = _merged(parts.take(parts.dim > 0))
    ends = edges
    middle = (edges.xy[:, :2] + edges.xy[:, 2:]) / 2
    here = (middle[:, 1] >= low[edges.group]) & (middle[:, 1] < high[edges.group])
    edges, is_line, middle = edges.take(here), is_line[here], middle[here]

    left = _depth(edges, edges.group, middle, np.arange(len(edges.group)))
    # From here on sides are those of the segment pointing up, or to +x when level.
    falling = edges.xy[:, 3] < edges.xy[:, 1]
    weight = np.where(falling, -edges.weight, edges.weight)
    right = left - weight
    on_edge = (weight != 0) & (np.minimum(left, right) <= 0) & (np.maximum(left, right) >= 1)
    if closed.any():
        # The strip below owns nothing on this strip's lower edge; that edge is drawn by the closing.
        level = (edges.xy[:, 1] == edges.xy[:, 3]) & (edges.xy[:, 1] == low[edges.group])
        on_edge &= ~(closed[edges.group] & level)
    reverse = falling ^ (left < 1)
    xy = np.where(reverse[:, None], edges.xy[:, [2, 3, 0, 1]], edges.xy)
    area = Segments(edges.group, np.full(len(left), 2), xy, weight).take(on_edge)
    if closed.any():
        area = _joined(area, _strip_edges(area, low, high, closed))

    free = is_line & (weight == 0) & (left < 1)
    lines = Segments(edges.group, np.full(len(left), 1), edges.xy, weight).take(free)

    return _joined(_joined(area, lines), _free_points(spots, ends, edges, low, high))


def _free_points(spots: Segments, ends: Segments, walls: Segments, low: np.ndarray, high: np.ndarray) -> Segments:
    """Distinct points that lie in no area and on no segment."""
    y = spots.xy[:, 1]
    spots = spots.take((y >= low[spots.group]) & (y < high[spots.group]))
    spots, _ = _merged(spots)
    if not len(spots.group):
        return spots
    covered = _depth(walls, spots.group, spots.xy[:, :2], np.full(len(spots.group), -1)) >= 1
    # Segments were split at every point on them, so a point on a segment is one of its ends.
    taken = np.unique(
        np.column_stack([np.r_[ends.group, ends.group], np.concatenate([ends.xy[:, :2], ends.xy[:, 2:]])]), axis=0
    )
    both = np.concatenate([taken, np.column_stack([spots.group, spots.xy[:, :2]])])
    _, inverse = np.unique(both, axis=0, return_inverse=True)
    covered |= np.isin(inverse.ravel()[len(taken) :], inverse.ravel()[: len(taken)])
    free = spots.take(~covered)
    free.dim = np.zeros(len(free.group), int)
    return free


def _strip_edges(area: Segments, low: np.ndarray, high: np.ndarray, closed: np.ndarray) -> Segments:
    """Edges along the borders of closed strips, between boundary parts that reach the border."""
    out_group, out_xy = [np.zeros(0, int)], [np.zeros((0, 4))]
    for g in np.flatnonzero(closed):
        mine = area.xy[area.group == g]
        mine = mine[mine[:, 1] != mine[:, 3]]
        for border, bottom in ((low[g], True), (high[g], False)):
            if not np.isfinite(border):
                continue
            # Going along +x the union starts at a part that runs down and ends at one that runs up.
            start = (mine[:, 1] == border) | (mine[:, 3] == border)
            reach = mine[start]
            x = np.where(reach[:, 1] == border, reach[:, 0], reach[:, 2])
            step = np.where(reach[:, 3] < reach[:, 1], 1, -1)
            at, where = np.unique(x, return_inverse=True)
            depth = np.cumsum(np.bincount(where, weights=step, minlength=len(at)))
            inside = np.flatnonzero(depth[:-1] > 0)
            a = np.column_stack([at[inside], np.full(len(inside), border)])
            b = np.column_stack([at[inside + 1], np.full(len(inside), border)])
            out_group.append(np.full(len(inside), g))
            out_xy.append(np.hstack([a, b] if bottom else [b, a]))
    xy, group = np.concatenate(out_xy), np.concatenate(out_group)
    return Segments(group, np.full(len(group), 2), xy, np.ones(len(group), int))


def _vertices(group: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal points of the same group."""
    order = np.lexsort((points[:, 1], points[:, 0], group))
    group, points = group[order], points[order]
    fresh = np.r_[True, (group[1:] != group[:-1]) | (points[1:] != points[:-1]).any(axis=1)]
    numbers = np.empty(len(order), int)
    numbers[order] = np.cumsum(fresh) - 1
    return numbers


def successors(group: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary part the next one round its face, and the number of its first vertex.

    Where several faces meet in a vertex, a part arriving there goes on with the departing
    part that is next to it on its interior side.
    """
    count = len(xy)
    if not count:
        return np.zeros(0, int), np.zeros(0, int)
    vertex = _vertices(np.r_[group, group], np.concatenate([xy[:, :2], xy[:, 2:]]))
    away = xy[:, 2:] - xy[:, :2]
    angle = np.r_[np.arctan2(away[:, 1], away[:, 0]), np.arctan2(-away[:, 1], -away[:, 0])]
    order = np.lexsort((angle, vertex))
    starts = np.flatnonzero(np.r_[True, vertex[order[1:]] != vertex[order[:-1]]])
    previous = np.arange(len(order)) - 1
    previous[starts] = np.r_[starts[1:], len(order)] - 1
    follow = np.empty(count, int)
    arriving = order >= count
    follow[order[arriving] - count] = order[previous[arriving]]
    if (follow >= count).any():
        raise ValueError("boundary does not close")
    return follow, vertex[:count]


def _rings(xy: np.ndarray, follow: np.ndarray, tail: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed boundary parts, each passing a vertex at most once."""
    tail = tail - tail.min()
    unused = np.ones(len(xy), bool)
    busy = np.bincount(tail) > 1
    rings = []
    steps, vertices, shared = follow.tolist(), tail.tolist(), busy.tolist()
    for begin in range(len(steps)):
        if not unused[begin]:
            continue
        path, seen, part = [], {}, begin
        while unused[part]:
            unused[part] = False
            v = vertices[part]
            if shared[v]:
                if v in seen:
                    ring = path[seen[v] :]
                    del path[seen[v] :]
                    for p in ring:
                        seen.pop(vertices[p], None)
                    rings.append(ring)
                seen[v] = len(path)
            path.append(part)
            part = steps[part]
        if path:
            rings.append(path)
    return [_closed(xy[np.array(r), :2]) for r in rings]


def _closed(points: np.ndarray) -> np.ndarray:
    """Ring from its smallest vertex, first point repeated at the end."""
    start = np.lexsort((points[:, 1], points[:, 0]))[0]
    points = np.roll(points, -start, axis=0)
    return np.concatenate([points, points[:1]])


def _contains(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    crosses = (a[:, 1] <= point[1]) != (b[:, 1] <= point[1])
    a, b = a[crosses], b[crosses]
    x = a[:, 0] + (point[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool(np.count_nonzero(x < point[0]) % 2)


def _polygons(xy: np.ndarray, follow: np.ndarray, tail: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons as [shell, holes...], sorted by their shells' first vertices."""
    rings = [(signed_area(r), r) for r in _rings(xy, follow, tail)]
    shells = sorted(((abs(a), r) for a, r in rings if a > 0), key=lambda s: s[0])
    holes = [r for a, r in rings if a < 0]
    polygons = [[r] for _, r in shells]
    if holes and len(shells) == 1:
        polygons[0] += holes
    elif holes:
        boxes = np.array([[*r.min(axis=0), *r.max(axis=0)] for _, r in shells])
        for hole in holes:
            inner = (hole[0] + hole[1]) / 2
            near = (boxes[:, :2] <= hole.min(axis=0)).all(axis=1) & (boxes[:, 2:] >= hole.max(axis=0)).all(axis=1)
            # Shells are in order of size, so the first that contains the hole is its own.
            owner = next(i for i in np.flatnonzero(near) if _contains(shells[i][1], inner))
            polygons[owner].append(hole)
    for polygon in polygons:
        polygon[1:] = sorted(polygon[1:], key=lambda r: tuple(r[0]))
    return sorted(polygons, key=lambda p: (tuple(p[0][0]), tuple(p[0][1])))


def _chains(xy: np.ndarray) -> list[np.ndarray]:
    """Lines joined end to end through vertices where exactly two of them meet."""
    ends = np.concatenate([xy[:, :2], xy[:, 2:]])
    points, vertex = np.unique(ends, axis=0, return_inverse=True)
    vertex = vertex.ravel()
    count = len(xy)
    a, b = vertex[:count].tolist(), vertex[count:].tolist()
    touching: dict[int, list[int]] = {}
    for i in range(count):
        touching.setdefault(a[i], []).append(i)
        touching.setdefault(b[i], []).append(i)
    used = [False] * count

    def walk(vertex: int, segment: int) -> list[int]:
        path = [vertex]
        while not used[segment]:
            used[segment] = True
            vertex = b[segment] if a[segment] == vertex else a[segment]
            path.append(vertex)
            if len(touching[vertex]) != 2:
                break
            one, two = touching[vertex]
            segment = two if one == segment else one
        return path

    paths = [walk(v, s) for v in sorted(touching) if len(touching[v]) != 2 for s in touching[v] if not used[s]]
    paths += [walk(a[s], s) for s in range(count) if not used[s]]
    return [points[p] for p in paths]


def _pack(kind: int, body: bytes) -> bytes:
    return struct.pack("<BI", 1, kind) + body


def _coordinates(line: np.ndarray) -> bytes:
    return struct.pack("<I", len(line)) + np.ascontiguousarray(line, dtype="<f8").tobytes()


def _bundle(members: list[bytes], many: int) -> bytes:
    return members[0] if len(members) == 1 else _pack(many, struct.pack("<I", len(members)) + b"".join(members))


def link(
    area: np.ndarray, follow: np.ndarray, tail: np.ndarray, lines: np.ndarray, points: np.ndarray
) -> bytes | None:
    """One WKB geometry from boundary parts, lines and points, in a canonical form."""
    found = []
    if len(points):
        members = [_pack(POINT, p.astype("<f8").tobytes()) for p in points[np.lexsort((points[:, 1], points[:, 0]))]]
        found.append(_bundle(members, MULTIPOINT))
    if len(lines):
        found.append(_bundle([_pack(LINE, _coordinates(c)) for c in _chains(lines)], MULTILINE))
    if len(area):
        members = [
            _pack(POLYGON, struct.pack("<I", len(p)) + b"".join(_coordinates(r) for r in p))
            for p in _polygons(area, follow, tail)
        ]
        found.append(_bundle(members, MULTIPOLYGON))
    return _bundle(found, COLLECTION) if found else None
