"""Small numpy kernels for bounded groups of points: hulls and triangulations."""

from __future__ import annotations

import numpy as np

TIE = 1e-9
#: Numbers that a step of gift wrapping holds in one array.
HELD = 100_000


def hull_2d(points: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counter-clockwise; fewer than three if the points are collinear."""
    order = np.lexsort((points[:, 1], points[:, 0]))

    def chain(ids: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                a, b = points[out[-2]], points[out[-1]]
                if (b[0] - a[0]) * (points[i][1] - a[1]) - (b[1] - a[1]) * (points[i][0] - a[0]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(list(dict.fromkeys(lower[:-1] + upper[:-1])) or [int(order[0])])


def hull_facets_3d(points: np.ndarray) -> list[np.ndarray]:
    """The facets of the convex hull in space, each the indices of its corners in order around it; none if the points are coplanar.

    Gift wrapping by planes: at each edge of a facet its plane turns until it meets further points. Coplanar
    points make one facet, so ties need no choice.
    """
    scale = np.ptp(points, axis=0).max() if len(points) else 0.0
    if len(points) < 4 or scale == 0:
        return []
    p = (points - points.mean(axis=0)) / scale
    if np.linalg.matrix_rank(p - p[0], tol=TIE) < 3:
        return []

    def facet(normal: np.ndarray) -> np.ndarray:
        """The corners of the facet with this outward normal, counter-clockwise from outside."""
        heights = p @ normal
        on = np.flatnonzero(heights > heights.max() - TIE)
        u = np.cross(normal, [1.0, 0, 0] if abs(normal[0]) < 0.9 else [0, 1.0, 0])
        u /= np.linalg.norm(u)
        return on[hull_2d(np.stack([p[on] @ u, p[on] @ np.cross(normal, u)], axis=1))]

    todo = [_supporting_normal(p)]
    facets: dict[tuple[int, ...], np.ndarray] = {}
    while todo:
        normal = todo.pop()
        corners = facet(normal)
        key = tuple(sorted(corners.tolist()))
        if key in facets:
            continue
        facets[key] = corners
        for i, j in zip(corners, np.roll(corners, -1), strict=True):
            along = (p[j] - p[i]) / np.linalg.norm(p[j] - p[i])
            inward = np.cross(normal, along)
            gaps = p - p[i]
            out, depth = -(gaps @ inward), -(gaps @ normal)
            below = depth > TIE
            turn = np.arctan2(depth[below], out[below]).min()
            todo.append(np.cos(turn) * normal - np.sin(turn) * inward)
    return list(facets.values())


def _supporting_normal(p: np.ndarray) -> np.ndarray:
    """The outward normal of a plane through three of the points that has all others on one side."""
    a = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0]))[0]]
    for b in p:
        normals = np.cross(b - a, p - a)
        sizes = np.linalg.norm(normals, axis=1)
        normals = normals[sizes > TIE] / sizes[sizes > TIE, None]
        heights = (p - a) @ normals.T
        low, high = heights.min(axis=0), heights.max(axis=0)
        for ok, sign in ((high < TIE, 1), (low > -TIE, -1)):
            if ok.any():
                return sign * normals[np.flatnonzero(ok)[0]]
    raise ValueError("degenerate point set")


def triangulate(points: np.ndarray, ids: np.ndarray, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Delaunay triangles (indices, counter-clockwise), their circumcentres and radii; with ``core``, a mask, those that have a corner in it.

    Gift wrapping: the left neighbour of an edge is the point whose circle through the edge has its centre lowest; many edges are taken at
    once. A walk begins at a node and the one nearest to it, whose edge any triangulation has, and crosses edges with an end in ``core`` alone.
    Points on one circle make one polygon, fanned from its smallest id. Points must be distinct.
    """
    none = np.zeros((0, 3), dtype=int), np.zeros((0, 2)), np.zeros(0)
    if len(points) < 3 or (core is None and len(hull_2d(points)) < 3):
        return none
    n, x, y = len(points), points[:, 0], points[:, 1]
    wanted = np.ones(n, dtype=bool) if core is None else np.asarray(core, dtype=bool)
    inside, done, todo = wanted.tolist(), set(), {}
    corners, centres, radii = [], [], []

    def walk() -> None:
        while todo:
            edges = [todo.popitem()[0] for _ in range(min(len(todo), max(1, HELD // n)))]
            i, j = np.array(edges).T
            half = (points[j] - points[i]) / 2
            middle, normal, size = points[i] + half, np.stack([-half[:, 1], half[:, 0]], axis=1), (half**2).sum(axis=1)
            gx, gy = x - x[i, None], y - y[i, None]
            left = gx * normal[:, :1] + gy * normal[:, 1:]
            ok = left > TIE * size[:, None]
            each = np.arange(len(edges))
            ok[each, i] = ok[each, j] = False
            t = np.full(left.shape, np.inf)
            np.divide(gx * (gx - 2 * half[:, :1]) + gy * (gy - 2 * half[:, 1:]), 2 * left, out=t, where=ok)
            best = t.min(axis=1)
            met = np.isfinite(best)
            best = np.where(met, best, 0.0)
            row, at = np.nonzero(t <= (best + TIE * (1 + np.abs(best)))[:, None])
            ends = np.searchsorted(row, np.arange(len(edges) + 1))
            centre, radius = middle + best[:, None] * normal, np.sqrt((1 + best**2) * size)
            for k, edge in enumerate(edges):
                if edge in done:
                    continue
                if not met[k]:
                    done.add(edge)
                    continue
                on = at[ends[k] : ends[k + 1]].tolist()
                ring = [*edge, *on]
                if len(on) > 1:
                    gaps = points[ring] - centre[k]
                    ring = np.array(ring)[np.argsort(np.arctan2(gaps[:, 1], gaps[:, 0]))]
                    ring = np.roll(ring, -int(np.argmin(ids[ring]))).tolist()
                for b, c in zip(ring[1:-1], ring[2:], strict=True):
                    corners.append((ring[0], b, c))
                    centres.append(centre[k])
                    radii.append(radius[k])
                for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
                    done.add((a, b))
                    if (inside[a] or inside[b]) and (b, a) not in done:
                        todo[b, a] = None

    seen, at = np.zeros(n, dtype=bool), 0
    for v in np.flatnonzero(wanted).tolist():
        if seen[v]:
            continue
        gaps = (x - x[v]) ** 2 + (y - y[v]) ** 2
        gaps[v] = np.inf
        near = int(np.argmin(gaps))
        for edge in ((v, near), (near, v)):
            todo[edge] = None
            walk()
        for triangle in corners[at:]:
            seen[list(triangle)] = True
        at = len(corners)
    return (np.array(corners), np.array(centres), np.array(radii)) if corners else none


def tetrahedralise(points: np.ndarray, ids: np.ndarray, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Delaunay tetrahedra (indices), their circumcentres and radii; with ``core``, a mask, those that have a corner in it.

    From each face the next point is the one whose sphere through the face has its centre lowest; many faces are taken at once. A walk begins
    at the smallest circle through a node and the one nearest to it, whose own sphere is empty, and crosses faces with a corner in ``core`` alone. Points on one sphere make one
    cell; its facets are fanned from their smallest ids and joined to the cell's smallest id. Points must be distinct; none if they are coplanar.
    """
    none = np.zeros((0, 4), dtype=int), np.zeros((0, 3)), np.zeros(0)
    if not hull_facets_exist(points):
        return none
    scale, shift = np.ptp(points, axis=0).max(), points.mean(axis=0)
    p, n = (points - shift) / scale, len(points)
    x, y, z = p.T.copy()
    wanted = np.ones(n, dtype=bool) if core is None else np.asarray(core, dtype=bool)
    inside, done, todo = wanted.tolist(), set(), {}
    corners, centres, radii = [], [], []

    def turned(a: int, b: int, c: int) -> tuple[int, int, int]:
        return (a, b, c) if a < b and a < c else (b, c, a) if b < c else (c, a, b)

    def cell_of(cell: np.ndarray, centre: np.ndarray, radius: float) -> list[tuple[int, int, int]]:
        """Notes the tetrahedra of a cell of more than four points; its outer triangles, counter-clockwise from outside."""
        first, outer = int(cell[np.argmin(ids[cell])]), []
        for ring in hull_facets_3d(p[cell]):
            ring = cell[ring]
            ring = np.roll(ring, -int(np.argmin(ids[ring])))
            fan = [(int(ring[0]), int(b), int(c)) for b, c in zip(ring[1:-1], ring[2:], strict=True)]
            outer += fan
            if first not in ring:
                for triangle in fan:
                    corners.append((first, *triangle))
                    centres.append(centre)
                    radii.append(radius)
        return outer

    def walk() -> None:
        while todo:
            faces = [todo.popitem()[0] for _ in range(min(len(todo), max(1, HELD // n)))]
            held = np.array(faces)
            a = p[held[:, 0]]
            u, v = p[held[:, 1]] - a, p[held[:, 2]] - a
            normal = np.cross(u, v)
            area = (normal**2).sum(axis=1)[:, None]
            middle = np.cross((u**2).sum(axis=1)[:, None] * v - (v**2).sum(axis=1)[:, None] * u, normal) / (2 * area)  # from a
            normal /= np.sqrt(area)
            gx, gy, gz = x - a[:, :1], y - a[:, 1:2], z - a[:, 2:]
            height = gx * normal[:, :1] + gy * normal[:, 1:2] + gz * normal[:, 2:]
            beyond = gx * (gx - 2 * middle[:, :1]) + gy * (gy - 2 * middle[:, 1:2]) + gz * (gz - 2 * middle[:, 2:])
            ok = height > TIE
            each = np.arange(len(faces))[:, None]
            ok[each, held] = False
            t = np.full(height.shape, np.inf)
            np.divide(beyond, 2 * height, out=t, where=ok)
            best = t.min(axis=1)
            met = np.isfinite(best)
            best = np.where(met, best, 0.0)
            level = (np.abs(height) <= TIE) & (np.abs(beyond) <= TIE)  # the face's own circle may hold further points
            level[each, held] = False
            row, at = np.nonzero((t <= (best + TIE * (1 + np.abs(best)))[:, None]) | level)
            ends = np.searchsorted(row, np.arange(len(faces) + 1))
            centre, radius = a + middle + best[:, None] * normal, np.sqrt(best**2 + (middle**2).sum(axis=1))
            for k, face in enumerate(faces):
                if face in done:
                    continue
                if not met[k]:
                    done.add(face)
                    continue
                on = at[ends[k] : ends[k + 1]].tolist()
                if len(on) == 1:
                    (i, j, m), o = face, on[0]
                    corners.append((i, j, m, o))
                    centres.append(centre[k])
                    radii.append(radius[k])
                    outer = [(i, m, j), (i, j, o), (j, m, o), (m, i, o)]
                else:
                    outer = cell_of(np.array([*face, *on]), centre[k], radius[k])
                for i, j, m in outer:  # counter-clockwise from outside, so turned round from within
                    done.add(turned(i, m, j))
                    if inside[i] or inside[j] or inside[m]:
                        out = turned(i, j, m)
                        if out not in done:
                            todo[out] = None

    seen, at = np.zeros(n, dtype=bool), 0
    for s in np.flatnonzero(wanted).tolist():
        if seen[s]:
            continue
        face = _smallest_circle(p, s)
        if face is None:
            continue
        for i, j, m in (face, (face[0], face[2], face[1])):
            if len(corners) == at:
                todo[turned(i, j, m)] = None
                walk()
        for cell in corners[at:]:
            seen[list(cell)] = True
        at = len(corners)
    return (np.array(corners), np.array(centres) * scale + shift, np.array(radii) * scale) if corners else none


def _smallest_circle(p: np.ndarray, s: int) -> tuple[int, int, int] | None:
    """The node ``s``, the one nearest to it, and the third that makes the smallest circle with them; none if all are on a line."""
    gaps = p - p[s]
    square = (gaps**2).sum(axis=1)
    square[s] = np.inf
    near = int(np.argmin(square))
    area = np.linalg.norm(np.cross(gaps[near], gaps), axis=1)
    sides = square[near] * square
    ok = area > TIE * np.sqrt(sides)
    ok[[s, near]] = False
    if not ok.any():
        return None
    across = ((gaps - gaps[near]) ** 2).sum(axis=1)
    third = np.flatnonzero(ok)[np.argmin(sides[ok] * across[ok] / area[ok] ** 2)]
    return s, near, int(third)


def hull_facets_exist(points: np.ndarray) -> bool:
    """Whether points in space aren't all in one plane."""
    scale = np.ptp(points, axis=0).max() if len(points) else 0.0
    return len(points) > 3 and scale > 0 and np.linalg.matrix_rank((points - points[0]) / scale, tol=TIE) == 3
