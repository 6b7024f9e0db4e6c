"""Corner choice and projective maps as plain code, for the tests of the column expressions."""

import numpy as np

from tramline.schemas import DEFAULT, Params


def corners_of(points: list[tuple[float, float]], p: Params = DEFAULT) -> list[tuple[float, float]] | None:
    """Top left, top right, bottom right, bottom left of the court among `points`, or None if they don't look like one."""
    if len(points) < 4:
        return None
    if len(points) > 4:
        sums, diffs = [x + y for x, y in points], [x - y for x, y in points]
        extreme = {sums.index(min(sums)), diffs.index(max(diffs)), sums.index(max(sums)), diffs.index(min(diffs))}
        points = [points[i] for i in sorted(extreme)] if len(extreme) == 4 else points[:4]
    by_y = sorted(points, key=lambda q: q[1])
    (tl, tr), (bl, br) = (sorted(half, key=lambda q: q[0]) for half in (by_y[:2], by_y[2:]))
    corners = [tl, tr, br, bl]
    xs, ys = [q[0] for q in corners], [q[1] for q in corners]
    return None if max(xs) - min(xs) < p.min_court_w or max(ys) - min(ys) < p.min_court_h else corners


def solve_homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float] | None:
    """The 9 numbers of the projective map that takes four points to four points; None if there is none, as with three points in a line."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        h = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0)
    except np.linalg.LinAlgError:
        return None
    at = h.reshape(3, 3) @ np.column_stack([np.array(src, float), np.ones(4)]).T
    if not np.isfinite(h).all() or (at[2] * np.sign(at[2, 0]) <= 1e-9).any() or np.abs(at[:2] / at[2] - np.array(dst, float).T).max() > 1e-3:
        return None
    return h.tolist()
