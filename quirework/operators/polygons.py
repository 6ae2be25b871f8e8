"""From a detector's probability map to quads in the image, and from quads to upright crops. Arrays of one page; nothing crosses pages."""

from __future__ import annotations

import numpy as np

from quirework.operators.pagealgorithms import label_components

# A pixel is text above the first, a component above the second; growth; least sides before and after it; most candidates of a page.
FOREGROUND, SCORE, GROWTH, SIDE, GROWN_SIDE, CANDIDATES = 0.3, 0.6, 1.5, 3, 5, 1000


def away(x) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x).astype(np.int64)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise in a frame whose y points up."""
    pts = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for run in (pts, pts[::-1]):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return np.array(halves)


def area(points: np.ndarray) -> float:
    x, y = np.asarray(points, float).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners (upper left, upper right, lower right, lower left; whole numbers) and shorter side of the rectangle of least area.

    One side of it lies on a side of the hull, so each is tried.
    """
    corners = hull(points)
    edge = np.roll(corners, -1, 0) - corners
    length = np.hypot(*edge.T)
    if len(corners) < 2 or not (length > 0).any():
        return np.repeat(away(corners[:1]), 4, 0), 0.0
    along = edge[length > 0] / length[length > 0, None]
    across = np.stack((-along[:, 1], along[:, 0]), 1)
    a, b = corners @ along.T, corners @ across.T
    sizes = np.stack((np.ptp(a, 0), np.ptp(b, 0)))
    k = int(np.argmin(np.round(sizes.prod(0), 9)))
    ends = [(x, y) for x in (a[:, k].min(), a[:, k].max()) for y in (b[:, k].min(), b[:, k].max())]
    quad = np.array([x * along[k] + y * across[k] for x, y in ends])
    quad = quad[np.argsort(np.round(quad[:, 0], 9), kind="stable")]
    left, right = (pair[np.argsort(np.round(pair[:, 1], 9), kind="stable")] for pair in (quad[:2], quad[2:]))
    return away(np.round(np.array([left[0], right[0], right[1], left[1]]), 9)), float(sizes[:, k].min())


def grown(points: np.ndarray, ratio: float = GROWTH) -> np.ndarray:
    """The hull of a polygon grown by area * ratio / perimeter, outer corners cut square at that distance."""
    points = np.asarray(points, float)
    side = np.roll(points, -1, 0) - points
    perimeter = float(np.hypot(*side.T).sum())
    if not perimeter:
        return points
    d = area(points) * ratio / perimeter
    corners = hull(points)
    if len(corners) < 3:
        return corners
    edge = np.roll(corners, -1, 0) - corners
    out = np.stack((edge[:, 1], -edge[:, 0]), 1) / np.hypot(*edge.T)[:, None]
    before = np.roll(out, 1, 0)
    turn = np.arctan2(before[:, 0] * out[:, 1] - before[:, 1] * out[:, 0], (before * out).sum(1))
    t = np.tan(turn / 4)[:, None]
    ahead, back = np.stack((-before[:, 1], before[:, 0]), 1), np.stack((out[:, 1], -out[:, 0]), 1)
    return away(np.concatenate((corners + d * (before + t * ahead), corners + d * (out + t * back))))


def mean_inside(prob: np.ndarray, points: np.ndarray) -> float:
    """Mean of the map over a polygon with its border; 0 for one without width or height."""
    points = np.asarray(points, float)
    top = np.maximum(np.floor(points.min(0)), 0).astype(int)
    low = np.minimum(np.ceil(points.max(0)), [prob.shape[1] - 1, prob.shape[0] - 1]).astype(int)
    if (low <= top).any():
        return 0.0
    x, y = np.meshgrid(np.arange(top[0], low[0] + 1), np.arange(top[1], low[1] + 1))
    inside, border = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0), strict=True):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        steps = int(max(abs(bx - ax), abs(by - ay))) + 1
        line = away(np.linspace((ax, ay), (bx, by), steps)) - top
        line = line[((line >= 0) & (line <= low - top)).all(1)]
        border[line[:, 1], line[:, 0]] = True
    chosen = inside | border
    return float(prob[top[1] : low[1] + 1, top[0] : low[0] + 1][chosen].astype(np.float64).mean())


def outline(cells: np.ndarray) -> np.ndarray:
    """Border cells of one component, as (x, y): its hull suffices for rectangles, so rows' ends are taken."""
    y, x = np.nonzero(cells)
    first = {}
    for a, b in zip(y.tolist(), x.tolist(), strict=True):
        lo, hi = first.get(a, (b, b))
        first[a] = (min(lo, b), max(hi, b))
    return np.array([(lo, a) for a, (lo, _) in sorted(first.items())] + [(hi, a) for a, (_, hi) in sorted(first.items(), reverse=True)])


def quads(prob: np.ndarray, width: int, height: int) -> np.ndarray:
    """(n, 4, 2) text quads in an image of the given size, in the order of their components."""
    labels = label_components(prob > np.float32(FOREGROUND))
    scale = np.float32([prob.shape[1] / width, prob.shape[0] / height])
    out = []
    for label in np.unique(labels[labels >= 0])[:CANDIDATES]:
        points = outline(labels == label)
        if (np.ptp(points, 0) + 1 < SIDE).any() or mean_inside(prob, points) < SCORE or smallest_rectangle(points)[1] < SIDE:
            continue
        wide = grown(points)
        if len(wide) < 3:
            continue
        quad, side = smallest_rectangle(wide)
        if side < GROWN_SIDE:
            continue
        quad = np.clip(away(quad / scale), 0, [width - 1, height - 1])
        if min(int(np.hypot(*(quad[0] - quad[1]))), int(np.hypot(*(quad[0] - quad[3])))) > 3:
            out.append(quad)
    return np.array(out, np.int64).reshape(-1, 4, 2)


def crop_map(quad: np.ndarray, height: int = 48, most: int = 4000) -> tuple[np.ndarray, int, bool]:
    """(3 x 3 map from crop to image, crop width, turned) of a quad; tall ones are read turned."""
    quad = np.asarray(quad, np.float32)
    wide, high = np.float32(np.hypot(*(quad[0] - quad[1]))), np.float32(np.hypot(*(quad[0] - quad[3])))
    turned = bool(high >= wide * np.float32(1.5))
    if turned:
        quad, wide, high = np.roll(quad, 1, 0), high, wide
    width = max(1, min(int(np.ceil(np.float32(height) * (wide / high))), most)) if high > 0 else 1
    return projective(np.float32([(0, 0), (width, 0), (width, height), (0, height)]), quad), width, turned


def projective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix (32-bit, last entry 1) that takes four points to four others; zeros if there is none."""
    a, b = np.zeros((8, 8)), np.asarray(target, float).reshape(8)
    for i, ((x, y), (u, v)) in enumerate(zip(np.asarray(source, float), np.asarray(target, float), strict=True)):
        a[2 * i] = [x, y, 1, 0, 0, 0, -u * x, -u * y]
        a[2 * i + 1] = [0, 0, 0, x, y, 1, -v * x, -v * y]
    try:
        return np.append(np.linalg.solve(a, b), 1.0).reshape(3, 3).astype(np.float32)
    except np.linalg.LinAlgError:
        return np.zeros((3, 3), np.float32)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at points; beyond the edge the edge goes on."""
    high, wide = image.shape[:2]
    x, y = np.clip(x, 0, wide - 1), np.clip(y, 0, high - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, wide - 1), np.minimum(y0 + 1, high - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    img = image.astype(np.float32)
    return (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def crop(image: np.ndarray, quad: np.ndarray, height: int = 48, most: int = 4000) -> np.ndarray:
    """height x width x channels, -1 to 1."""
    to_image, width, _ = crop_map(quad, height, most)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, w = np.einsum("ij,jyx->iyx", to_image, np.stack((x, y, np.ones_like(x))).astype(np.float32))
    w = np.where(w == 0, np.float32(1), w)
    return sample(image, u / w, v / w) / np.float32(127.5) - 1


def resized(image: np.ndarray, width: int, height: int, mean=(0.485, 0.456, 0.406), deviation=(0.229, 0.224, 0.225)) -> np.ndarray:
    """channels x height x width, scaled with pixel centres at halves and normalised."""
    x = (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    y = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5
    out = sample(image, *np.meshgrid(x, y)) / 255
    return ((out - np.float32(mean)) / np.float32(deviation)).transpose(2, 0, 1).astype(np.float32)
