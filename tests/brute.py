"""The order-dependent steps written out plainly: everything is looked at again at every step, nothing is kept sorted."""

import math

import numpy as np


def all_distances(n, edges):
    far = [[0.0 if a == b else math.inf for b in range(n)] for a in range(n)]
    for a, b, cost in edges:
        far[a][b] = far[b][a] = min(far[a][b], cost)
    for _ in range(n):
        again = False
        for a in range(n):
            for b, c, cost in edges:
                for x, y in ((b, c), (c, b)):
                    if far[a][x] + cost < far[a][y]:
                        far[a][y], again = far[a][x] + cost, True
        if not again:
            break
    return far


def farthest(n, edges, nodes, count):
    own = [(a, b, c) for a, b, c in edges if a in nodes and b in nodes]
    far, chosen = all_distances(n, own), [min(nodes)]
    while len(chosen) < min(count, len(nodes)):
        left = [f for f in nodes if f not in chosen]
        most = max(min(far[s][f] for s in chosen) for f in left)
        chosen.append(min(f for f in left if min(far[s][f] for s in chosen) == most))
    return chosen


def grow(n, edges, area, seeds, mean_area, alpha, zeta=0.1):
    both = [(a, b, c) for x, y, c in edges for a, b in ((x, y), (y, x))]
    label, at, size, claims = {f: r for r, f in enumerate(seeds)}, {f: 0.0 for f in seeds}, {r: float(area[f]) for r, f in enumerate(seeds)}, []
    while True:
        offers = []
        for region in size:
            reach = {}
            for a, b, cost in both:
                if label.get(a) == region and b not in label:
                    reach[b] = min(reach.get(b, math.inf), at[a] + cost)
            weight = (max(size[region], zeta * mean_area) / mean_area) ** alpha[region]
            offers += [(d * weight, f, region, d) for f, d in reach.items()]
        if not offers:
            return [label.get(f, -1) for f in range(n)], claims
        key, face, region, d = min(offers)
        label[face], at[face] = region, d
        size[region] += float(area[face])
        claims.append((face, region, key))


def islands(n, edges, label):
    root = list(range(n))
    for _ in range(n):
        for a, b, _ in edges:
            if label[a] == label[b]:
                root[a] = root[b] = min(root[a], root[b])
    return root


def dump(n, edges, area, label, regions):
    label, root, moves = list(label), islands(n, edges, label), []
    before = list(label)
    size = [sum(area[f] for f in range(n) if label[f] == r) for r in range(regions)]
    for region in sorted({x for x in before if x >= 0}):
        parts = {}
        for f in range(n):
            if before[f] == region:
                parts.setdefault(root[f], []).append(f)
        keeper = min(parts, key=lambda r: (-sum(area[f] for f in parts[r]), r))
        for r in sorted(set(parts) - {keeper}):
            around = {label[b] for a, b, _ in edges if a in parts[r]} | {label[a] for a, b, _ in edges if b in parts[r]}
            around -= {region, -1}
            if around:
                to = min(around, key=lambda x: (size[x], x))
                for f in parts[r]:
                    label[f] = to
                size[region] -= sum(area[f] for f in parts[r])
                size[to] += sum(area[f] for f in parts[r])
                moves.append((r, region, to))
    return label, moves


def medoid(n, edges, nodes):
    merged = {}
    for a, b, cost in edges:
        if a in nodes and b in nodes:
            merged[min(a, b), max(a, b)] = merged.get((min(a, b), max(a, b)), 0.0) + cost
    far = all_distances(n, [(a, b, c) for (a, b), c in merged.items()])
    return min(nodes, key=lambda f: (sum(far[f][g] for g in nodes), f))


def elongation(points):
    if len(points) < 2:
        return 1.0
    off = np.array(points) - np.mean(points, axis=0)
    values = np.sort(np.linalg.eigvals(off.T @ off / len(points)).real)
    return float(values[2] / max(values[1], values[2] * 1e-9, 1e-300))


def relax(n, edges, area, centroids, sides, seeds, mean_area, diagonal, i_max=15, epsilon=0.25):
    """Records of (label, deviation, seam, score), the best one's place."""
    alpha, records = [1.5] * len(seeds), []
    while True:
        label, _ = grow(n, edges, area, seeds, mean_area, alpha)
        label, _ = dump(n, edges, area, label, len(seeds))
        size = [sum(area[f] for f in range(n) if label[f] == r) for r in range(len(seeds))]
        long = [elongation([centroids[f] for f in range(n) if label[f] == r]) for r in range(len(seeds))]
        deviation = max(abs(x - mean_area) for x in size) / mean_area
        seam = sum(length for length, faces in sides if len({label[f] for f in faces}) > 1)
        records.append((label, deviation, seam, deviation + seam / diagonal + (sum(min(x, 20.0) for x in long) / len(long) - 1) / 19))
        if deviation <= epsilon or len(records) == i_max:
            return records, min(range(len(records)), key=lambda k: records[k][3])
        alpha = [min(a + 0.5, 3.0) if x > 2.5 else a for a, x in zip(alpha, long, strict=True)]
        seeds = [medoid(n, edges, [f for f in range(n) if label[f] == r]) for r in range(len(seeds))]


def refine(points, faces, a_max, corners=None):
    """(points, faces, sources, corner points per face): corners are a second position of each corner of each face."""
    points = [np.array(p, float) for p in points]
    live = {k: (tuple(f), k, None if corners is None else [np.array(c, float) for c in corners[k]]) for k, f in enumerate(faces)}
    fresh = len(faces)
    area = lambda f: 0.5 * np.linalg.norm(np.cross(points[f[1]] - points[f[0]], points[f[2]] - points[f[0]]))
    while large := [k for k in live if area(live[k][0]) > a_max]:
        f = live[min(large)][0]
        ends = max((tuple(sorted((f[j], f[j - 2]))) for j in range(3)), key=lambda e: (np.linalg.norm(points[e[0]] - points[e[1]]), e))
        points.append((points[ends[0]] + points[ends[1]]) / 2)
        for k in sorted(k for k in live if set(ends) <= set(live[k][0])):
            f, source, own = live.pop(k)
            for turn in range(3):
                a, b, c = (f[(turn + j) % 3] for j in range(3))
                if {a, b} == set(ends):
                    p = None if own is None else [own[(turn + j) % 3] for j in range(3)]
                    middle = None if own is None else (p[0] + p[1]) / 2
                    live[fresh] = (a, len(points) - 1, c), source, None if own is None else [p[0], middle, p[2]]
                    live[fresh + 1] = (len(points) - 1, b, c), source, None if own is None else [middle, p[1], p[2]]
                    fresh += 2
                    break
    order = sorted(live)
    return points, [live[k][0] for k in order], [live[k][1] for k in order], [live[k][2] for k in order]
