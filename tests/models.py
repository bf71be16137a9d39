"""Plain sequential models of the grid operators, for comparison on small grids.

Grids are lists of rows; None is no data.
"""

import math

STEP = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}
CODES = list(STEP)


def cells(g):
    return [(i, j) for i in range(len(g)) for j in range(len(g[0]))]


def at(g, p):
    return g[p[0]][p[1]] if 0 <= p[0] < len(g) and 0 <= p[1] < len(g[0]) else None


def to(fd, p):
    """Receiver with data, or None."""
    s = STEP.get(at(fd, p))
    q = s and (p[0] + s[0], p[1] + s[1])
    return q if q and at(fd, q) is not None else None


def d8(z, dist=lambda row, code: math.hypot(*STEP[code])):
    def code(p):
        if at(z, p) is None:
            return None
        best, out = 0.0, 0
        for c, (dr, dc) in STEP.items():
            n = at(z, (p[0] + dr, p[1] + dc))
            if n is not None and (at(z, p) - n) / dist(p[0], c) > best:
                best, out = (at(z, p) - n) / dist(p[0], c), c
        return out

    return [[code((i, j)) for j in range(len(z[0]))] for i in range(len(z))]


def accumulate(fd, weight=lambda p: 1):
    waiting = {p: 0 for p in cells(fd) if at(fd, p) is not None}
    for p in waiting:
        if to(fd, p):
            waiting[to(fd, p)] += 1
    total = {p: weight(p) for p in waiting}
    ready = [p for p, n in waiting.items() if not n]
    done = set(ready)
    while ready:
        p = ready.pop()
        q = to(fd, p)
        if q:
            total[q] += total[p]
            waiting[q] -= 1
            if not waiting[q]:
                ready.append(q)
                done.add(q)
    return [[total.get((i, j)) for j in range(len(fd[0]))] for i in range(len(fd))], {p for p in waiting if p not in done}


def watershed(fd, pour):
    basin, edge = {pour}, [pour]
    while edge:
        q = edge.pop()
        for p in cells(fd):
            s = STEP.get(at(fd, p))
            if s and (p[0] + s[0], p[1] + s[1]) == q and p not in basin:
                basin.add(p)
                edge.append(p)
    return [[(i, j) in basin for j in range(len(fd[0]))] for i in range(len(fd))]


def strahler(fd):
    flowing = [[d if d in STEP else None for d in r] for r in fd]
    _, rings = accumulate(flowing)
    order = {}

    def of(p):
        if p not in order:
            ups = sorted((of(q) for q in cells(flowing) if to(flowing, q) == p and q not in rings), reverse=True)
            order[p] = 1 if not ups else ups[0] + (len(ups) > 1 and ups[1] == ups[0])
        return order[p]

    return [[of((i, j)) if flowing[i][j] is not None and (i, j) not in rings else None for j in range(len(fd[0]))] for i in range(len(fd))]


def river_tree(fd, acc, mask=None):
    ok = {p for p in cells(fd) if at(fd, p) in STEP and (at(acc, p) or 0) > 0 and (mask is None or at(mask, p))}
    claimed, segments = {}, []
    for start in sorted(ok, key=lambda p: (-at(acc, p), p)):
        if start in claimed:
            continue
        path = [start]
        claimed[start] = 0
        while True:
            p, best = path[-1], None
            for k, c in enumerate(CODES):
                q = (p[0] + STEP[c][0], p[1] + STEP[c][1])
                if q in ok and q not in claimed and STEP[at(fd, q)] == (-STEP[c][0], -STEP[c][1]):
                    if best is None or at(acc, q) >= at(acc, best):
                        best = q
            if best is None:
                break
            claimed[best] = 0
            path.append(best)
        if len(path) > 1:
            segments.append(path)
            for p in path:
                claimed[p] = len(segments)
    tree = [[claimed.get((i, j), 0) or None for j in range(len(fd[0]))] for i in range(len(fd))]
    return tree, [(*s[0], *s[-1], len(s), at(acc, s[0])) for s in segments]


def mask_runs(fd, seeds, mask):
    out = []
    for mr, mc, hr, hc, n, _ in seeds:
        p, run, path = (hr, hc), [], []
        for _ in range(n):
            path.append(p)
            if p == (mr, mc):
                break
            s = STEP.get(at(fd, p))
            p = s and (p[0] + s[0], p[1] + s[1])
            if not p or at(fd, p) is None:
                break
        for p in [*path, None]:
            if p and at(mask, p):
                run.append(p)
            else:
                if len(run) > 1:
                    out.append((*run[-1], *run[0], len(run)))
                run = []
    return out


def network(fd):
    degree = {}
    for p in cells(fd):
        if at(fd, p) is not None and to(fd, p):
            degree[to(fd, p)] = degree.get(to(fd, p), 0) + 1
    out = []
    for p in cells(fd):
        if at(fd, p) is None or degree.get(p, 0) == 1:
            continue
        path = [p]
        while (q := to(fd, path[-1])) is not None:
            path.append(q)
            if degree.get(q, 0) > 1:
                break
        if len(path) > 1:
            out.append(path)
    return out


def blocks(h, w, k, up=True):
    f = math.ceil if up else math.floor
    return [(i, j) for i in range(f(h / k)) for j in range(f(w / k))]


def block_max(acc, i, j, k):
    v = [at(acc, (r, c)) for r in range(i * k, i * k + k) for c in range(j * k, j * k + k) if at(acc, (r, c)) is not None]
    return max(v, default=None)


def nsa(acc, k):
    n, m = math.ceil(len(acc) / k), math.ceil(len(acc[0]) / k)
    top = [[block_max(acc, i, j, k) for j in range(m)] for i in range(n)]
    flipped = [[None if v is None else -v for v in r] for r in top]
    return d8(flipped)


def central_pixel(acc, i, j, k, shift):
    best = None
    for r in range(i * k - shift, i * k - shift + k):
        for c in range(j * k - shift, j * k - shift + k):
            v = at(acc, (r, c)) if r >= 0 and c >= 0 else None
            if v is not None:
                lr, lc = r - (i * k - shift), c - (j * k - shift)
                key = (-v, (lr - (k - 1) / 2) ** 2 + (lc - (k - 1) / 2) ** 2, lr, lc)
                if best is None or key < best[0]:
                    best = key, (r, c)
    return best and best[1]


def dmm_assigned(acc, k):
    n, m = len(acc) // k, len(acc[0]) // k
    top = [[block_max(acc, i, j, k) for j in range(m)] for i in range(n)]

    def code(i, j):
        p = central_pixel(acc, i, j, k, 0)
        if p is None:
            return None
        q = central_pixel(acc, (p[0] + k // 2) // k, (p[1] + k // 2) // k, k, k // 2)
        aim = q[0] // k, q[1] // k
        if aim == (i, j):
            best, out = top[i][j], 0
            for c, (dr, dc) in STEP.items():
                v = at(top, (i + dr, j + dc))
                if v is not None and v > best:
                    best, out = v, c
            return out
        step = next((c for c, s in STEP.items() if (i + s[0], j + s[1]) == aim), None)
        return step if step and aim[0] < n and aim[1] < m and top[aim[0]][aim[1]] > top[i][j] else 0

    return [[code(i, j) for j in range(m)] for i in range(n)], top


def straighten(d, h, rules):
    found = False
    for i in range(len(d) - 1):
        for j in range(len(d[0]) - 1):
            for (a, x, b, y, f, s, one, two, code) in rules:
                if d[i + a[0]][j + a[1]] == x and d[i + b[0]][j + b[1]] == y:
                    q = one if h[i + f[0]][j + f[1]] > h[i + s[0]][j + s[1]] else two
                    d[i + q[0]][j + q[1]] = code
                    found = True
    return found


def dmm(acc, k, rules):
    d, top = dmm_assigned(acc, k)
    h = [[-math.inf if v is None else v for v in r] for r in top]
    n, m = len(d), len(d[0])
    for i in range(n - 1):
        for j in range(m - 1):
            for x, (dr, dc), y in ((1, (0, 1), 16), (4, (1, 0), 64), (2, (1, 1), 32), (128, (-1, 1), 8)):
                if i + dr >= 0 and d[i][j] == x and d[i + dr][j + dc] == y:
                    if h[i][j] > h[i + dr][j + dc]:
                        d[i][j] = 0
                    else:
                        d[i + dr][j + dc] = 0
    for _ in range(4):
        if not straighten(d, h, rules):
            break
    for _ in range(4):
        found = False
        for p in cells(d):
            path = []
            while p and at(d, p) and p not in path and len(path) < 9:
                path.append(p)
                p = to(d, p)
            if p in path:
                ring = path[path.index(p) :]
                if 2 <= len(ring) <= 4 and all(max(x) - min(x) <= 1 for x in zip(*ring)):
                    q = min(ring, key=lambda q: at(h, q))
                    d[q[0]][q[1]] = 0
                    found = True
        if not found:
            break
    return d


def cotat(fd, acc, k, rules, threshold=0, mufp=None, metres=None):
    hh, ww = len(fd), len(fd[0])
    n, m = math.ceil(hh / k), math.ceil(ww / k)
    value = lambda p: at(acc, p) or 0
    outlet = {}
    for i, j in blocks(hh, ww, k):
        own = [(r, c) for r in range(i * k, i * k + k) for c in range(j * k, j * k + k)]
        valid = [p for p in own if at(fd, p) is not None]
        if not valid:
            continue
        if mufp is None:
            outlet[i, j] = max(own, key=lambda p: (value(p), -p[0], -p[1]))
            continue
        step = {p: (p[0] + STEP[at(fd, p)][0], p[1] + STEP[at(fd, p)][1]) for p in valid if at(fd, p) in STEP}
        top = max(valid, key=lambda p: (value(p), -p[0], -p[1]))
        exits = [p for p in valid if p in step and step[p] not in own]
        outlet[i, j] = top
        if top not in exits:
            continue
        count = dict.fromkeys(exits, 0)
        for p in valid:
            for _ in range(k * k):
                if p in count:
                    count[p] += 1
                    break
                p = step.get(p)
                if p not in valid:
                    break
        most = max(exits, key=lambda p: (count[p], -p[0], -p[1]))
        for p in sorted(exits, key=lambda p: (-value(p), p)):
            length, q = 0.0, p
            for _ in range(k * k):
                ups = [(q[0] + dr, q[1] + dc) for dr, dc in STEP.values() if step.get((q[0] + dr, q[1] + dc)) == q]
                if not ups:
                    break
                u = max(ups, key=value)  # the first of equals in compass order
                length += metres(q, u)
                q = u
            if length > mufp or p == most:
                outlet[i, j] = p
                break

    def trace(i, j):
        start = p = outlet[i, j]
        for _ in range(9 * k * k + 1):
            q = to(fd, p)
            if q is None:
                break
            b = q[0] // k, q[1] // k
            if abs(b[0] - i) > 1 or abs(b[1] - j) > 1:
                break
            p = q
            if outlet.get(b) == q and value(q) - value(start) > threshold:
                break
        else:
            return 0
        b = p[0] // k, p[1] // k
        return next((c for c, s in STEP.items() if (i + s[0], j + s[1]) == b), 0)

    d = [[trace(i, j) if (i, j) in outlet else None for j in range(m)] for i in range(n)]
    h = [[value(outlet[i, j]) if (i, j) in outlet else 0.0 for j in range(m)] for i in range(n)]
    straighten(d, h, rules)
    return d


def compare(fine, coarse, seeds, k, alpha=0.0, strict=False, cascade=False):
    out = []
    for mr, mc, hr, hc, n, _ in seeds:
        p, runs = (hr, hc), []
        for _ in range(n):
            c = p[0] // k, p[1] // k
            if at(coarse, c) is None and not (0 <= c[0] < len(coarse) and 0 <= c[1] < len(coarse[0])):
                break
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
            if p == (mr, mc):
                break
            p = to(fine, p)
            if p is None:
                break
        if len(runs) <= 1:
            out.append(-1.0)
            continue
        landed, off = {}, {}
        for ic, (c, _) in enumerate(runs[:-1]):
            steps, q = 0, c
            for _ in range(len(coarse) * len(coarse[0]) + 1):
                s = STEP.get(at(coarse, q))
                q = s and (q[0] + s[0], q[1] + s[1])
                if not q or not (0 <= q[0] < len(coarse) and 0 <= q[1] < len(coarse[0])):
                    break
                spots = [x for x, (d, _) in enumerate(runs) if d == q]
                if spots:
                    spots = [x for x in spots if (x > ic if strict or cascade else x != ic)]
                    if spots:
                        landed[ic], off[ic] = min(spots), steps
                    break
                steps += 1
        right = {len(runs) - 1: True}
        for ic in range(len(runs) - 2, -1, -1):
            right[ic] = ic in landed and (right[landed[ic]] if cascade else True)
        total = sum(n for _, n in runs[:-1])
        out.append(sum(n / (1 + off[ic] * alpha) for ic, (_, n) in enumerate(runs[:-1]) if right[ic]) / total)
    return out
