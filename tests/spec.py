"""The rules in a few lines of plain Python, to compare the Spark operators with."""

from decimal import ROUND_HALF_UP, Decimal


def pack(sizes, limit, opens=None, closes=None):
    opens, closes = opens or [False] * len(sizes), closes or [False] * len(sizes)
    starts, size, at = [], -1, -1
    for i, n in enumerate(sizes):
        if size < 0 or opens[i] or size + n > limit:
            size, at = 0, i
        size += n + 1
        starts.append(at)
        if closes[i]:
            size = -1
    return starts


def greedy(hits, k, penalty=0.35):
    """hits: (id, doc, score); repeatedly take the best damped one."""
    pool, seen, out = list(hits), {}, []
    while pool and len(out) < k:
        best = max(pool, key=lambda h: (h[2] / (1 + penalty * seen.get(h[1], 0)), h[2], -h[0]))
        pool.remove(best)
        seen[best[1]] = seen.get(best[1], 0) + 1
        out.append(best[0])
    return out


def half_up(x, d):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


def doc_ids(paths, existing, slug):
    """Own stems first, then stem-folder, then numbers, each in path order."""
    taken, out, clash = set(existing), {}, []
    for p in sorted(paths):
        base = slug(p.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        base = "doc-" + base if base.startswith("calc") else base
        if base in taken:
            clash.append((p, base))
        else:
            out[p] = base
            taken.add(base)
    rest = []
    for p, base in clash:
        folder = p.split("/")[-2] if "/" in p else "root"
        want = f"{base}-{slug(folder)}"
        if want in taken:
            rest.append((p, base))
        else:
            out[p] = want
            taken.add(want)
    for p, base in rest:
        n = 2
        while f"{base}-{n}" in taken:
            n += 1
        out[p] = f"{base}-{n}"
        taken.add(out[p])
    return out
