"""A plain row-at-a-time statement of the comparison rules, for small inputs only."""

from itertools import combinations, permutations


def is_number(v):
    return isinstance(v, (int, float))


def norm(v):
    if is_number(v):
        return float(v)
    if v is None or v.strip().lower() in ("null", "none", ""):
        return None
    try:
        return float(v.strip())
    except ValueError:
        return v.strip().lower()


def number(v):
    if is_number(v):
        return float(v)
    try:
        return float(v.replace("%", "").replace(",", ""))
    except (ValueError, AttributeError):
        return None


def yes_or_no(v):
    if isinstance(v, str):
        w = v.lower().strip()
        return 1 if w in ("1", "true", "yes", "t", "y") else 0 if w in ("0", "false", "no", "f", "n") else v
    return v


def bag(values):
    out = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def order(v):
    return (0, "") if v is None else (1, float(v)) if is_number(v) else (2, v)


def strict(p, g, ordered):
    if not p or not g:
        return not p and not g
    if not ordered:
        return bag(v for r in p for v in r) == bag(v for r in g for v in r)
    return len(p) == len(g) and len(p[0]) == len(g[0]) and all(
        sorted(a, key=order) == sorted(b, key=order) for a, b in zip(p, g))


def near(a, b):
    x, y = number(a), number(b)
    if x is None or y is None:
        return norm(a) == norm(b)
    if y == 0:
        return x == 0
    r = x / y
    return 0.99 < r < 1.01 or 99 < r < 101 or 0.0099 < r < 0.0101


def close(a, b):
    x, y = norm(a), norm(b)
    return abs(x - y) <= 0.01 if is_number(x) and is_number(y) else x == y


def positional(p, g):
    cells = [(a, b) for r, s in zip(p, g) for a, b in zip(r, s)]
    if all(near(a, b) for a, b in cells):
        return "percentage"
    if all(yes_or_no(a) == yes_or_no(b) for a, b in cells):
        return "boolean"
    return "tolerance" if all(close(a, b) for a, b in cells) else None


def normalized(p, g, ordered):
    a, b = [tuple(map(norm, r)) for r in p], [tuple(map(norm, r)) for r in g]
    return a == b if ordered else bag(a) == bag(b)


def mapping(wide, narrow):
    w, n = len(wide[0]), len(narrow[0])
    if w > 10 or n > 5:
        return None
    best, best_score = None, 0
    for cols in combinations(range(w), n):
        for perm in permutations(cols):
            score = sum(norm(a[i]) == norm(b[j]) for a, b in zip(wide, narrow) for j, i in enumerate(perm))
            if score > best_score:
                best, best_score = perm, score
    return best if best and best_score >= 0.5 * len(wide) * n else None


def flex(p, g, ordered, similarity=None):
    if not p or not g:
        return "empty" if not p and not g else "none"
    wp, wg = len(p[0]), len(g[0])
    if len(p) == len(g):
        if wp == wg:
            rule = positional(p, g) or ("normalized" if normalized(p, g, ordered) else None)
            if rule:
                return rule
        wide, narrow = (p, g) if wp >= wg else (g, p)
        m = mapping(wide, narrow)
        if m and not (wp == wg and list(m) == list(range(wg))):
            cut = [tuple(r[i] for i in m) for r in wide]
            a, b = (cut, g) if wp >= wg else (p, cut)
            rule = positional(a, b) or ("normalized" if normalized(a, b, ordered) else None)
            if rule:
                return ("mapped+" if wp == wg else "wide+" if wp > wg else "narrow+") + rule
    if not ordered and similarity is not None and similarity > 0.7:
        have, need = bag(norm(v) for r in p for v in r), bag(norm(v) for r in g for v in r)
        return "subset" if all(have.get(v, 0) >= n for v, n in need.items()) else "none"
    return "strict" if strict(p, g, ordered) else "none"


def greedy(results, ordered):
    """Kept positions; a result of None is a failure."""
    kept = []
    for j, r in enumerate(results):
        def falls_to(i):
            q = results[i]
            if r is None:
                return q is None
            if q is None:
                return not r
            return strict(q, r, ordered[i] or ordered[j])
        if not any(falls_to(i) for i in kept):
            kept.append(j)
    return kept


def cells_of(example, side, query, rows):
    for i, row in enumerate(rows or []):
        for j, v in enumerate(row):
            kind = "null" if v is None else "num" if is_number(v) else "str"
            yield (example, side, query, i, j, kind, float(v) if is_number(v) else None, v if isinstance(v, str) else None)
