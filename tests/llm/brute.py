"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, run=3, words=5):
    """Lines of a run of three, or of fewer with so many words, go where the run stood earlier."""
    first, parsed = {}, {}

    def windows(bodies):
        for s in range(len(bodies)):
            for n in range(1, min(run, len(bodies) - s) + 1):
                if n == run or sum(len(WORD.findall(x)) for x in bodies[s:s + n]) >= words:
                    yield s, n, tuple(bodies[s:s + n])

    for d in sorted(docs):
        lines = (docs[d] or "").split("\n")
        places = [k for k, line in enumerate(lines) if line.strip(BLANKS)]
        parsed[d] = lines, places, [lines[k].strip(BLANKS) for k in places]
        for s, _, body in windows(parsed[d][2]):
            first.setdefault(body, (d, s))
    out = {}
    for d, (lines, places, bodies) in parsed.items():
        gone = {k for s, n, body in windows(bodies) if first[body] != (d, s) for k in places[s:s + n]}
        out[d] = len(places), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def edit_distance(pattern, text):
    """Least edit distance of the pattern to a stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def leaks(docs, items, rate=0.2, least=5):
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in items.items()}
    out = {}
    for d, text in docs.items():
        text = re.findall(r"\w+", (text or "").lower())
        out[d] = {k: e for k, w in words.items() if len(w) >= least and (e := edit_distance(w, text)) <= int(rate * len(w))}
    return out


def near_dedup(docs, words=4, share=80):
    lower = {c: c + 32 for c in range(65, 91)}
    sets, holders = {}, collections.defaultdict(list)
    for d, t in docs.items():
        w = WORD.findall((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])
        holders[sets[d]].append(d)
    reps = [s for s in holders if s]
    root = list(range(len(reps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(reps):
        both = collections.Counter(j for g in s for j in index[g])
        for j, n in both.items():
            if 100 * n >= share * (len(s) + len(reps[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            index[g].append(i)
    groups = collections.defaultdict(list)
    for i, s in enumerate(reps):
        groups[find(i)] += holders[s]
    out = {d: (0, d, True) for d in holders.get(frozenset(), [])}
    for ids in groups.values():
        out |= {d: (len(sets[d]), min(ids), d == min(ids)) for d in ids}
    return out


BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0))


def secrets(text):
    counts, found = [], []
    for k, (name, pattern, group, least, flags) in enumerate(BASE):
        hits = [m for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
        counts.append(len(hits))
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in hits]
    labels = ",".join(x[2] for x in sorted(found))
    return *counts, sha(labels), labels


def substring_dedup(docs, window=20):
    first, words = {}, {}
    for d in sorted(docs):
        w = words[d] = WORD.findall(docs[d] or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (d, i):
                gone |= set(range(i, i + window))
        out[d] = len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def warc(pages):
    payload = {k: (html or "").encode() for k, html in pages.items()}
    first = {}
    for k in sorted(payload):
        first.setdefault(payload[k], k)
    out = {}
    for k, b in payload.items():
        f = first[b] if len(b) >= 100 else k
        out[k] = len(b), hashlib.sha256(b).hexdigest(), "revisit" if f < k else "response", f if f < k else None
    return out
