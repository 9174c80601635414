"""License scans, collocations and periodic runs next to plain versions."""

import collections
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sqlverdict.llm import collocations, double_array, licenses, queries_phrases, runs
from tests.llm import brute

ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a " * 3000), (-5, "x"), (-6, "a b " * 700 + "c"), (None, "a b a b a b a b"), (7, "x y"), (7, "x y"), (8, "\x1cé\x85 z" * 9)]
LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- licenses

def parse(tokens):
    """Recursive descent: or < and < with."""
    def level(k):
        left = simple(k + 1)
        while tokens and tokens[0].lower() == ("or", "and")[k]:
            tokens.pop(0)
            right = simple(k + 1)
            left = left[0] | right[0], (min, max)[k](left[1], right[1])
        return left

    def simple(k):
        if k < 2:
            return level(k)
        if tokens[0] == "(":
            tokens.pop(0)
            left = level(0)
            assert tokens.pop(0) == ")"
        else:
            label, weight = licenses.family(tokens.pop(0))
            left = {label} - {None}, weight
        while tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            left = left[0], left[1] / 2 if "exception" in tokens.pop(0).lower() else left[1]
        return left

    return level(0)


def random_expression(rng, depth=0):
    ids = ["MIT", "Apache-2.0", "GPL-2.0-only", "gpl-3.0+", "LGPL-2.1", "CC-BY-NC-4.0", "CC0-1.0", "LicenseRef-x", "Foo-1", "Unlicense"]
    if depth > 2 or rng.random() < 0.35:
        out = [rng.choice(ids)]
        return out + [rng.choice(("WITH", "with")), rng.choice(("Classpath-exception-2.0", "Foo-2"))] if rng.random() < 0.3 else out
    out = random_expression(rng, depth + 1)
    for _ in range(rng.randrange(1, 3)):
        out += [rng.choice(("AND", "OR", "and", "or")), *random_expression(rng, depth + 1)]
    return ["(", *out, ")"] if rng.random() < 0.5 else out


def test_license_expressions():
    rng = random.Random(1)
    for _ in range(500):
        tokens = random_expression(rng)
        rpn, valid = licenses.postfix(" ".join(tokens).replace("( ", "(").encode(), 0)
        labels, weight = licenses.evaluate(rpn)
        want = parse(list(tokens))
        assert valid and (set(labels), weight) == want and labels == sorted(labels)


@pytest.mark.parametrize("text, want", [
    ("MIT and we like it", (["MIT"], True)), ("(MIT OR GPL-2.0", (["MIT", "GPL-2.0", "or"], False)), ("MIT) x", (["MIT"], True)), ("", ([], True)),
    ("AND MIT", ([], True)), ("MIT AND", (["MIT"], True)), ("MIT.", (["MIT"], True)), ("MIT\nOR GPL", (["MIT"], True)), ("()", ([], True)),
    ("MIT Or GPL-2.0", (["MIT"], True)), ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", (["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "and"], True))])
def test_license_expression_ends(text, want):
    assert licenses.postfix(text.encode(), 0) == want


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrases, base in ((licenses.BASE, True), (licenses.NOTICES, False)):
        for phrase, label in phrases.items():
            p = phrase.split()
            found += [(i, len(p), label, base) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(found, key=str)


def test_license_places(spark):
    rng = random.Random(2)
    pool = [w for p in [*licenses.BASE, *licenses.NOTICES] for w in [p, p.upper(), p.replace(" ", ", "), p.replace(" ", "\n")]] + ["mit", "license", "İ", "é", "MİT license", "\x7f", "a1", "gnu", "K"]
    rows = ODD + [(100 + k, rng.choice((" ", "-", "\x00")).join(rng.choice(pool) for _ in range(rng.randrange(30)))) for k in range(300)]
    rows += [(5000, "mit license " * 5000), (5001, "é" * 40000 + " MIT License"), (5002, "mit mit license license general public license")]
    docs = spark.createDataFrame([(d, t, "c", 1.0) for d, t in rows], "doc_id long, text string, labels string, score double").repartition(5)
    got = collections.Counter((r["doc_id"], r["n_words"], str(sorted(map(tuple, r["places"]), key=str))) for r in licenses.scan(docs).collect())
    want = collections.Counter((d, n, str(found)) for d, t in rows if d is not None for n, found in [license_places(t)])
    assert got == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_query(spark, tmp_path):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx Mit License, y"), (2, "License-Expression = 'AGPL-3.0+'; MIT license mit LICENSE"),
            (3, None), (4, "spdx license identifier: nothing here"), (5, "GNU General Public License"), (None, "mit license"),
            (6, "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */"), (7, "# SPDX-License-Identifier: weird-thing OR MIT")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries_phrases.op11_license_scan(spark, str(tmp_path)).collect()}
    assert got == {
        1: (17, 1, 14, 14, "mit", "apache,gpl,mit", 0.2, "MIT GPL-2.0-only or Apache-2.0 and"), 2: (9, 2, 5, 7, "mit", "agpl,mit", 1.0, "AGPL-3.0+"),
        3: (0, 0, None, None, "", "", 0.0, ""), 4: (5, 0, None, None, "", "", 0.0, ""), 5: (4, 1, 1, 1, "gpl", "gpl", 0.9, ""),
        6: (11, 0, None, None, "", "gpl", 0.45, "GPL-2.0 Classpath-exception-2.0 with"), 7: (7, 0, None, None, "", "", 0.0, "")}


# ---------------------------------------------------------------- collocations

def collocations_of(rows, least, share, top):
    totals, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = collections.defaultdict(list)
    often = {key: n for key, n in f.items() if n >= least}
    dropped = {(lang, p[i:i + k]) for (lang, p), n in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * n >= share * f[lang, p[i:i + k]]}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in dropped:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k + 1): (p.decode(), -a, left, right, totals[lang], -s) for lang, x in found.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def result(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("bits, block, broadcast", [(26, 1 << 16, 48 << 20), (8, 400, 1)])
def test_collocations(spark, bits, block, broadcast, monkeypatch):
    """Bitmaps that are full, many blocks and a broadcast for each change nothing."""
    monkeypatch.setattr(collocations, "BROADCAST", broadcast)
    rng = random.Random(3)
    words = ["é", "É", "the", "The", "x\x1cy", "日本", "a-b", "\U0001F600", "q'"] + [f"w{k}" for k in range(14)]
    seps = [" "] * 9 + ["\t", ". ", ",", "!?", "\n", "\r", "  ", "\x0b", ";", ":"]
    rows = [(rng.choice(("en", "de", None, "und")), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60)))) for _ in range(250)]
    rows += [("en", None), ("en", ""), (None, " , "), ("fr", "same " * 3000), ("en", "one two three four. " * 25), ("en", "one two three four. " * 25)]
    docs = spark.createDataFrame([(None if k % 3 else 1, t, lang, "clash") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, rank string").repartition(5)
    for top in (2000, 7):
        want = collocations_of(rows, 6, 80, top)
        assert result(collocations.mine(docs, least=6, top=top, bits=bits, block=block)) == want and len(want) > 15
    assert collocations.mine(docs.limit(0), least=6, bits=bits).count() == 0
    assert collocations.mine(docs, least=10**6, bits=bits).count() == 0


def test_scores_pass_64_bits(spark):
    a = 3 * 10**18
    row = spark.sql(f"SELECT CAST(2000000 AS DECIMAL(7,0)) * CAST({a}L AS DECIMAL(19,0)) DIV (CAST({a + 7}L AS DECIMAL(19,0)) + CAST({a + 9}L AS DECIMAL(19,0))) AS s").first()
    assert row["s"] == 2000000 * a // (2 * a + 16)


def test_double_array():
    rng = np.random.default_rng(4)
    for size, vocabulary in ((1, 3), (50, 5), (3000, 400), (4000, 90000)):
        entries = {(str(rng.integers(3)), tuple(b"%d" % x for x in rng.integers(vocabulary, size=rng.integers(1, 5)))) for _ in range(size)}
        labels, phrases = zip(*sorted(entries))
        trie = double_array.build(list(labels), [list(p) for p in phrases])
        codes = {w: k + 1 for k, w in enumerate(trie.words)}
        for k, (label, phrase) in enumerate(zip(labels, phrases)):
            text = np.array([codes[w] for w in phrase])
            met = double_array.walk(trie, np.where(np.arange(len(text)) == 0, trie.roots[label], -1), text, np.full(len(text), len(text)), 4)
            assert k in met and set(met) == {labels_at for labels_at in met if phrases[labels_at] == phrase[:len(phrases[labels_at])] and labels[labels_at] == label}
    with_nothing = double_array.build([], [])
    assert not len(double_array.walk(with_nothing, np.full(3, -1), np.ones(3, int), np.full(3, 3), 4))


# ---------------------------------------------------------------- periodic runs

def runs_of(words):
    """All runs by trying each period from every start."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:j + q]
            if length >= max(6, 4 * q) and all(part[d:] != part[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(rows):
    out = []
    for d, text in rows:
        words = brute.WORD.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs_of(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        out.append((d, len(found), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
                    brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def test_runs_of_random_words():
    rng = random.Random(5)
    for k in range(400):
        words = []
        while len(words) < rng.randrange(1, 120):
            unit = [rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(1, 9))]
            words += (unit * rng.randrange(1, 9))[:rng.randrange(1, 60)] + [rng.randrange(50) for _ in range(rng.randrange(3))]
        codes = np.array(words)
        parts = runs.segments(codes, np.zeros(len(codes), np.int64))
        got = sorted(((int(p[0]) + s, m, q) for p in parts for s, m, q in runs.scan(codes[p])), key=lambda r: (r[0], r[2]))
        assert got == runs_of(words)
        assert runs.scan(codes) == runs_of(words)


def test_runs_of_binary_words():
    """All words over two letters: powers, overlapping runs and roots of roots."""
    for n in (6, 9, 13):
        for words in itertools.product((0, 1), repeat=n):
            assert runs.scan(np.array(words)) == runs_of(list(words))


def test_periodic_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for r in ODD if r[0] is not None]
    for k in range(400):
        words = [f"w{rng.randrange(rng.choice((2, 30, 400)))}" for _ in range(rng.randrange(1, 90))]
        rows.append((k * 7 + 100, rng.choice((" ", "\n", "\t \x0b")).join(words)))
    spark.createDataFrame([(d, t, "c", 5) for d, t in rows + [(None, "x")]], "doc_id long, text string, runs string, n int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries_phrases.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = periodic(rows)
    assert collections.Counter(got) == collections.Counter(want) and sum(r[1] > 0 for r in want) > 20
    assert runs.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_run():
    """A million equal words, and a long period in the middle of other words, take no quadratic time."""
    assert runs.scan(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    rng = np.random.default_rng(7)
    unit, rest = rng.integers(1000, size=20_000), rng.integers(1000, size=5000)
    found = runs.scan(np.concatenate([rest, np.tile(unit, 6), rest[::-1]]))
    assert [r[2] for r in found] == [20_000] and 120_000 <= found[0][1] <= 120_004
