"""Features of the classifier, where leaks start, short and unspaced items, and quotes next to plain versions."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from sqlverdict.llm import decontam, quality_model, quotes
from tests.llm import brute


def test_scores_are_means_over_features(spark):
    """Scores from running sums equal the mean weight of the features that training sees."""
    rng = random.Random(1)
    texts = ["", "a", "ab", "a a", "日本語 日本語 テキスト", "é", "\U0001F600 x \U0001F600"] + [
        " ".join(rng.choice(["ab", "日本", "abc", "é", "x"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    weights = np.random.default_rng(2).normal(0, 3, quality_model.BUCKETS).astype(np.float32)
    for repeats in (True, False):
        model = quality_model.Model(weights, 0.25, repeats)
        found = docs.selectExpr("doc_id", "text", "0 AS label").mapInArrow(
            lambda b: quality_model._features(b, repeats), "doc_id long, label int, buckets binary, counts binary").collect()
        got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
        assert len(got) == len(found) == len(texts)
        for r in found:
            buckets, counts = np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<u4")
            text = texts[r["doc_id"]]
            words = text.split(" ") if text else []
            pairs = list(itertools.pairwise(words))
            size = len(words) + len(pairs) + repeats * sum(a == b for a, b in pairs) + max(0, len(text) - 2) + max(0, len(text) - 3)
            assert counts.sum() == size, text
            mean = (weights[buckets].astype(np.float64) * counts).sum() / max(size, 1)
            assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(mean + 0.25)))) < 1e-6


def test_grams_are_of_characters():
    """Texts that share no character share no gram, whatever their bytes have in common."""
    def grams(text):
        data = np.frombuffer(text.encode(), np.uint8)
        characters, first = quality_model._characters(data, np.array([0, len(data)]))
        assert first.tolist() == [0, len(text)] and len(characters) == len(text)
        return characters.tolist()

    for text in ("abc", "aé日\U0001F600b", "日本語"):
        codes = grams(text)
        assert len(set(codes)) == len(set(text))
    assert not set(grams("日本")) & set(grams("旤朮"))


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_leaks_give_the_stretch_itself(spark):
    """The words from start to end are as far from the item as reported, and no part of them at the end is as near."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.randrange(5, 25))] for k in range(25)}
    rows = []
    for k in range(80):
        words = list(items[rng.randrange(25)])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice(([], ["zz"], [words[at], "yy"]))
        before = [rng.choice(["u", "v", *vocabulary]) for _ in range(rng.randrange(12))]
        rows.append((k, " ".join(before + words + ["u"] * rng.randrange(3))))
    texts = {k: t.split() for k, t in rows}
    found = decontam.hits(spark.createDataFrame(rows, "doc_id long, text string"),
                          spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()
    assert len(found) > 60
    for r in found:
        item, text = items[r["item_id"]], texts[r["doc_id"]]
        assert r["errors"] == brute.edit_distance(item, text) == _levenshtein(item, text[r["start"]:r["end"]])
        assert all(_levenshtein(item, text[s:r["end"]]) > r["errors"] for s in range(r["start"] + 1, r["end"] + 1))


def _unspaced(c):
    return any(low <= c <= high for low, high in (("฀", "࿿"), ("က", "႟"), ("぀", "ヿ"), ("一", "鿿")))


def _plain_words(text):
    """Runs of word characters in lower case, but each character of an unspaced script by itself."""
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if re.match(r"\w", c) and not _unspaced(c):
            run += c
            continue
        out += [run] if run else []
        run = ""
        if re.match(r"\w", c):
            out.append(c)
    return out


def test_short_and_unspaced_items(spark):
    """As the query and the pipeline search: items from one word on, characters as words."""
    rng = random.Random(10)
    alphabet = ["no", "such", "thing", "日", "本", "語", "です", "ไทย", "x1", "é"]

    def text(n):
        return "".join(rng.choice(alphabet) + rng.choice(["", " ", ", "]) for _ in range(n))

    items = {k: text(rng.randrange(1, 9)) for k in range(30)} | {30: "zebra", 31: "", 32: "!?", 33: "日本語です"}
    rows = [(k, text(rng.randrange(0, 14)) if k % 3 else "u " + items[rng.randrange(30)] + " u") for k in range(150)] + [(900, None), (901, "Zebra!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {}
    for d, t in rows:
        words = _plain_words(t)
        want[d] = {}
        for k, item in items.items():
            item = _plain_words(item)
            if item and (e := brute.edit_distance(item, words)) <= int(0.2 * len(item)):
                want[d][k] = e
    got = {d: {} for d, _ in rows}
    for r in decontam.hits(docs, table, least=1).collect():
        got[r["doc_id"]][r["item_id"]] = r["errors"]
    assert got == want and sum(map(bool, want.values())) > 50
    assert {r["doc_id"] for r in decontam.clean(docs, table, least=1).collect()} == {d for d, found in want.items() if not found}


def _plain_conversations(messages):
    """Quote linking and threads from dictionaries."""
    def norm(text):
        return " ".join(text.lower().split())

    by_conv = {}
    for conv, turn, text in messages:
        by_conv.setdefault(conv, {})[turn] = text
    out = {}
    for conv, turns in by_conv.items():
        parsed = {}
        for turn, text in turns.items():
            lines = text.split("\n")
            marks = [re.match(r"(?:[ \t]*>)*", line).group() for line in lines]
            levels = [m.count(">") for m in marks]
            own = [line for k, line in enumerate(lines) if not levels[k] and not (
                k + 1 < len(lines) and levels[k + 1] and line.endswith("wrote:"))]
            bodies = [(level, [lines[k][len(marks[k]):] for k in at]) for level, at in
                      ((level, list(at)) for level, at in itertools.groupby(range(len(lines)), lambda k: levels[k])) if level]
            parsed[turn] = "\n".join(own).strip("\n") if bodies else text, bodies
        first = {}
        for turn in sorted(parsed):
            said = parsed[turn][0]
            for part in [said, *re.split(r"\n[ \t]*\n", said), *said.split("\n")]:
                if norm(part):
                    first.setdefault(norm(part), turn)

        def inside(words, turn):
            for t in sorted(t for t in parsed if t < turn):
                said = parsed[t][0]
                if len(words.split()) >= quotes.GRAM:
                    if f" {words} " in f" {norm(said)} ":
                        return t
                elif any(norm(s) == words for s in re.split(r"(?<=[.!?…])\s+", said)):
                    return t
            return None

        reply, counts = {}, {}
        for turn, (_, bodies) in parsed.items():
            linked, n = [], 0
            for level, lines in bodies:
                words = norm("\n".join(lines))
                if not words:
                    continue
                n += 1
                at = first.get(words)
                if at is None or at >= turn:
                    at = inside(words, turn)
                if at is None and len(lines) > 1:
                    at = max((first[norm(x)] for x in lines if first.get(norm(x), turn) < turn), default=None)
                if at is not None:
                    linked.append((-level, at))
            reply[turn], counts[turn] = max(linked)[1] if linked else None, (n, len(linked))
        for turn in parsed:
            root, depth = turn, 0
            while reply[root] is not None:
                root, depth = reply[root], depth + 1
            out[conv, turn] = (root, reply[turn], depth, *counts[turn], parsed[turn][0])
    return out


def test_quotes_next_to_plain_version(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcd" for b in "aei"] + ["Yes", "no"]

    def sentence():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) + rng.choice(".!?")

    def wrap(words):
        lines = []
        while words:
            n = rng.randrange(1, 8)
            lines.append(" ".join(words[:n]))
            words = words[n:]
        return lines

    def quote(text):
        """A part of a message, quoted once more than it may be already."""
        kind, lines = rng.randrange(6), text.split("\n")
        words = text.replace(">", "").split()
        if kind == 0:
            part = lines
        elif kind == 1:
            part = [rng.choice(lines)]
        elif kind == 2:
            part = re.split(r"(?<=[.!?])\s+", " ".join(words))[:1]
        elif kind == 3 and words:
            at = rng.randrange(len(words))
            part = wrap(words[at:at + rng.randrange(1, 15)])
        elif kind == 4:
            part = [sentence(), rng.choice(lines)]
        else:
            part = wrap([w.upper() for w in words])
        return "\n".join(rng.choice(["> ", ">", "  >  "]) + x for x in part)

    messages = []
    for conv in range(40):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            parts = ["X wrote:"] if rng.random() < 0.3 else []
            for _ in range(rng.randrange(3) if texts else 0):
                parts.append(quote(rng.choice(texts)))
                parts += [sentence()] if rng.random() < 0.7 else []
            parts += [" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3))]
            texts.append(rng.choice(["\n", "\n\n"]).join(parts))
            messages.append((conv, turn, texts[-1]))
    want = _plain_conversations(messages)
    rows = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["thread"], r["reply_to"], r["depth"], r["n_passages"], r["n_linked"], r["text"])
           for r in quotes.conversations(rows).collect()}
    assert got == want
    depths = Counter(v[2] for v in want.values())
    assert sum(v[4] for v in want.values()) > 80 and max(depths) >= 2
