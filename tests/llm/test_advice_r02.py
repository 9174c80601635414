"""What a review found missing, next to plain versions."""

import random

import corpus_pipeline
from sqlverdict.llm import lines, queries, quotes
from tests.llm import brute


def line_dedup(docs, run=3, words=5):
    """Text of each document without later repeats of three lines, or of fewer with so many words."""
    seen, out = set(), {}
    for d in sorted(docs):
        split = (docs[d] or "").split("\n")
        places = [k for k, line in enumerate(split) if line.strip(brute.BLANKS)]
        gone = set()
        for s in range(len(places)):
            for n in range(1, min(run, len(places) - s) + 1):
                body = tuple(split[k].strip(brute.BLANKS) for k in places[s:s + n])
                if n == run or sum(len(brute.WORD.findall(x)) for x in body) >= words:
                    if body in seen:
                        gone |= set(places[s:s + n])
                    seen.add(body)
        out[d] = "\n".join(x for k, x in enumerate(split) if k not in gone)
    return out


def test_line_dedup_by_words(spark):
    """Repeats on one or two lines, with blank lines between, next to repeats of short lines that stay."""
    rng = random.Random(12)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 30)))) for _ in range(40)]
    rows = {k: "\n".join(rng.choice((" ", "")) + rng.choice(pool) for _ in range(rng.randrange(12))) for k in range(150)}
    rows |= {-1: None, 1000: "once only " * 30, 1001: "once only " * 30, 1002: "a b", 1003: "a b", 1004: "p q r\ns t\n1", 1005: "2\np q r\n \ns t"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    want = line_dedup(rows)
    got = {r["doc_id"]: r["text"] or "" for r in lines.remove_repeats(docs, words=lines.WORDS).collect()}
    assert got == want
    assert (want[1001], want[1003], want[1005]) == ("", "a b", "2\n ")


def test_quotes_inside_messages(spark):
    """A sentence of a longer line, rewrapped lines, two of three paragraphs; too few words stay open."""
    first = "One two three four five six. Short one! Seven eight nine ten\neleven twelve thirteen.\n\nSecond part goes on here.\n\nThird part."
    messages = [
        (0, first), (1, "Nothing. One two three four."), (2, "> Short one!\na"), (3, "> seven eight nine\n> ten ELEVEN twelve\nb"),
        (4, "> thirteen.\n>\n> Second part goes\n> on here.\nc"), (5, "> two three four\nd"), (6, "> One two three four.\ne"),
        (7, "> two three four five seven\nf"), (8, "> said only later on by nine\ng"), (9, "h said only later on by nine i")]
    docs = spark.createDataFrame([(1, t, "u", x) for t, x in messages] + [(2, 0, "u", "> Short one!")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in quotes.conversations(docs).collect()}
    assert got == {(1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 6): 1, **{(1, k): None for k in (0, 1, 5, 7, 8, 9)}, (2, 0): None}


def test_short_items_and_unspaced_scripts(spark, tmp_path):
    """Items of one to four words are found unchanged, items without spaces inside a longer run of characters."""
    rows = {1: "so a quick, QUICK fox ran", 2: "quick brown fox", 3: "昨日、この文章は評価の問題ですと言った", 4: "この文章は評価の答題です", 5: "この本は別です", 6: None, 7: "foxes"}
    items = {10: "Quick fox", 11: "この文章は評価の問題です", 12: "fox"}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: list(r["item_ids"]) for r in queries.op2_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: [10, 12], 2: [12], 3: [11], 4: [11], 5: [], 6: [], 7: []}
    assert {r["doc_id"] for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()} == {5, 6, 7}
