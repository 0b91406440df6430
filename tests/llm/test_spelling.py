"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from stockpilot.llm import spelling


def near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) > len(y):
        x, y = y, x
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def brute(rows, least=7, count=2, ratio=10, every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), form[w] and n[form[w]]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string")


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_words_against_all_pairs(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 20))) for _ in range(25)] + ["a" * 7, "a" * 8, "a" * 9, "ab" * 8, "ab" * 20]
    words = list(base)
    for _ in range(500):
        w = rnd.choice(words)
        at = rnd.randrange(len(w) + 1)
        words.append(rnd.choice([w[:at] + rnd.choice("abé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice("abÉ") + w[at + 1 :]]))
    rows = [(i, " ".join(rnd.choices(words, k=40) + rnd.choices(base[:4], k=rnd.randint(0, 60)))) for i in range(60)]
    assert found(spelling.spelling_variants(frame(spark, rows))) == brute(rows)


def test_chains_lead_to_one_root(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    got = {r.word: r for r in spelling.spelling_variants(frame(spark, rows), every=0).collect()}
    assert {w: (r.form, r.root, r.n) for w, r in got.items()} == {
        "aaaaaaa": ("aaaaaab", "aaaabbb", 2), "aaaaaab": ("aaaaabb", "aaaabbb", 20),
        "aaaaabb": ("aaaabbb", "aaaabbb", 200), "aaaabbb": (None, "aaaabbb", 2000),
    }


def test_edges(spark):
    long = "x" * 300_000
    rows = [(None, "Straßen straßen"), (1, None), (2, ""), (2, "abcdefg ABCDEFG"), (2, "abcdefg"), (3, "ÀBCDEFG Àbcdefg àbcdefg àbcdefg"),
            (4, f"{long} {long}"), (5, f"{long}y {long}y"), (6, "a1b2 _ 漢字漢字漢字漢字 ×÷×÷×÷× ×÷×÷×÷×")]
    assert found(spelling.spelling_variants(frame(spark, rows))) == brute(rows)
    assert found(spelling.spelling_variants(frame(spark, []))) == set()


def test_other_columns_and_flushes(spark, monkeypatch):
    rows = [(i, "wordone wordtwo wordone wordtoo") for i in range(50)]
    want = brute(rows)
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as `a.b`", "4 as `key`")
    assert found(spelling.spelling_variants(docs)) == want
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    assert found(spelling.spelling_variants(docs)) == want


@pytest.mark.parametrize("x,y,is_near", [("abcdefg", "abcdefgh", True), ("abcdefg", "bcdefgh", False), ("abcdefg", "habcdefg", True), ("aabcdefg", "abcdefgg", False), ("abcdefg", "abXdefg", True)])
def test_near_pairs_once(spark, x, y, is_near):
    words = spark.createDataFrame([(x, 1), (y, 2)], "word string, n long")
    assert spelling.near_pairs(words).count() == is_near


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = [(i, "alphabet alphabat alphabet") for i in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spelling.op13_spelling(spark, str(tmp_path))) == brute(rows)
