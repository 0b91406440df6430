"""Phrase mining against counting in a dictionary."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stockpilot.llm import phrases
from stockpilot.llm.transducer import Transducer, Union


def brute(rows, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longest = Counter()
    for p, a in cand.items():
        if len(p) == 4:
            for q in {p[:3], (p[0], *p[2:])}:
                longest[q] = max(longest[q], a)
    by = {}
    for p, a in cand.items():
        if longest[p] and 100 * longest[p] >= covered * a:
            continue
        s, k = min((1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
        by.setdefault(p[0], []).append((-s, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in by.items() for i, x in enumerate(sorted(v)[:top], 1)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(4)


def found(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["the", "of", "The", "a", "é", "Écu", "漢", "x" * 40, "x" * 40 + "y", "\x01b", "b", "b\x00", "zz"]
    weights = [40, 30, 10, 10, 8, 5, 5, 3, 3, 2, 4, 2, 1]
    out = []
    for _ in range(n):
        parts = [w + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", "\r", ",", " ? "]) for w in r.choices(words, weights, k=r.randrange(60))]
        out.append((r.choice(["en", "en", "en", "fr", None, ""]), "".join(parts)))
    return [*out, ("en", None), ("en", ""), ("xx", " . "), *[("de", "nur einmal so hier")] * 10, ("de", "nur einmal")]


@pytest.mark.parametrize("size,block,cut", [(8 << 20, 1 << 20, 32), (200, 500, 32), (100, 1, 1)])
def test_against_a_dictionary(spark, monkeypatch, size, block, cut):
    for name, value in (("RANGE_BYTES", size), ("BLOCK_WORDS", block), ("CUT_BYTES", cut), ("SAMPLE_STEP", 2), ("_SLICE", 64 if block == 1 else 1 << 20)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(cut + size)
    docs = frame(spark, rows)
    assert len(phrases.cuts(docs)) > (10 if size < 1000 else -1)
    assert found(phrases.best(phrases.collocations(docs))) == brute(rows)


def test_top_and_ties(spark):
    rows = [("en", f"w{i} v{i}") for i in range(30) for _ in range(10)]
    got = found(phrases.best(phrases.collocations(frame(spark, rows)), k=7))
    assert got == brute(rows, top=7) and len(got) == 7


def test_large_counts_stay_exact():
    labels, rows = [b"a", b"b"], np.array([[1, 0, 0], [1, 2, 0], [2, 0, 0]])
    counts = np.array([2**61 + 1, 2**60 + 1, 2**61 - 1])
    t = Transducer.from_bytes(Transducer.build(labels, rows, counts).to_bytes())
    assert t.paths()[1].tolist() == counts.tolist()


def test_empty_and_other_columns(spark):
    assert found(phrases.best(phrases.collocations(frame(spark, [])))) == set()
    rows = [("en", "one two three. one two")] * 12
    docs = frame(spark, rows).selectExpr("lang", "text", "1 as phrase", "2 as n", "3 as `a.b`", "4 as automaton", "5 as range")
    assert found(phrases.best(phrases.collocations(docs))) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_automata_hold_what_they_were_given(seed):
    r = random.Random(seed)
    labels = sorted({bytes(r.choices(b"abc", k=r.randint(1, 3))) for _ in range(20)})
    grams = {}
    for _ in range(300):
        k = r.randint(1, 3)
        grams[tuple(r.randint(1, len(labels)) for _ in range(k)) + (0,) * (3 - k)] = r.randint(1, 3)
    rows = np.array(sorted(grams), np.int64)
    counts = np.array([grams[tuple(x)] for x in rows.tolist()])
    t = Transducer.from_bytes(Transducer.build(labels, rows, counts).to_bytes())
    spelled = lambda t, rows: [tuple(t.labels[i - 1] for i in x if i) for x in rows.tolist()]
    want = {tuple(labels[i - 1] for i in x if i): c for x, c in zip(rows.tolist(), counts.tolist())}
    got = t.paths()
    assert dict(zip(spelled(t, got[0]), got[1].tolist())) == want and got[0].tolist() == sorted(got[0].tolist())
    # composition with an automaton of some of these n-grams and of others
    some = [k for k in range(len(rows)) if r.random() < 0.5]
    other = [[*labels, b"zzz"], np.array(sorted({*map(tuple, rows[some].tolist()), (len(labels) + 1, 0, 0), (1, len(labels) + 1, 0)}), np.int64)]
    q = Transducer.build(other[0], other[1], np.ones(len(other[1]), np.int64))
    hits = q.compose(t)[0]
    assert [want.get(p, 0) for p in spelled(q, q.paths()[0])] == hits.tolist()
    # equal states exist once
    for offsets, *arcs in t.levels[1:]:
        states = [tuple(map(tuple, np.stack(arcs, 1)[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
        assert len(states) == len(set(states))
    union = Union(waiting=50)
    for i in range(0, len(rows), 40):
        union.add(Transducer.build(labels, rows[i : i + 40], counts[i : i + 40]))
        union.add(t)
    names, united, sums, _ = union.result(1)
    assert {tuple(names[i - 1] for i in x if i): c for x, c in zip(united.tolist(), sums.tolist())} == {k: c * (1 + -(-len(rows) // 40)) for k, c in want.items()}


def test_query_and_sql_on_a_table(spark, tmp_path):
    rows = corpus(3, 400)
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(phrases.op12_phrases(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == brute(rows) == set(con.sql(phrases.ORACLE).select("lang, rank, phrase, a, l, r, n, score").fetchall())
