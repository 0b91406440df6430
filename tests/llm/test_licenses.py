"""Licence scan against looking for every phrase at every word."""

import random
import re

import pytest

from stockpilot.llm import licenses

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def starts(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def brute(doc, text):
    w = words(text)
    by = {label: starts(w, p) for p, label in BASE.items()}
    every = sorted(i for v in by.values() for i in v)
    base = sorted(k for k, v in by.items() if v)
    more = set(base)
    for t in licenses.TEMPLATES:
        tw = t.text.split()
        offset = [starts(tw, p)[0] for p in t.phrases]
        places = [set(starts(w, p)) for p in t.phrases]
        near = range(-licenses.SLACK, licenses.SLACK + 1)
        if any(all(any(i - offset[0] + o + d in v for d in near) for v, o in zip(places, offset)) for i in places[0]):
            more.add(t.label)
    return (doc, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base), ",".join(sorted(more)))


def found(df):
    return [tuple(r) for r in df.drop("score").collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def texts(seed, n):
    r = random.Random(seed)
    pool = [w for t in licenses.TEMPLATES for w in t.text.split()] + "é Über CC By RIGHTS all reserved all General PUBLIC licensé".split()
    pool += [t.text for t in licenses.TEMPLATES] + list(BASE) * 3
    return ["".join(w + r.choice([" ", " ", "-", ", ", "\n", "_", " x "]) for w in r.choices(pool, k=r.randrange(40))) for _ in range(n)]


def test_against_every_place(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 300))]
    rows += [(None, "CC BY"), (1, None), (2, ""), (2, "cc by cc by-cc  by"), (2, "cc by cc by-cc  by"), (3, "ccby c c by acc by cc byé"), (4, "All\x00rights\x7freserved")]
    rows += [(5, "all rights reserved " * 20_000), (6, "rights " * 50_000 + "reserved"), (7, "permission is hereby granted free of charge"), (8, "x" * 1_000_000)]
    got = found(licenses.digest(licenses.license_scan(frame(spark, rows))))
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT License.", "mit"),
    ("All rights reserved.", "reserved"),
    ("all rights are reserved, the general public, by cc", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Redistribution and use in source and binary forms. Much later and far away from what began the text, in quite another place of it, the following conditions are met", ""),
])
def test_notices(text, labels):
    index = licenses.Index(licenses.TEMPLATES, 100, {b"the": 90, b"license": 5})
    got = index.scan(text.encode())[1]
    assert ",".join(sorted({x[0] for x in got})) == labels
    assert all(0 <= x[3] <= 1 for x in got)


def test_whole_notices_score_more_than_their_phrases():
    index = licenses.Index(licenses.TEMPLATES, 100, {})
    score = lambda t: max(x[3] for x in index.scan(t.encode())[1])
    assert score("creative commons attribution license CC BY") > score("see CC BY here")
    assert score("Copyright 2001 A. Body. All rights reserved.") >= score("all rights reserved")


def test_entries_are_the_rarest_words(spark):
    rows = [(i, "cc cc the") for i in range(5)] + [(9, "by mit")]
    n, held = licenses.document_frequencies(frame(spark, rows))
    assert (n, held) == (6, {b"cc": 5, b"the": 5, b"by": 1, b"mit": 1})
    index = licenses.Index(licenses.TEMPLATES, n, held)
    assert index.phrases[0].words[0][0] == b"by" and 0 in index.entries[b"by"]


def test_empty_and_other_columns(spark):
    empty = licenses.digest(licenses.license_scan(frame(spark, [])))
    assert empty.count() == 0
    docs = frame(spark, [(1, "cc by"), (2, "no")]).selectExpr("doc_id", "text", "'q' as score", "1 as `a.b`", "2 as notices", "3 as n_words")
    assert sorted(found(licenses.digest(licenses.license_scan(docs)))) == [brute(1, "cc by"), brute(2, "no")]


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(2, 60))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op11_license(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(found(out), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in out.collect())
