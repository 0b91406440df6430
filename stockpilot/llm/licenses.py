"""Licence scan by a positional index of rare tokens.

1. ``document_frequencies``: in how many documents each word of the templates
   occurs, over all documents (one row per template word).
2. ``Index``: for every mandatory phrase of a template its words with their
   positions, the word of highest IDF first; that word is the phrase's entry.
3. Of each file the entries that it holds are looked up, rarest first.  A
   phrase's places are the intersection, over its words, of the word's places in
   the file less its position in the phrase; all words found means that the
   phrase stands there word by word.  Every place is found, as every place holds
   its rarest word.
4. A template is found where all its mandatory phrases stand, at their relative
   positions up to ``SLACK`` words.  Its score is the share of the template's
   IDF weight that stands in the file at the template's relative positions.

Words are the runs of characters other than ASCII punctuation, white space and
controls, A-Z lower-cased.  Null texts count as empty; each row is scanned by
itself, so repeated rows and ids and null ids give rows of their own; an empty
table gives no rows.  Columns other than the id and the text are not read.
Of words with equal IDF the smaller one is the entry.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.deploy import prepare_workers

#: Words by which a template's parts may stand apart from their relative positions.
SLACK = 3


class Template(NamedTuple):
    """A notice: its label, its words, the phrases that must stand in the file; base ones count places."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


#: The notices that are looked for, with the phrases that they can't do without.
TEMPLATES = [
    Template("cc-by", "licensed under a creative commons attribution license cc by", ("cc by",), True),
    Template("gpl", "licensed under the gnu general public license", ("general public license",), True),
    Template("reserved", "copyright all rights reserved", ("all rights reserved",), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "fee is hereby granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
]

_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def vocabulary(templates: list[Template]) -> set[bytes]:
    return {w for t in templates for s in (t.text, *t.phrases) for w in words_of(s.encode())}


def document_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each template word: at
    most one row per template word reaches the driver."""
    prepare_workers(docs.sparkSession)
    wanted = vocabulary(templates)

    def run(batches):
        held, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                held.update(wanted.intersection(words_of(text.as_py() or b"")))
                n += 1
        words = [None, *held]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([n, *held.values()], pa.int64())], names=["word", "n"])

    texts = docs.select(docs[_quoted(text_col)].cast("binary").alias("text"))
    sums = texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if r.word is None else bytes(r.word): r.n for r in sums}
    return found.pop(None, 0), found


class Phrase(NamedTuple):
    #: (word, position in the phrase), highest IDF first.
    words: list[tuple[bytes, int]]
    #: (template, number of the phrase in it)
    owners: list[tuple[int, int]]


class Index:
    """Positional postings of the templates' mandatory phrases under their words of highest IDF."""

    def __init__(self, templates: list[Template], n: int, held: dict[bytes, int]):
        self.templates = templates
        self.idf = {w: math.log((n + 1) / (held.get(w, 0) + 0.5)) for w in vocabulary(templates)}
        self.words = [words_of(t.text.encode()) for t in templates]
        self.at: list[list[int]] = []  # where each mandatory phrase stands in its template
        self.phrases: list[Phrase] = []
        self.entries: dict[bytes, list[int]] = {}
        number: dict[tuple[bytes, ...], int] = {}
        for i, t in enumerate(templates):
            text, starts = self.words[i], []
            for j, phrase in enumerate(t.phrases):
                p = tuple(words_of(phrase.encode()))
                starts.append(next(k for k in range(len(text)) if tuple(text[k : k + len(p)]) == p))
                if p not in number:
                    number[p] = len(self.phrases)
                    rarest = sorted(((w, k) for k, w in enumerate(p)), key=lambda x: (-self.idf[x[0]], x))
                    self.phrases.append(Phrase(rarest, []))
                    self.entries.setdefault(rarest[0][0], []).append(number[p])
                self.phrases[number[p]].owners.append((i, j))
            self.at.append(starts)

    def places(self, where: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """The sorted places of each phrase of the file whose template words stand at ``where``."""
        found = {}
        for entry in sorted(self.entries.keys() & where.keys(), key=lambda w: (-self.idf[w], w)):
            for k in self.entries[entry]:
                (w, at), *rest = self.phrases[k].words
                left = {i - at for i in where[w] if i >= at}
                for w, at in rest:
                    if not left:
                        break
                    left.intersection_update([i - at for i in where.get(w, ())])
                if left:
                    found[k] = sorted(left)
        return found

    def coverage(self, template: int, start: int, where: dict[bytes, list[int]]) -> float:
        """The share of the template's IDF weight near its place if the template began at ``start``."""
        weight = total = 0.0
        for at, w in enumerate(self.words[template]):
            total += self.idf[w]
            places = where.get(w, ())
            k = bisect.bisect_left(places, start + at - SLACK)
            if k < len(places) and places[k] <= start + at + SLACK:
                weight += self.idf[w]
        return min(1.0, weight / total) if total > 0 else 1.0

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, bool, float]]]:
        """The number of words, and (label, start of the first mandatory phrase, base, score) of each notice."""
        words = words_of(text)
        if self.entries.keys().isdisjoint(words):
            return len(words), []
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.idf:
                where.setdefault(w, []).append(i)
        by: dict[tuple[int, int], list[int]] = {}
        for k, places in self.places(where).items():
            for owner in self.phrases[k].owners:
                by[owner] = places
        out = []
        for i, t in enumerate(self.templates):
            for p in by.get((i, 0), ()):
                start = p - self.at[i][0]
                if all(self._near(by.get((i, j)), start + self.at[i][j]) for j in range(1, len(t.phrases))):
                    out.append((t.label, p, t.base, self.coverage(i, start, where)))
        return len(words), out

    @staticmethod
    def _near(places: list[int] | None, at: int) -> bool:
        k = bisect.bisect_left(places or [], at - SLACK)
        return bool(places) and k < len(places) and places[k] <= at + SLACK


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, notices: array of (label, start, base, score), in order of templates and places."""
    prepare_workers(docs.sparkSession)
    rows = docs.select(docs[_quoted(id_col)].alias("doc_id"), docs[_quoted(text_col)].cast("binary").alias("text"))
    notice = pa.struct([("label", pa.string()), ("start", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
    keys = ("label", "start", "base", "score")

    def run(batches):
        for batch in batches:
            n, notices = [], []
            for text in batch.column(1):
                count, found = index.scan(text.as_py() or b"")
                n.append(count)
                notices.append([dict(zip(keys, x)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(notices, pa.list_(notice))], ["doc_id", "n_words", "notices"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words bigint, notices array<struct<label:string,start:bigint,base:boolean,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """A row per scanned document: the base places and the distinct labels, joined by commas."""
    base = F.filter("notices", lambda x: x.base)
    starts = F.transform(base, lambda x: x.start)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x.score)), F.lit(0.0)).alias("score"),
    )


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The notices of every document, with IDF weights counted over all of them."""
    return scan(docs, Index(templates, *document_frequencies(docs, templates, text_col)), id_col, text_col)


def op11_license(spark, sf_dir):
    return digest(license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
