"""Columns computed from a text column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stockpilot.llm.deploy import prepare_workers

#: Code points of texts that are worked on at once.
BATCH_CHARS = 1 << 20
KINDS = {pa.float64(): T.DoubleType(), pa.int64(): T.LongType(), pa.string(): T.StringType()}


def quoted(name: str) -> str:
    """A column's name for expressions: names may hold dots and back quotes."""
    return "`" + name.replace("`", "``") + "`"


def positional(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ... by position, so that no name clashes with one that an
    operator adds, and the new names of the ``wanted`` columns.  ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(w)}" for w in wanted]


def in_steps(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts in lists of bounded size; a longer text is a list of its own."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def computed(
    docs: DataFrame, text_col: str, make: Callable, fields: dict[str, pa.DataType], keep: list[str]
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the new ``fields``.  ``make()`` gives,
    inside the worker, a function from a list of texts (null: empty) to one
    sequence per field.  Columns of ``docs`` that are not in ``keep`` may have
    any name, those in ``keep`` any but the new ones."""
    prepare_workers(docs.sparkSession)
    kept = docs.select(*map(quoted, keep))
    rows = docs.select(*map(quoted, keep), docs[quoted(text_col)].alias("__text"))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, KINDS[t]) for n, t in fields.items())])

    def run(batches):
        of = make()
        for batch in batches:
            found: list[list] = [[] for _ in fields]
            for some in in_steps(t.as_py() or "" for t in batch.column(len(keep))):
                for all_, new in zip(found, of(some)):
                    all_.extend(new)
            new = [pa.array(v, t) for v, t in zip(found, fields.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=schema.names)

    return rows.mapInArrow(run, schema)
