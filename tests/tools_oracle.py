import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import duck, rows_of  # noqa: E402


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare_one(spark, con, sf_dir, name):
    import __spark_entry__ as E

    sdf = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(E.oracle_sql()[name])
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    if sorted(sdf.columns) != sorted(dcols):
        return "COLS", (sorted(set(sdf.columns) ^ set(dcols)))
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    tdiff = {c: (stypes[c], t) for c, t in zip(dcols, dtypes) if stypes[c] != t}
    if tdiff:
        return "TYPES", tdiff
    a, b = rows_of(sdf.columns, srows), rows_of(dcols, drows)
    if a != b:
        return "VALUES", (list((a - b).items())[:3], list((b - a).items())[:3])
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        if banned in plan:
            return "PLAN", banned
    return "OK", len(srows)


def same_rows(a, b) -> bool:
    """Whether two DataFrames have the same columns, types and rows."""
    kinds = lambda df: {f.name: f.dataType for f in df.schema.fields}
    rows = lambda df: rows_of(df.columns, [tuple(r) for r in df.collect()])
    return kinds(a) == kinds(b) and rows(a) == rows(b)


__all__ = ["compare_one", "duck", "same_rows"]
