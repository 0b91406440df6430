"""MinHash near-dedup: SuperMinHash signatures, banding, verification on the
full shingle sets, and union-find grouping.

1. ``sketch``: each document's set size, set digest and band keys, in one pass.
   Documents with equal sets are one class, led by the smallest doc_id.
2. Classes that share a band key are put into one candidate group (connected
   components over edges to the bucket's smallest id: linear in the buckets).
3. Each candidate group is searched inside one task by ``linked``: breadth
   first from pivots, comparing a pivot only with members not reached yet, on
   full sets.  A group larger than a task's bounds is dealt over chunks, and a
   few of its members (hubs) go to all chunks so that the chunks' components
   meet.
4. What chunks can't see is exact again by buckets: every bucket that still
   holds members of several components is compared across its components, in
   tasks of bounded size.  No candidate pair is dropped.
5. Components over the verified links give each document its component.

No step emits all pairs of a group.  Sums, minima and links are pre-aggregated;
joins on keys that many rows share are plain joins, which adaptive execution
splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.columns import computed, positional
from stockpilot.llm.deploy import prepare_workers
from stockpilot.llm.shingles import bands, shingle_set, super_minhash
from stockpilot.session import ensure_checkpoint_dir

#: 40 bands of 6 rows: two sets of similarity 0.8 share no band with probability
#: (1 - 0.8 ** 6) ** 40 = 5e-6; of 0.85, 4e-9; of 0.1, they share one with 4e-5.
SIGNATURE, ROWS = 240, 6
#: Members and set elements of one search task.
TASK_MEMBERS, TASK_ELEMENTS = 4096, 4 << 20
#: Elements whose signatures are computed at once.
BATCH_ELEMENTS = 1 << 16
_LONG = pa.int64()


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (set digest), keys (band keys) per row; a set
    without elements has nulls."""

    def table(ids, sets):
        full = [s for s in sets if len(s)]
        keys = iter(())
        if full:
            starts = np.cumsum([0] + [len(s) for s in full[:-1]])
            keys = iter(bands(super_minhash(np.concatenate(full), starts, SIGNATURE), ROWS).tolist())
        digests = [_digest(s) if len(s) else (None, None) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, _LONG),
                pa.array([len(s) for s in sets], _LONG),
                pa.array([d[0] for d in digests], _LONG),
                pa.array([d[1] for d in digests], _LONG),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(_LONG)),
            ],
            ["doc_id", "n_shingles", "s1", "s2", "keys"],
        )

    def run(batches):
        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                sets.append(shingle_set(text.as_py(), k))
                held += len(sets[-1])
                if held >= BATCH_ELEMENTS:
                    yield table(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield table(ids, sets)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest id reachable) for every id of the edges, by
    alternating large-star and small-star steps; every step's edges are
    checkpointed.  Minima are aggregates, so a hub is no single task's work."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct().checkpoint()
    known = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct().checkpoint()
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def linked(sets: list[np.ndarray], labels: list, percent: int, seen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (pairs of indexes) that connect all sets whose similarity is at
    least percent / 100.  Sets with equal labels count as connected already.

    Breadth first: a pivot is compared, through an index of the elements, with
    the sets not reached yet; those that link are reached and become pivots."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    starts = np.append(0, np.cumsum(sizes))
    groups: dict = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    left = np.ones(n, bool)
    links: list[tuple[int, int]] = []

    def index():
        keep = left[owner]
        order = np.argsort(flat[keep], kind="stable")
        return owner[keep][order], np.searchsorted(flat[keep][order], np.arange(len(values) + 1)), int(left.sum())

    post, first, there = index()
    for i in range(n):
        if not left[i]:
            continue
        queue = list(groups[labels[i]])
        left[queue] = False
        while queue and left.any():
            if 2 * int(left.sum()) < there:
                post, first, there = index()
            p = queue.pop()
            mine = flat[starts[p] : starts[p + 1]]
            lo, hi = first[mine], first[mine + 1]
            hit = post[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())]
            both = np.bincount(hit, minlength=n)
            near = np.flatnonzero(left & (100 * both >= percent * (sizes + sizes[p] - both)))
            for x in near.tolist():
                links.append((p, x))
                if left[x]:
                    more = groups[labels[x]]
                    left[more] = False
                    queue += more
    return links


def _search(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links a, b of each task's members.  ``texts``: task, node,
    label, s1, s2, text."""

    def links(members):
        if len(members) < 2:
            return None
        nodes = list(members)
        found = linked([members[x][0] for x in nodes], [members[x][1] for x in nodes], percent)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i][0] for i, _ in found], _LONG), pa.array([nodes[j][0] for _, j in found], _LONG)], ["a", "b"]
        )

    def run(batches):
        task, members = None, {}
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                t, node, label, s1, s2 = (cols[c][i].as_py() for c in range(5))
                if t != task:
                    if (out := links(members)) is not None:
                        yield out
                    task, members = t, {}
                if (node, s1, s2) not in members:
                    s = shingle_set(cols[5][i].as_py(), k)
                    if _digest(s) == (s1, s2):  # not another text under the same doc_id
                        members[node, s1, s2] = (s, label)
        if (out := links(members)) is not None:
            yield out

    dealt = texts.repartition("task").sortWithinPartitions("task")
    return dealt.select("task", "node", "label", "s1", "s2", "text").mapInArrow(run, "a long, b long")


def near_components(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    task_members: int = TASK_MEMBERS,
    task_elements: int = TASK_ELEMENTS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents whose shingle sets have a similarity of at least percent / 100
    are linked; component_id is the smallest doc_id reachable.  A text without
    words, or null, has an empty set and is linked with nothing: it is its own
    component.  Repeated rows each give a row with the same answer; rows that
    share a doc_id are one document for the ids.  A row without doc_id is
    linked with nothing, has a null component and is kept.  An empty table
    gives no rows; other columns are ignored."""
    ensure_checkpoint_dir(docs.sparkSession)
    prepare_workers(docs.sparkSession)
    base = sketch(docs, k, id_col, text_col).checkpoint()
    named = base.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    leaders = base.select("doc_id", "s1", "s2", "n_shingles", "keys").join(classes, ["s1", "s2"])
    leaders = leaders.filter("doc_id = node").dropDuplicates(["node", "s1", "s2"])
    entries = leaders.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = shared.filter("first != last").select("key", "first")
    entries = entries.join(shared, "key").checkpoint()  # only the buckets with two members or more
    groups = components(entries.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")))

    # candidate groups, dealt over as many chunks as their size asks for
    weighed = leaders.select("node", "s1", "s2", "n_shingles").join(groups, "node")
    need = weighed.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    chunks = F.greatest(F.ceil(F.col("n") / task_members), F.ceil(F.col("elements") / task_elements)).cast("int")
    need = need.select("root", "n", chunks.alias("chunks"))
    members = weighed.join(need, "root").checkpoint()
    spread = F.abs(F.xxhash64("node", F.lit(7)) % 1000003)
    hub = (F.col("chunks") > 1) & (spread % F.ceil(F.col("n") / 16) == 0)
    chunk = F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array((spread % F.col("chunks")).cast("int")))
    dealt = members.select("node", "s1", "s2", "root", F.explode(chunk).alias("chunk"))
    dealt = dealt.select("node", "s1", "s2", F.col("node").alias("label"), F.xxhash64("root", "chunk").alias("task"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    links = _search(texts.join(dealt, "node"), k, percent).checkpoint()

    large = members.filter("chunks > 1")
    if not large.isEmpty():
        links = links.unionByName(_across(large, entries, links, texts, k, percent, task_members)).checkpoint()
    found = components(links)

    named = named.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"])
    told = named.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    alone = base.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _across(large, entries, links, texts, k, percent, task_members) -> DataFrame:
    """Links between components inside the buckets of chunked groups.

    Per bucket, members of its most frequent component form side 0, all others
    side 1.  Side 1 is compared with both sides; each side is cut into parts of
    bounded size and every pair of parts that has work is one task."""
    labels = large.select("node", "s1", "s2").join(components(links), "node", "left")
    labels = labels.select("node", "s1", "s2", F.coalesce("root", "node").alias("label"))
    inside = entries.select("key", "node").join(labels, "node")
    mixed = inside.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = mixed.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")
    )
    mixed = mixed.filter("most < all")
    half = task_members // 2
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    mixed = mixed.select("key", "main", parts(F.col("most")).alias("p0"), parts(F.col("all") - F.col("most")).alias("p1"))
    rows = inside.join(mixed, "key").withColumn("h", F.abs(F.xxhash64("node", F.lit(11)) % 1000003))
    mine0, mine1 = (F.col("h") % F.col("p0")).cast("int"), (F.col("h") % F.col("p1")).cast("int")
    upto = lambda p: F.sequence(F.lit(0), F.col(p) - 1)
    of0 = F.transform(upto("p1"), lambda j: F.struct(F.lit(0).alias("kind"), mine0.alias("i"), j.alias("j")))
    of1 = F.concat(
        F.transform(upto("p0"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), mine1.alias("j"))),
        F.transform(upto("p1"), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, mine1).alias("i"), F.greatest(j, mine1).alias("j"))),
    )
    rows = rows.select("key", "node", "label", "s1", "s2", F.explode(F.when(F.col("label") == F.col("main"), of0).otherwise(of1)).alias("t"))
    rows = rows.select("node", "label", "s1", "s2", F.xxhash64("key", "t").alias("task"))
    return _search(texts.join(rows, "node"), k, percent)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows of which each group keeps one, with all their columns,
    whatever their names.  Texts with different sets that share a kept doc_id all stay."""
    rows, (i, text) = positional(docs, id_col, text_col)
    kept = near_components(rows, k, percent, i, text).filter("kept and doc_id is not null")
    kept = kept.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("texts")).checkpoint()
    named = rows.join(kept, F.col(i) == F.col("id"))
    if not kept.filter("texts > 1").isEmpty():

        def make():
            return lambda texts: tuple(zip(*(_digest(s) if len(s := shingle_set(t, k)) else (None, None) for t in texts)))

        several = computed(named.filter("texts > 1"), text, make, {"s1": _LONG, "s2": _LONG}, [*rows.columns, "id"])
        several = several.dropDuplicates(["id", "s1", "s2"]).select(*rows.columns)
        named = named.filter("texts = 1").select(*rows.columns).unionByName(several)
    return named.select(*rows.columns).unionByName(rows.filter(F.col(i).isNull())).toDF(*docs.columns)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs, k=4, percent=80)
