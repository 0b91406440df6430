"""Operators on documents against brute force, on rows with nulls, empty and
very long texts, ties, repeated rows, an empty table and clashing column names."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stockpilot.llm import byte_bpe, exact_dedup, langid, near_dedup, packing, quality, sharding, simhash
from stockpilot.llm.shingles import shingle_set, super_minhash

WORDS = "the of and river stone light der die und haus nacht tag le la et maison jour nuit".split()
SCHEMA = "doc_id long, text string, lang string, source string, name string, level int, h long, i int, keep_id long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()[:70] + prose(2, 50).split()
    out = [(1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \n\t "), (8, "one")]
    out += [(9, "one"), (10, base.replace(" ", "\n", 3)), (11, prose(3, 60)), (11, prose(3, 60)), (12, prose(4, 9000))]
    out += [(13, prose(4, 9000) + " tail"), (None, prose(5, 20)), (None, "one"), (14, "ünï çödé 中文 🙂 <|endoftext|> it's 42"), (15, "x" * 30000)]
    return [(i, t, "en", "s", "n", 1, 2, 3, 4) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("size,hash_of", [(4096, F.xxhash64), (16, F.xxhash64), (16, lambda b: F.length(b).cast("long")), (7, lambda b: F.lit(0).cast("long"))])
def test_exact_dedup(docs, size, hash_of):
    by = {}
    for i, t, *_ in rows():
        by.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t, *_ in rows():
        ids = by[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(docs, block_bytes=size, hash_of=hash_of)
    assert Counter(map(tuple, got.collect())) == want


def test_exact_dedup_keeps_rows(docs, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert len({norm(r.text) for r in kept.collect()}) == kept.count() == len({norm(t) for _, t, *_ in rows()})
    assert exact_dedup.exact_dedup(empty).count() == 0


def sets(k):
    out = {}
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        out[i, t] = frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_components(items, percent):
    """items: id -> set; smallest id reachable over links."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(items)
    for a in ids:
        for b in ids:
            both = len(items[a] & items[b])
            if a < b and items[a] and items[b] and 100 * both >= percent * len(items[a] | items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_components(docs, k):
    of = sets(k)
    want = brute_components({i: s for (i, _), s in of.items() if i is not None}, 80)
    for r in near_dedup.near_components(docs, k=k).collect():
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    counts = Counter((r.doc_id, r.n_shingles) for r in near_dedup.near_components(docs, k=k).collect())
    assert counts == Counter((i, len(of[i, t])) for i, t, *_ in rows())


def test_near_components_of_a_large_group_in_small_tasks(spark):
    """A family of near copies, some of which link only through others, dealt
    over tasks of at most 8 members: all links are found."""
    r = random.Random(5)
    base = prose(9, 100).split()
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(90, 140):
        texts[i] = " ".join(base[:40] + prose(100 + i, 60).split())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = {i: frozenset(shingle_set(t, 4).tolist()) for i, t in texts.items()}
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(df, k=4, task_members=8).collect()}
    assert got == brute_components(items, 80)


def test_linked_finds_all_components():
    r = random.Random(3)
    import numpy as np

    some = [np.unique(np.array([r.randrange(60) for _ in range(r.randrange(1, 40))], np.uint64)) for _ in range(80)]
    got = {i: i for i in range(80)}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in near_dedup.linked(some, list(range(80)), 60):
        x, y = find(a), find(b)
        got[max(x, y)] = min(x, y)
    assert {i: find(i) for i in got} == brute_components({i: frozenset(s.tolist()) for i, s in enumerate(some)}, 60)


def test_super_minhash_estimates_similarity():
    import numpy as np

    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for share in (0.0, 0.5, 0.8, 1.0):
        n = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], np.arange(10**6, 10**6 + 1000 - n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)])
        sig = super_minhash(np.concatenate([a, b]), np.array([0, 1000]), 240)
        assert abs((sig[0] == sig[1]).mean() - n / (2000 - n)) < 0.1
    tiny = super_minhash(np.array([7, 7, 9], np.uint64), np.array([0, 1]), 240)  # sets {7} and {7, 9}
    assert 0.3 < (tiny[0] == tiny[1]).mean() < 0.7


def test_near_keeps_rows(docs, empty):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 11, 12, 14, 15]
    assert near_dedup.near_components(empty).count() == 0


def test_near_texts_that_share_a_doc_id(spark):
    """Each of the texts under one id links on its own, and unrelated ones are all kept."""
    a, b = prose(21, 80), prose(22, 80)
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    rows_ = [(1, a), (1, b), (1, b), (1, b.upper()), (2, near(a, "x")), (3, near(b, "y")), (4, prose(23, 80)), (5, None), (5, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    kept = Counter((r.doc_id, r.text.lower() if r.text else None) for r in near_dedup.keep_one(df).collect())
    assert kept == Counter([(1, a), (1, b), (4, prose(23, 80)), (5, None)])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("length,open_windows,fan_in", [(2048, 32, 32), (64, 3, 2), (1, 1, 2)])
def test_pack(docs, tokenizer, length, open_windows, fan_in):
    pieces = packing.pack(docs, length=length, open_windows=open_windows, fan_in=fan_in).collect()
    ids = Counter()
    for i, t, *_ in rows():
        ids[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    by_doc, by_sequence = {}, {}
    for p in pieces:
        got = [int.from_bytes(p.ids[4 * k : 4 * k + 4], "little") for k in range(len(p.ids) // 4)]
        assert len(got) == p.length and p.ids_crc32 == zlib.crc32(p.ids)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, got))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    want = Counter()
    for (i, x), n in ids.items():
        for k, v in enumerate(x):
            want[i, len(x), k, v] += n
    assert Counter((i, n, s + k, v) for (i, n), some in by_doc.items() for s, got in some for k, v in enumerate(got)) == want
    short = 0
    for some in by_sequence.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        short += at < length
        assert at <= length
    assert short <= 1


def test_pack_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_text_ids_are_the_tokenizers(tokenizer):
    ids = packing.text_ids(None)
    r = random.Random(1)
    letters = "aAbcdeEst 's'rell'll  \n\t01é中🙂-_.!&<|endoftext|>\x1c\x85  "
    for _ in range(2000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(s, add_special_tokens=False).ids)
        assert ids(s) == want == b"".join(ids.in_steps(s)), s
    assert ids("ab " * 500_000) == b"".join(ids.in_steps("ab " * 500_000))


@pytest.fixture(scope="module")
def reference_bpe():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty, reference_bpe):
    want = Counter()
    for i, t, *_ in rows():
        ids = reference_bpe.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, byte_bpe.digests(docs).collect())) == want
    back = Counter((r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect())
    assert back == Counter((i, (t or "").encode()) for i, t, *_ in rows())
    assert byte_bpe.digests(empty).count() == 0


def test_byte_bpe_matches_merges(reference_bpe):
    coder = byte_bpe.load()
    r = random.Random(2)
    for _ in range(3000):
        s = "".join(r.choice("abehinorst é中'\n 0123") for _ in range(r.randrange(80)))
        assert " ".join(coder.encode(s)) == " ".join(map(str, reference_bpe.encode_ordinary(s))), s


@pytest.mark.parametrize("shards,bucket", [(24, 1 << 24), (5, 20_000)])
def test_shards(spark, docs, tmp_path, shards, bucket):
    out = sharding.write_shards(docs, str(tmp_path / f"s{shards}"), shards=shards, bucket_bytes=bucket).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.text, r.size) for r in out) == Counter((i, t, size(t)) for i, t, *_ in rows())
    counts = Counter(r.shard for r in out)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(full[s]))
    again = sharding.write_shards(docs.repartition(5), str(tmp_path / f"t{shards}"), shards=shards, bucket_bytes=bucket)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out))


def test_shards_empty_table(empty, tmp_path):
    assert sharding.write_shards(empty, str(tmp_path / "e")).count() == 0


def brute_edited():
    order = sorted({(i, t or "") for i, t, *_ in rows()}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    return order


def test_simhash(docs, empty):
    out = simhash.edited_fingerprints(docs)
    got = out.select("*", simhash.likeness(simhash.distance("f0", "f1", "e0", "e1")).alias("near")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, *_ in rows())
    texts = {}
    for i, t, *_ in rows():
        texts.setdefault(i, set()).add(t or "")
    ids = sorted((i for i in texts if i is not None), reverse=True)
    heads = {i: next(iter(texts[n])) for i, n in zip(ids, ids[1:])}  # the next in descending order
    for r in got:
        if r.doc_id in heads:
            t = next(iter(texts[r.doc_id]))
            k = len(t) // 3
            edited = t[: len(t) - k] + heads[r.doc_id][:k]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = {r.doc_id: (r.f0, r.f1) for r in got}
    assert same[1] == same[2] and same[5] == same[6] == same[7] == (0, 0) and same[8] == same[9]
    assert {r.doc_id: r.near for r in got}[12] > 0.4
    assert simhash.edited_fingerprints(empty).count() == 0


def test_op8_query_against_all_documents(spark, tmp_path):
    """near_next and within_radius by comparing fingerprints in Python, copies, empty and null texts included."""
    texts = [prose(i // 3, 60) + f" {'x ' * (i % 3)}" for i in range(58)] + ["", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op8_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    print_of = {i: int(r.fingerprint, 16) for i, r in got.items()}
    bits = lambda a, b: (print_of[a] ^ print_of[b]).bit_count()
    for i, r in got.items():
        after = i - 1 if i else len(rows) - 1
        assert r.near_next == pytest.approx(max(0, math.cos(bits(i, after) * math.pi / 128)))
        want = sum(bits(i, j) <= simhash.RADIUS for j in print_of) - 1 if i % 20 == 0 else None
        assert r.within_radius == want
    assert got[0].within_radius >= 2


def test_no_key_table_is_broadcast(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)], "f0 long, f1 long")
    for found in (simhash.count_within(df, df), simhash.find_within(df, df)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan


def test_simhash_votes(spark):
    """The fingerprint is the sign of the weighted sum of the terms' hash bits."""
    t = prose(8, 50)
    w = t.split()
    pairs = [(a, b) for a, b in zip(w, [*w[1:], None])]
    p = spark.createDataFrame(pairs, "w string, v string").select(F.xxhash64("w", "v"), F.xxhash64(F.lit(1), "v", "w")).collect()
    want = [sum(1 << b for b in range(64) if 2 * sum(x[k] >> b & 1 for x in p) > len(p)) for k in (0, 1)]
    got = simhash.fingerprints(spark.createDataFrame([(1, t)], "k int, t string"), ["k"], "t").first()
    assert [got.f0 % 2**64, got.f1 % 2**64] == want


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_block_tables_find_all_within_radius(spark, radius):
    r = random.Random(radius)
    prints = {r.getrandbits(128) for _ in range(20)}
    for p in list(prints):
        for _ in range(6):
            x = p
            for _ in range(r.randrange(1, 10)):
                x ^= 1 << r.randrange(128)
            prints.add(x)
    signed = lambda v: v - 2**64 if v >> 63 else v
    key = {x: (signed(x >> 64), signed(x % 2**64)) for x in prints}
    df = spark.createDataFrame(list(key.values()), "f0 long, f1 long")
    got = Counter(tuple(x)[:4] for x in simhash.find_within(df, df, radius).collect())
    want = Counter((*key[a], *key[b]) for a in prints for b in prints if (a ^ b).bit_count() <= radius)
    assert got == want


def test_default_radius_finds_similar_texts(spark):
    """Recall on pairs of five-word-shingle similarity 0.8 or more, and the counts of all pairs within the radius."""
    r = random.Random(11)
    texts = []
    for i in range(40):
        base = prose(500 + i, r.randrange(60, 300)).split()
        edits = len(base) // 50
        apart, touching = list(base), list(base)
        for k in range(edits):
            apart[r.randrange(len(base))] = f"edit{k}"
        at = r.randrange(len(base) - edits)
        touching[at : at + edits] = [f"edit{k}" for k in range(edits)]
        cut = base[: len(base) * 9 // 10]
        texts += [" ".join(w) for w in (base, base, apart, touching, cut)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    prints = simhash.fingerprints(df, ["k"], "t").checkpoint()
    of = {p.k: (p.f0, p.f1) for p in prints.collect()}
    bits = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b))
    found = {tuple(x)[:4] for x in simhash.find_within(prints, prints).collect()}
    assert found == {(*a, *b) for a in of.values() for b in of.values() if bits(a, b) <= simhash.RADIUS}
    some = [frozenset(shingle_set(t, 5).tolist()) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(some[a] & some[b]) >= 0.8 * len(some[a] | some[b]) and texts[a] != texts[b]]
    assert len(alike) >= 100 and sum((*of[a], *of[b]) in found for a, b in alike) >= 0.95 * len(alike)
    for chunk in (1, 3, 256):
        near = {(x.f0, x.f1): x.near for x in simhash.count_within(prints.filter("k % 3 = 0"), prints, chunk=chunk).collect()}
        assert near == {of[a]: sum(bits(of[a], p) <= simhash.RADIUS for p in of.values()) for a in of if a % 3 == 0}


def test_marginals_against_all_label_sequences():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    sizes = np.array([1, 4, 3])
    u, t = r.normal(size=8), r.normal(size=(2, 2))
    got, pair, log_z = quality.marginals(u, sizes, t)
    want, total, pairs, at = [], 0.0, np.zeros((2, 2)), 0
    for n in sizes:
        z, m, e = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            z += p
            m += p * np.array(y)
            for a, b in zip(y, y[1:]):
                e[a, b] += p
        want += list(m / z)
        pairs += e / z
        total += np.log(z)
        at += n
    assert np.allclose(got, want) and np.allclose(pair, pairs) and np.isclose(log_z, total)


def test_quality_lines_of_long_text_in_steps(monkeypatch):
    import numpy as np

    text = "\n".join(prose(i, 20) for i in range(60)) + "\n\n"
    whole = quality.lines(text)
    monkeypatch.setattr(quality, "BATCH_CHARS", 200)
    for a, b in zip(whole, quality.lines(text)):
        assert np.allclose(a, b)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()


def test_quality_rows(spark, docs, empty):
    model = quality.fit([prose(1, 50), "a!! b!! c!!\nd!! e!!"], [1, 0])
    got = quality.with_quality(docs, model, docs.columns).collect()
    assert len(got) == len(rows()) and all(0 <= r["__score"] <= 1 for r in got)
    assert all(r["__score"] == 0 for r in got if not (r.text or "").strip())
    assert quality.with_quality(empty, model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).score(["text"])[0] == pytest.approx(0.5, abs=0.01)


def test_language_forward_against_all_segmentations():
    import numpy as np

    pieces = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6}
    prob = np.vstack([np.array([[0.1, 0.3, 0.2, 0.4, 0.25, 0.15, 0.05]]).T, [[0.0]]])

    def total(s):
        return 1.0 if not s else sum(prob[p, 0] * total(s[len(x) :]) for x, p in pieces.items() if s.startswith(x)) + (
            prob[0, 0] * total(s[1:]) if s[0] not in pieces else 0
        )

    for w in ("ab", "ba", "bb", "cb"):
        arcs = langid.lattice([w], pieces)
        assert langid.forward(arcs, prob)[0, -1, 0] == pytest.approx(total("▁" + w))
        count = langid.expected(arcs, prob, np.ones((1, 1)))
        texts = {v: k for k, v in pieces.items()} | {0: "?"}
        assert sum(c * len(texts[p]) for p, c in enumerate(count[:7, 0])) == pytest.approx(len(w) + 1)


def test_language_of_long_words_and_long_texts(monkeypatch):
    import numpy as np

    pieces = langid.vocabulary()
    assert {"▁information", "▁government"} <= set(pieces)
    model = langid.fit({"en": {"information": 9, "government": 3, "the": 9}, "de": {"haus": 3, "der": 9, "regierung": 2}})
    prob = np.vstack([np.exp(model.log_prob.astype(float)), np.zeros(2)])
    r = random.Random(6)
    for n in (5, 16, 33, 45):
        w = "".join(r.choice(["information", "the", "haus", "q"]) for _ in range(n))[:n]
        want = np.log(langid.forward(langid.lattice([w], pieces), prob)[0, -1])
        assert np.allclose(langid.log_forward(w, pieces, prob), want)
        assert np.allclose(model.log_likelihoods([w])[0], want)
    assert np.isfinite(model.log_likelihoods(["haus" * 3000])[0]).all()
    text = "the information, der haus " * 30 + "government" * 9
    whole = model.log_likelihoods([text])[0]
    monkeypatch.setattr(langid, "BATCH_CHARS", 50)
    assert np.allclose(model.log_likelihoods([text])[0], whole)


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op9_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = got.filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()


def test_language_rows(docs, empty):
    model = langid.fit({"en": {"river": 3, "the": 9}, "de": {"haus": 3, "der": 9}})
    got = langid.with_language(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows()) and all(0 <= r["__score"] <= 1 for r in got)
    assert all((r["__lang"] == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)
    assert model.predict(["the river"])[0] == ["en"] and model.predict(["der " * 400_000])[0] == ["de"]
    assert langid.with_language(empty, langid.train(empty), ["doc_id"]).count() == 0


def test_special_tokens_as_the_library_reads_them(tokenizer, monkeypatch):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "x <|ENDOFTEXT|>", "no", ""]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for chars in (packing.BATCH_CHARS, 3):
        monkeypatch.setattr(packing, "BATCH_CHARS", chars)
        for special, t in ((True, tokenizer), (False, plain)):
            encode = packing.TextIds(None, special)
            for x in texts:
                want = t.encode(x, add_special_tokens=False).ids
                assert encode(x) == b"".join(i.to_bytes(4, "little") for i in want), (x, special, chars)


def test_ids_at_the_border_of_the_two_libraries(tokenizer):
    encode = packing.TextIds(None)
    for text in ("ab " * 349_525 + "xyzzy", "a" * (1 << 20), "word" * 262_144 + "s"):
        for t in (text[: 1 << 20], text[: (1 << 20) - 1], text + "!"):
            assert encode(t) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["①②", "½", "㈠", "Ⅷ", "²", "1234", "٣", "_", "a½"])
def test_language_needs_a_letter(text):
    model = langid.fit({"en": {"river": 3, "the": 9}, "de": {"haus": 3, "der": 9}})
    assert (model.predict([text])[0] == ["und"]) == (not any(map(str.isalpha, text)))


def test_language_fit(spark):
    import numpy as np

    docs = spark.createDataFrame([(i, prose(i, 60).translate(str.maketrans("", "", "0123456789")), "en") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    r = random.Random(1)
    junk = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(40))
    known = docs.collect()
    langs, _, fits = model.fits([known[2].text, junk, "short", ""])
    assert fits[0] > 0 > fits[1] and fits[2] is None and fits[3] is None and langs[3] == "und"
    assert np.isfinite(fits[0])


CLASH = ["__id", "__tag", "__sha", "__n", "__s1", "__score", "__lang", "__text", "__fit", "a.b", "id", "c0", "tag", "texts", "x`y", "key"]


@pytest.mark.parametrize("k", range(4))
def test_stages_with_columns_of_any_name(spark, k):
    """quality, language, exact and near dedup with clashing and odd column names."""
    base = prose(1, 120)
    rows_ = [(i, t, "en", "s", len(t)) for i, t in enumerate([base, base, base + " tail", prose(2, 90), prose(3, 80)])]
    plain = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars int")
    wide = plain.select("*", *(F.concat(F.lit(f"{n}="), F.col("doc_id").cast("string")).alias(n) for n in CLASH))
    stage = corpus_pipeline.STAGES[k][1]
    d = "/root/testdata/sf0.001"
    out = stage(spark, wide, d)
    assert out.columns == wide.columns
    got = sorted(tuple(r) for r in out.collect())
    assert [r[0] for r in got] == sorted(r.doc_id for r in stage(spark, plain, d).collect())
    assert all(r[5:] == tuple(f"{n}={r[0]}" for n in CLASH) for r in got)


def test_pipeline(spark, tmp_path):
    """Stages keep the columns; kept rows are those that brute force keeps."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids))
        if name == "exact_dedup":
            left = {}
            for i in sorted(before):
                left.setdefault(norm(texts[i]), i)
            assert sorted(ids) == sorted(left.values())
        if name == "near_dedup":
            items = {i: frozenset(shingle_set(texts[i], 5).tolist()) for i in before}
            assert sorted(ids) == sorted({v for v in brute_components(items, 80).values()})
        before = ids
    tokens = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert sorted(r.doc_id for r in tokens) == sorted(before) and all(r.n == r.t for r in tokens)


def test_pipeline_of_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).count()
