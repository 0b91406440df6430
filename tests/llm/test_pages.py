"""Operators on web pages: extraction on labelled pages, the tree's marginals
against enumeration, and the WARC round trip."""

import base64
import hashlib
import itertools
import math
import random

import pytest

from stockpilot.llm import html_extract, html_tree, warc

ODD = [None, "", "   ", "just text & more", "<p>one<p>two", "<div", "<!-- open", "<script>var x='</p>'", "<p>a &am", "<b><i>x</b>y</i>"]


def test_marginals_against_all_labellings():
    t = html_tree.parse("<div><p>a</p><nav><ul><li>b</li></ul></nav></div><p>c</p><article><aside>d</aside></article>")
    kinds = html_extract.edge_kinds(t)
    assert sorted(set(kinds)) == [0, 1, 2]
    r = random.Random(1)
    n = len(t.tag)
    u = [r.uniform(-2, 2) for _ in range(n)]
    tables = [[[math.exp(r.uniform(-1, 1)) for _ in range(2)] for _ in range(2)] for _ in range(3)]
    z, m = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(a * b for a, b in zip(u, y)))
        for v in range(1, n):
            p *= tables[kinds[v]][y[t.parent[v]]][y[v]]
        z += p
        for v in range(n):
            m[v] += p * y[v]
    got, joint = html_extract.sum_product(t, u, tables, edges=True)
    assert got == pytest.approx([x / z for x in m])
    for v, _, j in joint:
        assert j[1] + j[3] == pytest.approx(got[v]) and sum(j) == pytest.approx(1)


def test_labelled_pages_held_out():
    model, pages = html_extract.default_model(), html_extract.LabelledPages(12345)
    right = total = 0
    for _ in range(200):
        t = html_tree.parse(pages.page())
        p = model.marginals(t)
        total += sum(len(x) for _, x in t.blocks)
        right += sum(len(x) for v, x in t.blocks if (p[v] > 0.5) == bool(t.label[v]))
    assert right >= 0.98 * total


@pytest.mark.parametrize(
    "page,text",
    [
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  <b>bo</b>ld.\n<p>Two<br>three.</article><footer>&copy; x</footer>", "T & U One bold. Two three."),
        ("<article><p>Some story text, told at length.</p></article><div class=comments><p>Nice one!</p><p>Agreed, thanks.</p></div>", "Some story text, told at length."),
        ("<body><div class='cookie-notice'>We use cookies.</div><main><h1>Title</h1><p>First sentence of the text. Second one follows.</p></main><form><label>Mail</label><input><button>Send</button></form></body>", "Title First sentence of the text. Second one follows."),
        ("<article><p>a < b and c &lt; d.</p><script>if (a</b) '</article>'</script><style>p{}</style><!-- <p>no</p> --><p>End of the text.</p></article>", "a < b and c < d. End of the text."),
    ],
)
def test_main_text(page, text):
    assert html_extract.default_model().text(page) == text


P = (
    "The harbour plan was agreed by the council on Monday after a long debate, and work on the new quay will begin in spring. "
    "Residents had asked for more time, but the mayor said the funds would be lost. Ships will use the old basin until then."
)
Q = "A second paragraph, shorter than the first, says what comes next for the town."
BLOG = (
    "<!doctype html><html><head><title>t</title></head><body><header class=site-header><a href=/>Paper</a><nav><ul><li><a href=/1>A</a>"
    "</li></ul></nav></header><main><article class=post><header class=entry-header><h1>Harbour</h1><p class=meta>By A. Writer</p></header>"
    f"<div class=entry-content><p>{P}</p><h2>What next</h2><p>{Q}</p><blockquote>We are pleased with it, said the mayor.</blockquote></div>"
    "<footer class=entry-footer>Tagged: <a href=/t>harbour</a></footer></article><section class=comments><h3>2 replies</h3><div>Nice, at "
    "last.</div><div>I disagree with all this.</div></section></main><aside class=sidebar><h3>Popular</h3><ul><li><a href=/5>x</a></li></ul>"
    "</aside><footer>Copyright Paper</footer></body></html>"
)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><header><h1>Harbour plan agreed</h1></header><p>{P}</p><p>End.</p></article>", f"Harbour plan agreed {P} End."),
        (f"<article><h1>Harbour</h1><p>{P}</p><aside><p>Related: ferries</p></aside><p>{Q}</p></article>", f"Harbour {P} {Q}"),
        (f"<article><header><h1>Plan</h1></header><p>{P}</p><aside>Read more about quays.</aside><p>{Q}</p></article>", f"Plan {P} {Q}"),
        (f"<article><h1>H</h1><figure><img src=a><figcaption>The old quay.</figcaption></figure><p>{P}</p></article>", f"H The old quay. {P}"),
        (f"<article><p>{P}</p><form><label>Mail</label><input><button>Go</button></form><p>{Q}</p></article>", f"{P} {Q}"),
        (f"<html><body>{P}<p>{Q}</p></body></html>", f"{P} {Q}"),
        (f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><h1>Harbour</h1><p>{P}</p><p>{Q}</p><footer>&copy; 2020 Town paper</footer>", f"Harbour {P} {Q}"),
        (f"<div class=inhalt><h1>Hafen</h1><p>{P}</p></div><div class=kommentare><h3>Kommentare</h3><p>Sehr gut, endlich passiert etwas.</p></div>", f"Hafen {P}"),
        (f"<div class=tb><a href=/>Town</a> <a href=/x>News</a></div><div class=zq17><div class=k3><h1>Harbour</h1><p>{P}</p><p>{Q}</p></div></div><div class=b4><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div>", f"Harbour {P} {Q}"),
        (BLOG, f"Harbour By A. Writer {P} What next {Q} We are pleased with it, said the mayor."),
    ],
)
def test_pages_that_the_generator_did_not_make(page, text):
    assert html_extract.default_model().text(page) == text


def test_stored_model_is_of_this_code():
    model = html_extract.default_model()
    assert len(model.weights) == len(html_extract.NAMES) and len(model.edges) == 4 * html_extract.TABLES
    start = html_extract.fit([html_extract.LabelledPages(3).page() for _ in range(20)], steps=20)
    t = html_tree.parse(f"<article><p>{P}</p></article><nav><a href=/>Home</a></nav>")
    assert start.marginals(t)[1] > start.marginals(t)[-1]


def test_op2_query_returns_whole_texts(spark, tmp_path):
    rows = [(1, "u", f"<article><p>{P}</p></article>"), (1, "u", f"<article><p>{P}</p></article>"), (2, None, None), (None, "v", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html_extract.op2_html_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", P, len(P))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)


def test_broken_pages():
    model = html_extract.default_model()
    r = random.Random(4)
    page = html_extract.LabelledPages(7).page()
    for p in [*(x or "" for x in ODD), *(page[: r.randrange(len(page))] for _ in range(100)), "<div>" * 5000 + "x", "<a '" * 2000]:
        assert isinstance(model.text(p), str)


STORY = "<article><h1>Title</h1><p>It's the first sentence of the text. That's the second one.</p></article>"


@pytest.mark.parametrize(
    "before,after",
    [
        ("<html><head><title>x</title><meta charset=utf-8><body>", "</body></html>"),
        ("<html><head><title>x</title><link rel=a>", ""),
        ("<head><script>var s = '<head>';</script></head><body>", ""),
        ("<head><script>for (i=0;i<n;i++) a('don\\'t');</script><title>x</title></head><body>", ""),
        ("<noscript><script>var s = '<noscript>';</script></noscript>", ""),
        ("<div><select><option>a<option>b</div>", ""),
        ("<div><svg><g><path d=M1></div>", ""),
        ("<svg><title/><path d=M1>", ""),
        ("<svg><style/><g>x</g></svg>", ""),
        ("<object data=x><param name=a>", ""),
        ("<div><object data=x>", "</div>"),
        ("<div><video src=x><source src=y>", "</div><div><video><p>No video.</p></video></div>"),
        ("<img alt=don't>", ""),
        ("<div><canvas><div><p>No canvas.</p></div></canvas><template><div><p>Row</p></div></template></div>", ""),
        ("<svg><foreignObject><div><p>Label</p></div></foreignObject></svg>", ""),
    ],
)
def test_dropped_elements_do_not_take_the_page(before, after):
    t = html_tree.parse(before + STORY + after)
    assert [x for _, x in t.blocks] == ["Title", "It's the first sentence of the text. That's the second one."]


def test_many_unclosed_dropped_elements():
    t = html_tree.parse("<object><p>a" * 20000 + "</object>")
    assert len(t.blocks) >= 19000


def test_main_text_rows(spark):
    rows = [(i, "u", h, "x") for i, h in enumerate(ODD)] + [(None, None, "<article><p>Long enough text here.</p></article>", "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.with_main_text(df, html_extract.default_model(), ["page_id", "url"]).collect()
    assert len(got) == len(rows) and [r["__main"] for r in got][:3] == ["", "", ""]
    assert html_extract.with_main_text(df.limit(0), html_extract.default_model(), ["page_id"]).count() == 0


def page_rows():
    same = "<p>copy</p>" * 50
    rows = [(5, same), (3, same), (9, same), (9, same), (None, same), (None, "<p>alone</p>"), (1, None), (2, ""), (4, "é中" * 20000)]
    return [(i, f"http://h/{i}", h, "clash", 0) for i, h in rows]


def write(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, size int")
    warc.write_warc(df.repartition(3), str(tmp_path / "w"), **options)
    return str(tmp_path / "w")


def test_warc_round_trip(spark, tmp_path):
    path = write(spark, tmp_path, page_rows())
    got = warc.read_warc(spark, path).collect()
    payloads = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h, *_ in page_rows()}
    assert len(got) == len(page_rows())
    for r in got:
        assert r.payload_bytes == len(payloads[r.payload_digest])
        assert (r.warc_type == "response") == (r.refers_to is None)
        assert (bytes(r.payload) if r.payload is not None else None) == (payloads[r.payload_digest] if r.refers_to is None else None)
    kinds = sorted((r.record_id, r.refers_to) for r in got if r.warc_type == "revisit")
    assert kinds == [("<urn:x-page:2>", "<urn:x-page:1>"), ("<urn:x-page:5>", "<urn:x-page:3>")] + [("<urn:x-page:9>", "<urn:x-page:3>")] * 2 + [("<urn:x-page:none>", "<urn:x-page:3>")]


def test_warc_small_payloads_are_responses(spark, tmp_path):
    path = write(spark, tmp_path, page_rows(), revisit_bytes=100)
    assert warc.read_warc(spark, path).filter("record_id = '<urn:x-page:2>'").first().warc_type == "response"


def test_warc_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = write(spark, tmp_path, page_rows())
    revisits = warc.read_warc(spark, path, "skip").filter("warc_type = 'revisit' and target_uri like 'http://h/9%'")
    assert "warc_type" in revisits._jdf.queryExecution().executedPlan().toString()
    assert revisits.count() == 2 and revisits.filter("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert left == [GreaterThan(("payload_bytes",), 1)]


def test_warc_reads_members_of_other_writers(tmp_path):
    import gzip

    import pyarrow as pa

    plain = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    data = b"".join(gzip.compress(plain % (kind, i)) for i, kind in enumerate([b"response", b"warcinfo", b"response"] * 300))
    found = list(warc.records(pa.OSFile(str(_file(tmp_path, data))), lambda h: h["WARC-Type"] == "response", "keep"))
    assert len(found) == 600 and {p for _, _, p in found} == {b"hello"}
    with pytest.raises(ValueError):
        list(warc.records(pa.OSFile(str(_file(tmp_path, data[:-40]))), lambda h: True, "keep"))


def _file(tmp_path, data):
    path = tmp_path / f"{len(data)}.warc.gz"
    path.write_bytes(data)
    return path


def test_warc_saves_keep_earlier_archives(spark, tmp_path):
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    rows = [(i, "u", f"<p>{i}</p>", "p", 0) for i in range(1, 9)]
    write(spark, tmp_path, rows[:4])
    write(spark, tmp_path, rows[4:])
    assert ids() == [f"<urn:x-page:{i}>" for i in range(1, 9)]
    df = spark.createDataFrame([("a", "u", None, b"one")], "record_id string, target_uri string, refers_to string, payload binary")
    df.write.format("warc").mode("overwrite").save(str(tmp_path / "w"))
    assert ids() == ["a"]


def test_warc_abort_and_repeated_tasks_remove_own_files_only(tmp_path):
    import pyarrow as pa

    row = pa.RecordBatch.from_pylist([{"record_id": "a", "target_uri": None, "refers_to": None, "payload": b"x"}])
    names = lambda: sorted(p.name for p in tmp_path.iterdir())
    first, second = (warc.WarcWriter({"path": str(tmp_path)}) for _ in range(2))
    kept = first.write([row])
    first.write([row])  # the same task once more, its result is lost
    first.commit([kept, None])
    assert names() == sorted(kept.names)
    second.write([row])
    second.abort([None])
    assert names() == sorted(kept.names)


def test_warc_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, [])
    assert warc.read_warc(spark, path).count() == 0


def test_warc_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = sorted(con.execute(warc.ORACLE).fetchall())
    assert sorted(tuple(r) for r in warc.op5_warc(spark, d).collect()) == [tuple(r) for r in want]
