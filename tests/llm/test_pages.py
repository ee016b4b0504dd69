"""Pages, archives and vectors."""

from __future__ import annotations

import hashlib
import io
import random
from collections import Counter

import pytest

from skarn.llm import archive, html, topk

PAGE_SCHEMA = "page_id long, url string, html string, host string, h long, templates string, digest string"


def page(i: int, body: str, host: str = "a.example") -> tuple:
    doc = (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>'
        f'<header><h2>Site name</h2></header><nav><ul><li><a href="/{i}">Item {i}</a></li></ul></nav><div class="top ad">Buy {i}</div>'
        f"<article><h1>Title {i}</h1>{body}<div class='comments'><p>Reader {i}</p></div></article>"
        f'<div>Follow us on the site</div><form><p>Mail</p></form><aside>Side {i}</aside><footer>&copy; {i}</footer></body></html>'
    )
    return (i, f"http://{host}/p/{i}", doc, "x", 1, "t", "d")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [page(i, f"<p>Text &amp; {i}\n  more&nbsp;text<br>next<p><b>open <i>bold</b> tail</p><p>Same passage</p>") for i in range(12)]
    rows += [(12, "http://b.example/", None, "x", 1, "t", "d"), (13, None, "", "x", 1, "t", "d"), (None, "http://b.example/x", "<p>No id", "x", 1, "t", "d")]
    rows += [rows[0], (20, "not a url", "plain text only", "x", 1, "t", "d"), (21, "http://b.example/y", "<p>" + "long text " * 20_000 + "</p>", "x", 1, "t", "d")]
    return spark.createDataFrame(rows, PAGE_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGE_SCHEMA)


def test_main_text(pages, no_pages):
    got = html.main_text(pages).collect()
    assert len(got) == 18 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        assert by[i] == f"Title {i}\nText & {i} more text\nnext\nopen bold tail\nSame passage"
    assert by[12] == by[13] == "" and by[None] == "No id" and by[20] == "plain text only" and by[21] == ("long text " * 20_000).strip()
    assert html.main_text(no_pages).count() == 0


def test_templates_without_an_article(spark):
    """No element names itself: what recurs on the host goes, what is the page's own stays, also on small hosts."""
    make = lambda i, host: (i, f"http://{host}/{i}", f"<body><div><div>Home News Contact</div><div><p>Own text of page {i}.</p><p>Second part {i}.</p></div><div>All rights kept by us</div></div></body>")
    rows = [make(i, "big.example") for i in range(30)] + [make(100, "small.example")]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Own text of page {i}.\nSecond part {i}." for i in range(30))
    assert by[100] == "Home News Contact\nOwn text of page 100.\nSecond part 100.\nAll rights kept by us"


def test_copies_of_a_page_are_no_template(spark):
    same = "<body><article><h1>T</h1><p>One text.</p></article></body>"
    by = html.main_text(spark.createDataFrame([(i, f"http://c.example/{i}", same) for i in range(50)], "page_id long, url string, html string")).collect()
    assert {r.text for r in by} == {"T\nOne text."}


def test_counts_decide_before_article_and_main(spark):
    """What is the page's own stays, wherever it stands; what recurs goes, also beside the article."""
    make = lambda i: f"<body><div><p>Home of all</p></div><main><p>Lead of {i}.</p><div>Shared teaser</div><article><p>First text {i}.</p></article><article><p>Second, longer text {i}.</p></article></main><p>Correction to {i}.</p></body>"
    rows = [(i, f"http://m.example/{i}", make(i)) for i in range(12)] + [(50, "http://few.example/", make(50))]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Lead of {i}.\nFirst text {i}.\nSecond, longer text {i}.\nCorrection to {i}." for i in range(12))
    assert by[50] == "Lead of 50.\nShared teaser\nFirst text 50.\nSecond, longer text 50."


def test_near_copies_count_once(spark):
    """Copies of a text among other pages of a host aren't its template, also where no element names an article."""
    make = lambda i, text: (i, f"http://n.example/{i}", f"<body><div>Menu of the site</div><div>Visit {i}</div><div>{text}</div></body>")
    copied = "<p>The first long paragraph of a text that was copied.</p><p>And its second paragraph, also copied.</p>"
    rows = [make(i, f"<p>Paragraph of page {i} alone, and no other.</p><p>Another one of page {i}.</p>") for i in range(30)] + [make(100 + i, copied) for i in range(6)]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("was copied.\nAnd its second" in by[100 + i] and "Menu" not in by[100 + i] for i in range(6)) and all("Menu" not in by[i] for i in range(30))


def test_templates_by_hand(spark):
    """The subtrees that Spark counts are those of a count by hand, host by host, over pages that differ."""
    from skarn.llm.common import Scratch

    rng = random.Random(7)
    parts = ["<div>Menu</div>", "<div><p>Box</p><p>of links</p></div>", "<section>News</section>", "<div>Imprint <b>now</b></div>"]
    rows = []
    for i in range(90):
        body = "".join(rng.sample(parts, rng.randint(0, 4))) + f"<article><p>Text of page {i}, which is its own and longer than others.</p><p>{rng.choice(['Common passage', f'More {i}'])}</p></article>"
        rows.append((i, f"http://h{i % 4}.example/{i}", f"<body>{body}</body>"))
    rows += [(100, "http://one.example/", rows[0][2]), (101, rows[0][1], rows[0][2])]
    want = {}
    for host in {html.host_of(u) for _, u, _ in rows}:
        own = [(i, *html.candidates(html.parse(t))) for i, u, t in rows if html.host_of(u) == host]
        different = {t: i for i, u, t in rows if html.host_of(u) == host}
        if len(different) >= 3:
            n = Counter(h for i, found, _ in own if i in different.values() for h in found)
            for i, found, _ in own:
                want[i] = {h - (1 << 63) for h in found if n[h] >= 3 and n[h] >= 0.02 * len(different)}
    got = html.site_templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), Scratch(spark, "t"))
    assert {r.page_id: set(r.templates) for r in got.collect()} == want and sum(map(bool, want.values())) > 60 and 100 not in want


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<ul><li>a<li>b</ul>", "a\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<p>a<p>b</div>c", "a\nbc"),
        ("<!-- <p>no</p> --><p>x<!-- y --> z</p>", "x z"),
        ("<p>1 < 2 &lt; 3 &#65;&#x42;</p>", "1 < 2 < 3 AB"),
        ("<SCRIPT>a</SCRIPT><P>b</P>", "b"),
        ("<p title='a>b'>c</p>", "c"),
        ("<div hidden>x</div><p style='display:none'>y</p><p>z", "z"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<script>never closed <p>x", ""),
        ("<textarea>t</textarea>ok", "ok"),
    ],
)
def test_markup(source, text):
    assert html.extract(source, frozenset()) == text


# archives


def test_arc_versions():
    v1 = archive.arc_version_block(1, "20000101000000", "f") + "\n" + archive.arc_record(1, "http://a/b c", "1.2.3.4", "20010203040506", "text/html", "HTTP/1.0 200 OK\n\nbødy".encode(), 0, "f").decode() + "\n"
    v2 = archive.arc_version_block(2, "20000101000000", "f") + "\n" + archive.arc_record(2, "http://a/", "1.2.3.4", "2001", "text/plain", b"raw", 9, "f").decode() + "\n"
    (f1, b1), = archive.read_arc(io.BytesIO(v1.encode()))
    (f2, b2), = archive.read_arc(io.BytesIO(v2.encode()))
    assert (f1["url"], f1["version"], archive.split_http(b1)) == ("http://a/b c", "1", ("HTTP/1.0 200 OK\n\n", "bødy".encode()))
    assert (f2["status"], f2["offset"], f2["version"], b2) == ("200", "9", "2", b"raw")
    assert archive.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archive.warc_date("2001") == "2001-01-01T00:00:00Z" and archive.warc_date("x")[:4] == "1970"
    for bad in (v1[:-8], "no header\n", v1.replace(" 1.2.3.4", "")[:-3]):
        with pytest.raises(ValueError):
            list(archive.read_arc(io.BytesIO(bad.encode())))


def test_archives(spark, pages, no_pages, monkeypatch):
    rows = [(i, f"http://h/{i % 3} x", ("same" * 400 if i % 2 else f"tiny {i % 2}") + ("é\r\n\r\nWARC/1.1" if i % 4 == 1 else "")) for i in range(20)]
    monkeypatch.setattr(archive, "FILE_BYTES", 5000)
    rows += [(50, None, None), (51, "u", ""), (None, "u", "same" * 400), (7, "again", rows[7][2])]
    for df in (spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), no_pages):
        monkeypatch.setattr(archive, "table", lambda s, d, n, df=df: df)
        got = archive.op9_arc_to_warc(spark, "").collect()
        data = rows if df is not no_pages else []
        best = {}
        for i, _, t in data:
            b = (t or "").encode()
            if len(b) >= 1000 and i is not None:
                best[b] = max(i, best.get(b, i))
        want = Counter()
        for i, _, t in data:
            b = (t or "").encode()
            k = best.get(b, i) if i is not None else i
            want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if k == i else "revisit", None if k == i else k] += 1
        assert Counter(tuple(r) for r in got) == want


def test_archives_keep_bytes(spark, tmp_path):
    """Heads and payloads that aren't UTF-8, and copies whose heads have no length."""
    binary = bytes(range(256)) * 8
    blocks = [b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\nServer: caf\xe9\r\n\r\n" % i + p for i, p in enumerate((b"na\xefve \xff", binary, binary, b"\x1f\x8b\x00\r\n\r\nWARC/1.1", b""))] + [b"\x89PNG\r\n\xff", b"\x89PNG\r\n\xff"]
    raw = archive.arc_version_block(1, "20000101000000", "f").encode() + b"\n"
    raw += b"".join(b"http://a/\xe9%d 1.2.3.4 20010203040506 text/html %d\n%s\n" % (min(i, 5), len(b), b) for i, b in enumerate(blocks))
    (tmp_path / "f.arc").write_bytes(raw)
    archive.convert(archive._files(spark, str(tmp_path / "f.arc")), str(tmp_path / "warc"))
    files = archive._files(spark, str(tmp_path / "warc"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in archive.warc_rows(files).collect())
    payloads = [b.split(b"\r\n\r\n", 1)[1] for b in blocks[:5]]
    kinds = ["response", "revisit", "response", "response", "response"]
    want = Counter((i, len(p), hashlib.sha1(p).hexdigest(), k) for i, (p, k) in enumerate(zip(payloads, kinds, strict=True)))
    want[None, len(blocks[5]), hashlib.sha1(blocks[5]).hexdigest(), "resource"] += 2
    assert got == want
    records = [r for f in files.collect() for r in archive.read_warc(archive._stream(bytes(f.content))) if r[0]["warc-type"] != "warcinfo"]
    assert Counter(b for _, b in records) == Counter([blocks[0], blocks[1].removesuffix(binary), *blocks[2:]])
    assert len({f["warc-record-id"] for f, _ in records}) == len(records)  # also of records without an id, of one URL and date
    assert {f["warc-target-uri"] for f, _ in records} == {f"http://a/%E9{i}" for i in range(6)}


# top-k


def test_top_k_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(500, None), (501, [1.0, None] * 20), (502, [float("nan")] * 40), (550, [float("inf")] * 40), (503, [1.0] * 3), (600, [2.0] * 3), (650, []), (None, [1.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    q = df.selectExpr("vec_id", "embedding").select("vec_id", topk.quantise(df.embedding).alias("vector"))
    got = {}
    for r in topk.top_k(q.where("vec_id % 50 = 0"), q, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    import numpy as np

    ints = {i: np.floor(256 * np.float64(np.float32(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for i in [i for i in ints if i % 50 == 0]:
        all_ = sorted(((-int(ints[i] @ x), j) for j, x in ints.items() if j != i and len(x) == len(ints[i])))[:5]
        assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(all_)]
    none = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(q, none).count() == 0


def test_large_components_stay_exact(spark):
    """Sums beyond what doubles hold, and products beyond 64 bits whose sums are within."""
    rng = random.Random(5)
    for size, rows in ((2**29, 60), (2**40, 40)):
        vectors = [[rng.randrange(-size, size) for _ in range(20)] for _ in range(rows)]
        if size > 2**30:
            vectors = [[float(x) for y in v[:10] for x in (y, -y)] for v in vectors]  # halves that nearly cancel
            vectors = [[v[0] + 1, *v[1:]] if i % 2 else [abs(x) // 2**20 for x in v] for i, v in enumerate(vectors)]
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, vector array<double>").repartition(4)
        small = [i for i in range(rows) if size < 2**30 or i % 2 == 0]
        got = {}
        for r in topk.top_k(df.where(df.vec_id.isin(small[:5])), df.where(df.vec_id.isin(small)), 3).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in small[:5]:
            want = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], vectors[j], strict=True)), j) for j in small if j != q)[:3]
            assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    huge = spark.createDataFrame([(i, [2.0**70, 1.0]) for i in range(3)], "vec_id long, vector array<double>")
    with pytest.raises(Exception, match="too large for a 64-bit integer"):
        topk.top_k(huge, huge).collect()
    apart = spark.createDataFrame([(0, [2.0**70, 1.0]), (1, [0.0, 3.0]), (2, [0.0, 5.0])], "vec_id long, vector array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(apart.where("vec_id = 0"), apart, 2).orderBy("rank").collect()] == [(2, 5), (1, 3)]


def test_known_scores_only_prune():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 300, (3000, 48)))
    queries = topk.Block.of(np.arange(0, 60), x[:60])
    known, found = {}, {}
    for lo in range(0, 3000, 500):
        for q, c, s in topk.search_block(queries, topk.Block.of(np.arange(lo, lo + 500), x[lo : lo + 500]), 5, known):
            found.setdefault(q, []).append((-s, c))
    for q in range(60):
        s = x @ x[q]
        assert sorted(found[q])[:5] == sorted((-int(s[j]), j) for j in range(3000) if j != q)[:5]


def test_top_k_keeps_to_its_columns(spark):
    """Columns of the operator's own names in the tables don't disturb it."""
    df = spark.createDataFrame([(i, [float(i), 1.0], i, b"x", 7, 8) for i in range(60)], "vec_id long, vector array<double>, dim int, q_ids binary, score long, rank int")
    assert topk.top_k(df.where("vec_id = 50"), df, 2).collect() == topk.top_k(df.where("vec_id = 50").select("vec_id", "vector"), df.select("vec_id", "vector"), 2).collect()
