"""WARC, media and HTML operators: round trips and hand-made pages."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tallysift.llm import html, media, warc
from tallysift.llm.store import listed, opened
from tallysift.session import scratch

BIG = "<p>" + "é text " * 400 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2\n x", BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "u", "x" * 999), (9, "u", "x" * 999), (3, None, BIG)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)


def archives(spark, pages, **size):
    folder = scratch(spark, "t")
    whole = warc.write_archives(warc.typed(pages), f"{folder}/whole", **size)
    whole.cache().count()
    return folder, whole


def test_warc_round_trip(spark, pages):
    folder, whole = archives(spark, pages, archive_bytes=3000)
    members = warc.normalise(whole, f"{folder}/members").cache()
    assert members.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read_members(members).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["block_bytes"]) for r in rows)
    size = len(BIG.encode())
    want = [("1", "revisit", "3", 0), ("2", "revisit", "3", 0), ("3", "response", "None", size), ("3", "response", "None", size), ("None", "revisit", "3", 0)]
    want += [("4", "response", "None", 5), ("5", "response", "None", 5), ("6", "response", "None", 0), ("7", "response", "None", 0), ("8", "response", "None", 999), ("9", "response", "None", 999)]
    assert got == sorted(want)
    for r in rows:
        if r["record_type"] == "response":
            assert r["stated_digest"] == r["block_digest"]
        else:
            assert r["stated_digest"] == hashlib.sha1(BIG.encode()).hexdigest()
    assert {r["url"] for r in rows} == {"http://a/1", "http://a/2%0A%20x", None, "u"}


def test_members_stand_alone(spark, pages):
    folder, whole = archives(spark, pages)
    row = warc.normalise(whole.limit(1), f"{folder}/members").first()
    with opened(row["archive"]) as f:
        raw = f.read()
    with opened(row["index"]) as f:
        entries = [json.loads(x) for x in f.read().splitlines()]
    source = whole.filter(F.col("archive").endswith(row["archive"].rpartition("/")[2])).first()["archive"]
    with opened(source) as f:
        inflated = gzip.decompress(f.read())
    assert b"".join(gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) for e in entries) == inflated
    assert sum(e["length"] for e in entries) == len(raw)


def test_damaged_archives_are_named(spark, tmp_path):
    good = gzip.compress(warc.record_head(1, "u", "00" * 20, "response", None, 3) + b"abc\r\n\r\n")
    for name, raw in (("cut", good[:-12]), ("other", gzip.compress(b"no archive\r\n")), ("plain", b"no gzip")):
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(raw)
        frame = spark.createDataFrame([(f"file://{path}",)], "archive string")
        with pytest.raises(Exception, match=f"{name}.warc.gz"):
            warc.normalise(frame, f"file://{tmp_path}/out").collect()
    assert not listed(f"file://{tmp_path}/out", ".gz")
    two = b"".join(gzip.compress(warc.record_head(i, "u", "00" * 20, "response", None, 1) + b"x\r\n\r\n") for i in range(2))
    assert len(list(warc.read_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(two)))))) == 2


def test_a_task_for_each_archive(spark):
    names = spark.createDataFrame([(f"part-{i:04d}",) for i in range(23)], "archive string").repartition(5)
    used = warc.by_archive(names).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 20


def test_op2_with_repeated_page_ids(spark, tmp_path):
    a, b = "<p>" + "a" * 2000, "<p>" + "b" * 2000
    rows = [(5, "u", a), (5, "u", b), (3, "u", a), (2, "u", b), (None, "u", b), (7, "u", None), (7, "u", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op2_warc_members(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(str(i), len(t or ""), sha(t), "response" if i in (5, 7) else "revisit", None if i in (5, 7) else 5) for i, _, t in rows]
    assert got == sorted(want)


def test_warc_empty(spark, pages):
    folder, whole = archives(spark, pages.limit(0))
    assert whole.count() == 0


TEXTS = [(1, "hello"), (2, None), (3, ""), (4, "é" * 64), (5, "x" * 128), (6, "hello"), (None, "no key"), (7, "long text " * 60000)]


def test_media_round_trip(spark):
    frame = spark.createDataFrame([(k, t, b"q") for k, t in TEXTS], "key long, text string, media binary").repartition(2)
    folder = scratch(spark, "m")
    assert media.write_media(frame, folder, archive_bytes=300).agg(F.sum("members")).first()[0] == len(TEXTS)
    spark.dataSource.register(media.MediaSource)
    for step in (100, 1 << 24):  # ranges smaller than members, and larger than archives
        read = spark.read.format("media_archives").option("rangeBytes", step).load(folder)
        rows = {r["key"]: r for r in media.describe(read).collect()}
        assert len(rows) == len(TEXTS)
        for key, text in TEXTS:
            raw = (text or "").encode()
            pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            r = rows[key]
            assert len(pay) % 64 == 0 and pay
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        a, b = rows[1].asDict(), rows[6].asDict()
        assert {k: v for k, v in a.items() if k != "key"} == {k: v for k, v in b.items() if k != "key"}


def test_media_empty_folder(spark):
    assert media.read_media(spark, scratch(spark, "none")).count() == 0


def test_member_is_read_again(tmp_path, monkeypatch):
    blob = media.encode(media.padded(b"abc"))
    (tmp_path / "a").write_bytes(blob)
    calls = []

    class Flaky(io.BytesIO):
        def read(self, *a):
            calls.append(1)
            data = super().read(*a)
            return data[:-1] + b"?" if len(calls) < 3 else data

    monkeypatch.setattr(media, "opened", lambda uri: Flaky(blob))
    monkeypatch.setattr(media, "WAIT_S", 0)
    assert media.member("a", 0, len(blob), zlib.crc32(blob)) == blob and len(calls) == 3
    with pytest.raises(media.BadMember):
        media.member("b", 0, len(blob), 1)


@pytest.mark.parametrize("bad", [b"", b"x" * 100, media.encode(bytes(64))[:40], media.encode(bytes(64)).replace(b"IDAT", b"IDAU")])
def test_bad_media(bad):
    with pytest.raises(Exception):
        media.decode(bad)


ARTICLE = "<article><h1>Title</h1><p>First &amp; foremost\n  <b>bold</b>text.</p><p>Be.</p><div>Third<br>line &eacute;&#8212;x</div></article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (ARTICLE, "Title\nFirst & foremost boldtext.\nBe.\nThird line é—x"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>{ARTICLE}<aside>Side</aside><footer>Foot</footer></body>", "Title\nFirst & foremost boldtext.\nBe.\nThird line é—x"),
        (f'<div class="ad">Buy</div><div class="sidebar-left">S<div>inner</div></div>{ARTICLE}<section id="comments"><article>reader comment that is rather long</article></section>', "Title\nFirst & foremost boldtext.\nBe.\nThird line é—x"),
        ("<article><p>Kept.</p><form><input>no</form><script>var a='</p>';</script><div class='cookie-notice'>no</div><p>End.</article>", "Kept.\nEnd."),
        ('<div class="ad">never closed<article><p>Text.</p></article>', "Text."),
        ("<p>A paragraph of the page without an article element, long enough to count as content.<p>And another one of about the same length, which follows the first.<div class=menu><a>x</a></div>", "A paragraph of the page without an article element, long enough to count as content.\nAnd another one of about the same length, which follows the first."),
        ("", ""),
        (None, ""),
        ("<nav>only menu</nav>", ""),
        ("plain text", "plain text"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_extract(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", "<article><p>" + "word " * 50000 + "</p></article>")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(frame).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(frame.limit(0)).count() == 0


def test_smoothing_keeps_constants():
    assert html.smoothed([2.0] * 9) == pytest.approx([2.0] * 9)


LINK_ROWS = "".join("<div><a href=x>One</a> <a href=y>Two</a> <a href=z>Three</a></div>" for _ in range(8))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p class=notice>Cookie note<p>Body one is long enough<p>Body two", "Body one is long enough\nBody two"),
        ("<ul><li class=menu>x<li>keep me</ul><p>Text", "keep me\nText"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>" + "word " * 50 + "</article>", "Title\n" + ("word " * 50).strip()),
        ("<p>a <![foo[ b ]]> c<p>rest " + "x " * 30, "a c\nrest " + ("x " * 30).strip()),
        ("<table><tr><td class=ads>buy<td>cell one</table>", "cell one"),
        ("<div class=sidebar><p>one</div><p>two", "two"),
    ],
)
def test_malformed_pages(page, want):
    assert html.main_text(page) == want


def test_every_prefix_of_a_page_is_read():
    page = "<!doctype html><![if x]><p class='a>b'>t &amp; &#x41 <!-- c --><a href=\"q\">l</a><script>var x = '<p>';</script><article><p>z"
    for n in range(len(page)):
        html.main_text(page[:n])


def test_ratio_clusters_choose_lines(monkeypatch):
    """Rows of links stay only in clusters of content: without the threshold the same page keeps them all."""
    page = "<main><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p>" + LINK_ROWS + "</main>"
    assert html.main_text(page).count("One Two Three") <= 2
    monkeypatch.setattr(html, "content_lines", lambda lines: [True] * len(lines))
    assert html.main_text(page).count("One Two Three") == 8
