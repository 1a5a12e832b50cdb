"""Dumps by the format wikidump and by Spark's text reader: prefixes, ranges, streams, SQL, the first articles in order."""

import bz2
import html
import random

import pytest

from lexmill.sources import dumpsource, wiki


def page(k, text, prefix="", name="page", attributes="", ns="0"):
    p = f"{prefix}:" if prefix else ""
    return f"  <{p}{name}{attributes}>\n    <{p}title>Page {k}</{p}title>\n    <{p}ns>{ns}</{p}ns>\n    <{p}revision><{p}id>{k}</{p}id><{p}text bytes=\"1\" xml:space=\"preserve\">{html.escape(text)}</{p}text></{p}revision>\n  </{p}{name}>\n"


def dump(pages, prefix=""):
    p, name = (f"{prefix}:", f":{prefix}") if prefix else ("", "")
    return f'<{p}mediawiki xmlns{name}="http://www.mediawiki.org/xml/export-0.11/" xml:lang="en">\n  <{p}siteinfo><{p}sitename>W</{p}sitename></{p}siteinfo>\n{"".join(pages)}</{p}mediawiki>\n'


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["one", "<b>two</b>", "three & four", "é🎈", "[[x|y]]", "page&gt;", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("prefix", ["", "m", "wiki.x-1"])
@pytest.mark.parametrize("name", ["page", "wikipage"])
def test_any_prefix_and_tag(spark, tmp_path, prefix, name):
    """Plain and bz2, in ranges of any size: the same pages by the format and by the text reader."""
    own = texts(60)
    body = dump([page(k, t, prefix, name, ' id="7" x="a b"' if k % 4 == 0 else "") for k, t in enumerate(own)], prefix).encode()
    (tmp_path / "d.xml").write_bytes(body)
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(body[:5_000]) + bz2.compress(body[5_000:]))
    want = sorted((f"Page {k}", "0", t) for k, t in enumerate(own))
    for path, split in (("d.xml", 700), ("d.xml", 1 << 20), ("d.xml.bz2", 700)):
        rows = dumpsource.read_pages(spark, str(tmp_path / path), split).collect()
        assert sorted((r.title, r.ns, r.text) for r in rows) == want
        assert [r.title for r in sorted(rows, key=lambda r: (r.split, r.pos))] == [f"Page {k}" for k in range(60)]
        assert split > 700 or path.endswith("bz2") or len({r.split for r in rows}) > 10
    for path in ("d.xml", "d.xml.bz2"):
        assert sorted(map(tuple, wiki.read_pages(spark, str(tmp_path / path)).collect())) == want


ODD = [
    ("<page><title>A</title><revision><text>x</text></revision></page>", [("A", None, "x")]),
    ("<page><title/><ns>1</ns><ns>2</ns><revision><text></text></revision><text>no</text></page>", [("", "1", "")]),
    ("<page/><page></page>", [(None, None, None)] * 2),
    ("<page><title>A</title><text><![CDATA[<page>]]> &#233;<!-- <page> --></text></page>", [("A", None, "<page> é")]),
    ("<page><title>A</wrong></page><page><title>B</title></page>", [("B", None, None)]),
    ("<page><title>A &nope; </title></page>\n<x:page><x:title>B</x:title></x:page>", [("B", None, None)]),
    ("no <b>page here", []),
    ("<page><title>never closed", []),
    ("<subpage><title>A</title></subpage><pagenot><title>B</title></pagenot>", [("A", None, None)]),
]


@pytest.mark.parametrize(("body", "want"), ODD)
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_parser_reads_on(body, want, size):
    raw = f"<mediawiki>{body}</mediawiki>".encode()
    assert list(dumpsource.pages((raw[k : k + size] for k in range(0, len(raw), size)), None)) == want


def test_ranges_share_no_page():
    """Whatever the cuts, each page is read by exactly one range."""
    raw = dump([page(k, t) for k, t in enumerate(texts(30, 3))]).encode()
    want = list(dumpsource.pages(iter([raw]), None))
    assert len(want) == 30
    for size in (50, 333, 2_000):
        got = []
        for start in range(0, len(raw), size):
            got += dumpsource.pages((raw[k : k + 64] for k in range(start, len(raw), 64)), min(size, len(raw) - start))
        assert got == want


def test_format_in_sql_and_streams(spark, tmp_path):
    (tmp_path / "a.xml").write_text(dump([page(k, f"text {k}") for k in range(5)]))
    dumpsource.register(spark)
    spark.sql(f"create or replace temporary view dumped using wikidump options (path '{tmp_path}', splitBytes '300')")
    assert spark.sql("select count(*), max(text), count(distinct split) > 1 from dumped").first()[:] == (5, "text 4", True)
    stream = spark.readStream.format("wikidump").load(str(tmp_path))
    query = stream.select("title", "text").writeStream.format("memory").queryName("dump_stream").option("checkpointLocation", str(tmp_path / "_state")).start()
    query.processAllAvailable()
    (tmp_path / "b.xml").write_text(dump([page(9, "later")]))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.text for r in spark.table("dump_stream").collect()) == ["later", *(f"text {k}" for k in range(5))]


def test_first_articles_in_order(spark, tmp_path):
    """The same rows for any ranges and partitions; ranges behind the last one needed aren't read."""
    long = "word " * 120
    for f in range(4):
        (tmp_path / f"d{f}.xml").write_text(dump([page(100 * f + k, f"{long} {f} {k}", ns=str(k % 3 % 2)) for k in range(30)]))
    titles = [f"Page {100 * f + k}" for f in range(4) for k in range(30) if k % 3 != 1]
    for n in (0, 1, 25, 79, 500):
        for split in (1 << 20, 5_000):
            rows = dumpsource.first_articles(spark, str(tmp_path), n, split).collect()
            assert [r.title for r in sorted(rows, key=lambda r: (r.split, r.pos))] == titles[:n]
    # A range that is read after all raises: the file isn't bz2.
    (tmp_path / "e.xml.bz2").write_bytes(b"no archive")
    assert dumpsource.first_articles(spark, str(tmp_path), 15).count() == 15
    with pytest.raises(Exception, match="Invalid data stream"):
        dumpsource.first_articles(spark, str(tmp_path), 500).count()
