"""Page operators: URL verdicts, main text, archives."""

import base64
import hashlib
import html
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from dialframe.llm import template_extract, url_gbt, warc_bundles
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

PAGES = "page_id long, url string, html string, host string, label string, score string, salt string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


# ---- op3: URLs

URLS = [
    (1, "http://a.NET/x", "a.net", "/x", "net/", "block"),
    (2, "http://www.Example.net/en/1?q=/de/", "www.example.net", "/en/1", "example.net/en/", "allow"),
    (3, "https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    (4, "https://badexample.com/de/1", "badexample.com", "/de/1", None, None),
    (5, "https://m.example.com/de/1#x", "m.example.com", "/de/1", "example.com/de/", "block"),
    (6, "https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    (7, "https://x.org/EN", "x.org", "/EN", None, None),
    (8, "no scheme.net/x", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "http://a.net", "a.net", "", None, None),
    (11, "a?u=http://b.net/x", "b.net", "/x", "net/", "block"),
    (12, "://h.net?x/", "h.net", "", None, None),
    (1, "http://a.NET/x", "a.net", "/x", "net/", "block"),
    (None, "http://" + "a" * 50_000 + ".com/" + "-" * 50_000, "a" * 50_000 + ".com", "/" + "-" * 50_000, None, None),
]


def test_rules_and_parts(spark):
    got = url_gbt.judge(pages(spark, [(i, u, None) for i, u, *_ in URLS])).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(
        (i, h, p, r) for i, _, h, p, r, _ in URLS)
    want = {u: v for i, u, _, _, _, v in URLS if v}
    by_id = {i: u for i, u, *_ in URLS}
    assert all(r.verdict == want[by_id[r.page_id]] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_url_edge_tables(spark):
    assert url_gbt.judge(pages(spark, [])).count() == 0
    one = url_gbt.judge(pages(spark, [(1, "http://a.com/", None)])).collect()
    assert [r.verdict for r in one] == ["allow"]


def test_trees_learn_held_out_urls(spark):
    """URLs that no rule decides, of the half that the trees have not seen."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = rows.withColumns({"host": url_gbt.host_of(rows.url), "path": url_gbt.path_of(rows.url)})
    model = url_gbt.train(url_gbt.weak_labels(rows.where("page_id % 2 = 0")))
    rule, _ = url_gbt.rule_columns(rows.host, rows.path)
    held = rows.where("page_id % 2 = 1").where(rule.isNull())
    said = model.verdicts(held).select("url", "model_verdict").distinct()
    both = said.join(url_gbt.weak_labels(held).distinct(), "url").collect()
    assert {r.label for r in both} == {0.0, 1.0}
    assert sum((r.model_verdict == "block") == (r.label == 1) for r in both) > 0.97 * len(both)


def test_url_query(spark):
    got = entry.queries()["op3_url_gbt"](spark, SF_CHECK)
    assert got.count() == spark.read.parquet(f"{SF_CHECK}/pages.parquet").count()
    again = entry.queries()["op3_url_gbt"](spark, SF_CHECK)
    assert got.exceptAll(again).count() == 0


# ---- op6: main text

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">buy</div>
<aside>side</aside><div id="cookie-notice">ok?</div><form><p>name</p><input value="v"></form>
<article><h1>Head &amp; title</h1><p>One <b>two</b>&nbsp;three<br>four<p>five &lt;six&gt; &#233;&eacute
<ul><li>a<li>b</ul><div class="share">tweet</div><table><tr><td>c<td>d</table><noscript>off</noscript></article>
<section class="comments"><p>first!</p></section><footer>&copy; me</footer></body></html>"""
WANT = "Head & title\nOne two three four\nfive <six> éé\na\nb\nc\nd"


@pytest.mark.parametrize("page, want", [
    (ARTICLE, WANT), (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>cut <b>off</b", "cut off"), ("<p>a</", "a</"),
    ("<p>x</p><p", "x"), ("<article><p>in</p></article><p>out</p>", "in"), ("<div>a<span>b</span> c</div>", "ab c"),
    ("<p>" + "w " * 200_000 + "</p>", ("w " * 200_000).strip()), ("a < b <i>c</i>", "a < b c"), ("<script>x", ""),
    ("<main><p>m</p><div class=ad>z</div></main>", "m"), ("&am &amp x", "&am & x"),
])
def test_main_text(page, want):
    assert template_extract.main_text(page) == want


def test_template_classes_and_extraction(spark):
    rows = [(i, f"http://h.com/{i}", ARTICLE.replace("One", f"Page {i}")) for i in range(6)]
    rows += [(7, "http://other.org/1", ARTICLE), (8, None, None), (9, "http://h.com/9", "<p>odd page</p>"),
             (1, "http://h.com/1", ARTICLE.replace("One", "Page 1")), (None, "http://h.com/n", ARTICLE)]
    found = template_extract.extract(pages(spark, rows)).collect()
    assert Counter((r.page_id, r.text) for r in found) == Counter(
        (i, template_extract.main_text(h)) for i, _, h in rows)
    assert {r.text for r in found if r.page_id == 3} == {WANT.replace("One", "Page 3")}
    hosts = {r.host: r for r in template_extract.templates(pages(spark, rows)).collect()}
    assert set(hosts) == {"h.com"}
    assert "html/body/article" in hosts["h.com"].classes[0]
    assert "html/body/nav/ul/li/a" in hosts["h.com"].menus
    assert template_extract.extract(pages(spark, [])).count() == 0


def test_link_slots_outside_the_article_go(spark):
    page = "<body><div><a href=1>l1</a><a href=2>l2</a></div><p>text {}</p></body>"
    rows = [(i, "http://q.com/", page.format(i)) for i in range(5)]
    assert {r.text for r in template_extract.extract(pages(spark, rows)).collect()} == {f"text {i}" for i in range(5)}


def test_template_decides_inside_the_article(spark):
    """A list of links without a telling tag or class goes by the host's template; links in headings and sentences stay."""
    page = ("<body><{0}><h1><a href=0>Head {1}</a></h1><p>words {1} and <a href=1>a link</a> and some more words</p>"
            "<ul><li><a href=2>older</a></li><li><a href=3>newer</a></li></ul><p>end {1}</p></{0}></body>")
    want = "Head {0}\nwords {0} and a link and some more words\n{1}end {0}"
    rows = [(i, f"http://{tag}.com/{i}", page.format(tag, i)) for tag in ("article", "main", "div") for i in range(5)]
    assert {template_extract.main_text(h) for _, _, h in rows} == {want.format(i, "older\nnewer\n") for i in range(5)}
    got = template_extract.extract(pages(spark, rows)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((i, want.format(i, "")) for i, _, _ in rows)


def test_extraction_query_equals_plain_cut(spark):
    got = {r.page_id: r for r in entry.queries()["op6_template_extract"](spark, SF_CHECK).collect()}
    for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


# ---- op9: archives

ARCHIVE = [(5, "http://a/", "<p>same</p>"), (3, "http://b/\r\nX: y%0A", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "u", None),
           (6, "u", ""), (7, "é", "ünï😀" * 40_000), (8, "u", "\r\n\r\nWARC/1.1"), (3, "http://b/\r\nX: y%0A", "<p>same</p>"),
           (None, "n", "<p>same</p>"), (12, "u", "lone")]


def test_archive_round_trip(spark, monkeypatch):
    folder = warc_bundles.archive_folder(spark)
    index = warc_bundles.write_bundles(pages(spark, ARCHIVE), folder)
    got = warc_bundles.read_bundles(index, folder).collect()
    first = {}
    for i, _, h in ARCHIVE:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, u, h in ARCHIVE:
        data = (h or "").encode()
        refers = first[h or ""] if first[h or ""] != i else None
        want[(i, u, "revisit" if refers is not None else "response", len(data),
              base64.b32encode(hashlib.sha1(data).digest()).decode(), refers, b"" if refers is not None else data)] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload))
                   for r in got) == want
    for row in index.collect():  # one record by its frame alone
        assert warc_bundles.read_record(folder, row)["page_id"] == row.page_id


def test_frames_are_independent_and_seekable(tmp_path):
    import pyarrow.fs as pafs
    import zstandard
    fs = pafs.LocalFileSystem()
    writer, rows = warc_bundles.BundleWriter(fs, str(tmp_path), "x.zst", 0), []
    for i in range(40):
        rows += writer.add(i, warc_bundles.record_bytes(i, "u", "D", bytes([65 + i % 26]) * 30_000, None))
    rows += writer.close()
    data = (tmp_path / "x.zst").read_bytes()
    with fs.open_input_file(str(tmp_path / "x.zst")) as f:
        table = warc_bundles.read_seek_table(f, f.size())
    assert len(table) > 2 and sum(p for p, _ in table) + 8 + 8 * len(table) + 9 == len(data)
    for i, _, frame, offset, size, at, n in rows:
        plain = zstandard.ZstdDecompressor().decompress(data[offset:offset + size])
        assert warc_bundles.parse_record(plain, at)[0]["page_id"] == i
    # A plain decompressor reads the whole file and skips the seek table.
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == sum(d for _, d in table)


def test_empty_archive(spark):
    folder = warc_bundles.archive_folder(spark)
    index = warc_bundles.write_bundles(pages(spark, []), folder)
    assert index.count() == 0 and warc_bundles.read_bundles(index, folder).count() == 0


def test_archive_query_matches_oracle(spark):
    res = compare(spark, duck(SF_CHECK), "op9_warc_bundles", SF_CHECK)
    assert res.get("match"), res
    assert "type_mismatch" not in res, res


def test_bundles_are_read_by_many_tasks(spark):
    """Every bundle goes to a task of its own while there are tasks enough."""
    from pyspark.sql import functions as F
    rows = [(i, f"http://h.com/{i}", f"<p>page {i}</p>") for i in range(64)]
    folder = warc_bundles.archive_folder(spark)
    index = warc_bundles.write_bundles(pages(spark, rows).repartition(6), folder)
    bundles = index.select("bundle").distinct().count()
    found = warc_bundles.read_bundles(index, folder)
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert bundles > 1 and tasks >= min(bundles, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert found.count() == 64
