"""HTML against the standard library's parser on the given pages, and on broken pages by hand."""

import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import markup

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Tags in order, with the text right in them; p and li end as in the given pages."""

    def __init__(self):
        super().__init__()
        self.found, self.stack = [["", ""]], [0]

    def handle_starttag(self, tag, attrs):
        if tag in markup.BLOCKS and any(self.found[i][0] == "p" for i in self.stack):
            while self.found[self.stack.pop()][0] != "p":
                pass
        self.found.append([tag, ""])
        if tag not in markup.VOID:
            self.stack.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        if any(self.found[i][0] == tag for i in self.stack):
            while self.found[self.stack.pop()][0] != tag:
                pass

    def handle_data(self, data):
        self.found[self.stack[-1]][1] += data


def squeezed(x):
    return re.sub(r"\s+", " ", x).strip()


def test_elements_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in sorted(catalogue.queries()["html_elements"](spark, SF).collect(), key=lambda r: r.node):
        got.setdefault(r.page_id, []).append(r)
    for i, page in pages.items():
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert [(r.tag, r.text_md5) for r in got[i]] == [(t, hashlib.md5(squeezed(x).encode()).hexdigest()) for t, x in plain.found]
        assert all(r.parent is None if r.node == 0 else got[i][r.parent].depth == r.depth - 1 for r in got[i])


BROKEN = """<!DOCTYPE html><head><title>T &amp; t</title><script>var t="</p><b>";</script></head><body>
<h1>Head <b>one</b></h1><p>First<p>Second &lt;x&gt;<br>z<ul><li>a<li>b<ol><li>n1<li>n2</ol><li>c</ul>
<table><caption>cap<tr><th rowspan=2>H<th colspan="2">I<tr><td>1<td>2<table><tr><td>in</table><tr><td colspan=x>3</table>
<!-- <p>no</p> --><blockquote>q</blockquote></div> 1 < 2 <a href='u"v' title="x>y" HREF=w>l</a> end <style>p{}"""


def test_broken_pages(spark):
    df = spark.createDataFrame([(1, BROKEN), (2, None), (3, ""), (4, "<td>x</td></table>"), (5, "<p<b 'a>"), (6, "<!-- open")], "page_id int, html string").withColumn("table", F.lit("other"))
    rows = {(r.page_id, r.node): r for r in markup.elements(df).collect()}
    tags = [rows[1, n].tag for n in range(1, len([k for k in rows if k[0] == 1]))]
    assert tags == "head title script body h1 b p p br ul li li ol li li li table caption tr th th tr td td table tr td tr td blockquote a style".split()
    link = next(r for r in rows.values() if r.tag == "a")
    assert link.attributes == {"href": 'u"v', "title": "x>y"} and link.text == "l" and not any(k[0] == 2 for k in rows) and rows[3, 0].text == rows[6, 0].text == ""
    cells = sorted((r.table, r.row, r.column, r.rows, r.columns, r.heading, r.text) for r in markup.table_cells(df).filter("page_id = 1").collect())
    assert cells == [(0, 0, 0, 2, 1, True, "H"), (0, 0, 1, 1, 2, True, "I"), (0, 1, 1, 1, 1, False, "1"), (0, 1, 2, 1, 1, False, "2in"), (0, 2, 0, 1, 1, False, "3"), (1, 0, 0, 1, 1, False, "in")]
    said = {r.page_id: r.text for r in markup.structured_text(df).collect()}
    lines = [x for x in said[1].split("\n") if x]
    assert lines == ["# Head one", "First", "Second <x>", "z", "• a", "• b", "1. n1", "2. n2", "• c", "cap", "H | I", "1 | 2", "in", "|", "3", "> q", "1 < 2 l end"]
    assert said[2] is None and said[3] == said[6] == "" and said[4] == "x"


def test_cells_of_lists(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = set()
    for i, page in pages.items():
        for t, block in enumerate(re.findall(r"<ul>(.*?)</ul>", page)):
            items = [squeezed(re.sub("<[^>]*>", "", x)) for x in re.findall(r"<li>(.*?)</li>", block)]
            want.add((i, t, 0, 0, 2, 1, True, "list"))
            want |= {(i, t, n + 1, 1 if n == 0 else 0, 1, 1, False, x) for n, x in enumerate(items)}
            want |= {(i, t, n + 1, 2 if n == 0 else 1, 1, 1, False, "&") for n, _ in enumerate(items)}
    assert {tuple(r) for r in catalogue.queries()["html_table_cells"](spark, SF).collect()} == want and len(want) > 100


def test_odd_pages_take_linear_time():
    import time

    began = time.time()
    for page in ('<a "' * 50_000, "<p" * 50_000, "<div>" * 5_000, "<!" * 50_000, "<script></script" * 20_000, "<table><tr>" + "<td>x" * 20_000, "<b>" * 900 + "</i>" * 900):
        markup.nodes(page), markup.cells(page), markup.text_of(page)
    assert time.time() - began < 20
