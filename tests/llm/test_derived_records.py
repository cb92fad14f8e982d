"""Derived records of all given pages: ids, links and digests by SQL, texts by another parser."""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import duckdb

from ledgerleaf.llm import warc
from ledgerleaf.llm.common import table

BREAKS, UNSEEN = warc._BREAKS, ("script", "style", "noscript", "template")


class Page(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.links, self.lang, self.hidden, self.titles = [], [], [], "", 0, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag in UNSEEN:
            self.hidden += 1
        if tag == "a" and "".join(named.get("href", "").split()):
            self.links.append("".join(named["href"].split()))
        if tag == "html" and not self.lang:
            self.lang = named.get("lang", "")
        self.titles += tag == "title"
        self.text.append("\n" if tag in BREAKS else "")
        self.inside = tag

    def handle_endtag(self, tag):
        self.hidden -= tag in UNSEEN
        self.text.append("\n" if tag in BREAKS else "")
        self.inside = None

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.titles == 1 and self.inside == "title":
                self.title.append(data)

    def lines(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.text).split("\n")) if x)


SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, sha256('response' || chr(31) || coalesce(page_id::VARCHAR, '') || chr(31) || coalesce(url, '') || chr(31) || sha256(coalesce(html, ''))) AS h FROM pages),
s AS (SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS id FROM p),
d AS (SELECT s.*, k, sha256(k || chr(31) || id) AS h2, sha256(CASE k WHEN 'metadata' THEN 'conversion' ELSE 'metadata' END || chr(31) || id) AS h3 FROM s, (VALUES ('metadata'), ('conversion')) v(k))
SELECT page_id, k, '<urn:uuid:' || substr(h2, 1, 8) || '-' || substr(h2, 9, 4) || '-5' || substr(h2, 14, 3) || '-8' || substr(h2, 18, 3) || '-' || substr(h2, 21, 12) || '>', id,
 '<urn:uuid:' || substr(h3, 1, 8) || '-' || substr(h3, 9, 4) || '-5' || substr(h3, 14, 3) || '-8' || substr(h3, 18, 3) || '-' || substr(h3, 21, 12) || '>', target_uri, 'sha256:' || sha256(payload) FROM d
"""


def test_all_pages(spark, data):
    pages = table(spark, data, "pages")
    derived = warc.derive(warc.responses(pages)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    told = sorted((r.page_id, r.record_type, r.record_id, r.refers_to, r.linked_id, r.target_uri, r.source_payload_digest) for r in derived)
    assert told == sorted(con.sql(SQL).fetchall()) and len(told) == 2 * pages.count()
    by_page = {(r.page_id, r.record_type): r for r in derived}
    for page in pages.collect():
        other = Page(page.html or "")
        text, title, language, links = warc.scanned(page.html)
        assert ([" ".join(x.split()) for x in text.split("\n")], title, language, links) == (other.lines().split("\n"), " ".join("".join(other.title).split()), other.lang, other.links)
        conversion, metadata = by_page[page.page_id, "conversion"], by_page[page.page_id, "metadata"]
        assert conversion.block == text and conversion.content_length == len(text.encode()) and conversion.block_digest == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in metadata.block.split("\r\n") if x.startswith("outlink: ")] == [f"outlink: {x}" for x in links]
