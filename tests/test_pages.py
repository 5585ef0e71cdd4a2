"""Entities and links of pages against the standard library."""

import html
from html.entities import html5
from urllib.parse import unquote

from pyspark.sql import functions as F

from touchline.sources import pages


def test_entities(spark):
    texts = ["", "plain", "a &amp; b &lt;p&gt; &quot;x&quot; &#39;y&#39; &nbsp;z", "&eacute;&Eacute;&ntilde; &copy 2026 &reg; &hellip;",
             "&#233;&#xE9;&#x1F600; &#8364 &#128; &#x99;", "&amp;lt; &unknown; & alone &; &#; &#xZZ;", "&#0; &#xD800; &#1114112;", "tail &amp"]
    texts += ["".join(f"<&{n}>" for n in list(html5)[k::97] if n.endswith(";")) for k in range(97)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", pages.unescape(F.col("t")).alias("u")).collect():
        assert r.u == html.unescape(r.t), r.t


def test_links_are_decoded(spark):
    urls = ["/player/7/jos%C3%A9-mar%C3%ADa/", "/player/8/a+b/", "/player/9/plain/", "/player/10/%E6%97%A5%E6%9C%AC/"]
    body = "".join(f"<a href='{u}'>x</a>" for u in [*urls, urls[0], "/player/11/x%22y/"])
    rows = pages.page_candidates(spark.createDataFrame([(1, body)], "page_id int, html string"), r"/player/\\d+/[A-Za-z0-9%+-]+/".replace("\\\\", "\\"), "page_id", "html").collect()
    assert [r.url for r in rows] == [*[unquote(u) for u in urls], "/player/11/x"]
    assert rows[0].slug_name == "José María"
