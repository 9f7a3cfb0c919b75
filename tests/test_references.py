"""Links resolved to files."""

from weftline.operators import references


def test_links_of_pages_sites_and_styles(spark):
    files = [
        ("/p/docs/a.md", "[x](b) [y](sub/) [z](sub/c.md#part) [q](b.md?x) [n](gone) [s](a.md) [up](../../../../p/docs/b.md) [h](https://b.md) [abs](/p/docs/b.md) [v](v1.2) ![i](pic)"),
        ("/p/docs/b.md", ""), ("/p/docs/b.rst", ""), ("/p/docs/sub/README.md", "[only](../only)"), ("/p/docs/sub/c.md", ""), ("/p/docs/only.rst", ""), ("/p/docs/v1.2", ""), ("/p/docs/pic", ""),
        ("/p/site/i.html", '<a href="/x.html">1</a><a href="x.html?a#b">2</a><img src="/r/y.png"><link href="/s.css" rel="s"><a href="#top">t</a><a href="//x.html">e</a><a href="i.html">self</a>'),
        ("/p/site/x.html", None), ("/p/two/x.html", ""), ("/p/two/r/y.png", ""), ("/p/two/s.css", "@import 'base.css';@import url(\"../site/m.css?1\"); @import url(https://n.css);"), ("/p/two/base.css", ""), ("/p/site/m.css", "@import '/p/two/base.css';"),
    ]
    df = spark.createDataFrame(files, "path string, content string").repartition(4)
    got = {(r.src, r.dst, r.ch) for r in references.edges(df, roots=["/p/site", "/p/two"]).collect()}
    assert got == {
        ("/p/docs/a.md", "/p/docs/b.md", "d"), ("/p/docs/a.md", "/p/docs/sub/README.md", "d"), ("/p/docs/a.md", "/p/docs/sub/c.md", "d"), ("/p/docs/a.md", "/p/docs/v1.2", "d"), ("/p/docs/sub/README.md", "/p/docs/only.rst", "d"),
        ("/p/site/i.html", "/p/site/x.html", "d"), ("/p/site/i.html", "/p/two/r/y.png", "d"), ("/p/site/i.html", "/p/two/s.css", "d"), ("/p/two/s.css", "/p/two/base.css", "<"), ("/p/two/s.css", "/p/site/m.css", "<"),
    }
    assert references.edges(df.limit(0)).count() == 0
