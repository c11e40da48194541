"""Page extraction against rows worked out by hand."""

from gleanery.sources import html as H

URL = "https://a.example.com/x/y.html"


def rows(extractor, text, **k):
    return list(extractor(H.parse(text), URL, **k))


def test_paragraphs_emit_nested_and_drop_noise():
    p49, p50 = "a" * 49, "b" * 50
    page = f"<nav><p>{'n' * 60}</p></nav><article><p>{p49}</p><p>{p50}</p></article><footer><p>{'f' * 60}</p></footer>"
    assert rows(H.paragraphs, page) == [(f"{p49} {p50}",), (p50,)]


def test_paragraph_ends_where_the_next_begins():
    assert rows(H.paragraphs, f"<p>{'a' * 50}<p>{'b' * 50}") == [("a" * 50,), ("b" * 50,)]


def test_images():
    page = (
        '<img src="/i.png" alt="abcdef"><img src="j.png" alt="abcde"><img src="data:x" alt="long enough">'
        f"<figure><b>one</b> <i>two</i><img src='k.png'></figure><div>{'z' * 300}<img src='https://b.example.com/l.png'></div>"
    )
    assert rows(H.images, page) == [("https://a.example.com/i.png", "abcdef"), ("https://a.example.com/x/k.png", "onetwo"), ("https://b.example.com/l.png", "z" * 200)]


def test_audio():
    page = '<div>talk <audio src="a.mp3"></audio><audio><source src="b.wav"></audio></div><a href="c.mp3?y=1">x</a><a href="d.MP3">x</a>'
    assert rows(H.audio, page) == [("https://a.example.com/x/a.mp3", "talk"), ("https://a.example.com/x/b.wav", "talk"), ("https://a.example.com/x/c.mp3?y=1", "")]


def test_header_edges():
    page = f"<h2>A</h2><ul><li>x<ul><li>y</li></ul></li></ul><h3>B</h3><p>no</p><ul><li>z</li></ul><h4>{'h' * 51}</h4><ul><li>q</li></ul>"
    assert rows(H.header_edges, page) == [("A", "xy", "contains/relates_to"), ("A", "y", "contains/relates_to")]


def test_table_rows():
    page = "<table><tr><th>a</th><th></th><th>a</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table>"
    assert rows(H.table_rows, page, first_row_headers=True) == [({"a": "3", "feature_1": "2"},), ({"a": "4"},)]
    assert rows(H.table_rows, page)[1] == ({"a": "4"},)


def test_extract_skips_bad_pages(spark):
    pages = spark.createDataFrame([(URL, "<p>" + "a" * 60), (None, None), ("u", "")], "url string, html string")
    assert [tuple(r) for r in H.extract(pages).collect()] == [(URL, 0, "a" * 60)]
