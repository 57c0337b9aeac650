"""References in pages."""

from corpusaudit.sources import html as H


def test_a_reference_that_a_cut_left_open_stays_as_it_is():
    page = "<body><h1>a &amp;&lt; b&amp</h1><p>q &AMP x &am &#38 &#38; &copy; &nosuch; <a href='?x=1&copy=2'>l&amplt;</a></p></body>"
    label = lambda closed: next(r[22] for r in H.read_page(1, page, closed) if r[8] == "Header")
    assert (label(False), label(True)) == ("a &< b&", "a &< b&amp")
    assert [t for _, _, t in H.read_segments(1, page, True)] == ["a &< b&amp", "q &AMP x &am &#38 & © &nosuch; l&amplt;"]
    assert next(r[14] for r in H.read_page(1, page, True) if r[8] == "Link") == "?x=1&copy=2"
