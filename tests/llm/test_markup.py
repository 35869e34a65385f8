"""Tags and attributes as written in the wild; pages here are not made by the generator that fits the classifier."""

import time

from lodestone.llm import mainhtml

BODY = [f"This is sentence number {k} of the article, and it goes on for a while so that nobody takes it for a label." for k in range(6)]


def page(inner):
    paragraphs = "".join(f"<p>{x}</p>" for x in BODY)
    return f"<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article><h1>A heading</h1>{paragraphs}{inner}</article><footer>Imprint</footer></body></html>"


def last(inner, n=1):
    return mainhtml.main_text(page(inner)).split("\n\n")[-n:]


def test_quotes_in_values_without_quotes():
    assert last("<p>See <a href=/o'neil>the O page</a> for the full story.</p><p>It's a fine day to read about all of it.</p>", 2) == [
        "See the O page for the full story.", "It's a fine day to read about all of it.",
    ]
    assert last("<p><img alt=it's src=x.png>Text that we don't want to lose, as it's text.</p>") == ["Text that we don't want to lose, as it's text."]
    assert last('<p><img alt=6" src=x.png>A screen of 6" is what the text is about.</p>') == ['A screen of 6" is what the text is about.']


def test_ends_of_tags_in_quoted_values():
    assert last("<p data-x='a > b' title=\"it's > that\" class=lead>A plain paragraph with odd attributes.</p>") == ["A plain paragraph with odd attributes."]
    assert last("<p title = 'x'y=\"z\" / data-k>Attributes without space between them.</p>") == ["Attributes without space between them."]


def test_a_quote_that_nothing_closes_ends_with_its_tag():
    assert mainhtml.main_text('<article><h1>A heading</h1><p title="abc>Text of the last paragraph, which is whole.') == "A heading\n\nText of the last paragraph, which is whole."


def test_attributes_are_told_by_name():
    said = lambda attributes: mainhtml._says("div", attributes, False)
    assert said(" class=ad") == said(' CLASS="ad"') == said(" x='class=y' id = ad") == {"mark"}
    assert said(" data-class=ad title='class=\"ad\"' alt=id=ad") == frozenset()
    assert said(" hidden") == said(" aria-hidden=TRUE") == {"hidden"} and said(" data-hidden aria-hidden=false") == frozenset()


def test_stray_ends_change_nothing():
    assert mainhtml.main_text(page("</b></span></section></td></p>")) == mainhtml.main_text(page(""))


def test_deep_nesting_is_linear():
    def seconds(n):
        began = time.perf_counter()
        assert mainhtml.main_text("<div>" * n + "the text of it all." + "</span></div>" * n) == "the text of it all."
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.05)
    many = "<article>" + "<div>" * 3000 + "".join(f"<p>{x}</p>{'</div>' * 300}{'<div>' * 300}" for x in BODY) + "</article>"
    assert mainhtml.main_text(many) == "\n\n".join(BODY)
    assert mainhtml.main_text("<a x='" * 30_000) == "" and mainhtml.main_text("<p " + "a='b" * 30_000) == ""


def test_ties_go_to_boilerplate():
    """A block of score 0 hangs on neither side, and of two least cuts the one with less content is taken."""
    assert mainhtml.minimum_cut([0.0], []) == [False]
    assert mainhtml.minimum_cut([1.0, -1.0], [(0, 1, 1.0)]) == [False, False]
    assert mainhtml.minimum_cut([2.0, 0.0, -2.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, False, False]
