"""Markup that nests, breaks off or is none."""

import time

import pytest

from lexmill.functions.wikitext import plain


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("{{{1|x}}} y", "x y"),
        ("{{{1}}}y{{{2|}}}z{{{3|{{t}}[[a|b]]}}}", "yzb"),
        ("{{a|{{{1|d}}}}}x{{{{{1}}}}}y{{{{a}}}}z", "xy{}z"),
        ("{{{{{1|t}}}|q}} {{{ {{a}} }}} {{{{1}}}}", "  {}"),
        ("x<table>..<table>a</table>..b</table>y", "xy"),
        ("<ref>one <ref name=a>two</ref> three</ref>z<ref/>q", "zq"),
        ("<ref>one {{cite</ref> kept}} [[a", " kept}} [[a"),
        ("<nowiki>[[a|b]] {{t}} <b></nowiki> <pre>== x == &amp;</pre>", "[[a|b]] {{t}} <b> == x == &amp;"),
        ("<nowiki/>a<NoWiki >{{</nowiki >b<math>\\frac{{a}}{b}</math>c<source lang=x>{|</source>", "a{{bc{|"),
        ("<ref>never closed, <b>kept</b>", "never closed, kept"),
        ("{{a <ref> b}} c</ref> d", " c d"),
        ("[[a|<ref>x ]] y</ref> z", "x  y z"),
        ("</ref>stray</table> end", "stray end"),
        ("{| a {| b |} c |} d {{e|}} f |} g", " d  f |} g"),
        ("[[File:a.jpg|thumb|see [[b|c]] and {{d}}]]e [[f]] [http://g.h i] <!-- {{ --> ==j==", "e f i  ==j=="),
        ("== A ==\ntext\n=== B ===", "A\ntext\nB"),
        ("﷐<nowiki>a</nowiki>﷐0﷐", "﷐a﷐0﷐"),
        ("&lt;ref&gt;a&amp;lt;", "<ref>a&lt;"),
        ("<gallery>\na.jpg|[[b\n</gallery><references>x</references>", ""),
        ("{{" * 5 + "a" + "}}" * 7, "{}}}}}"),
        ("", ""),
    ],
)
def test_marks(markup, want):
    assert plain(markup) == want


def test_linear_and_deep():
    for n in (20_000, 80_000):
        start = time.perf_counter()
        assert plain("{{a|" * n + "x" + "}}" * n) == "" and plain("<ref>" * n + "x" + "</ref>" * n + "y") == "y"
        assert plain("[[a|" * n + "x" + "]]" * n) == "x" and plain("{{{1|" * n + "x" + "}}}" * n) == "x"
    assert time.perf_counter() - start < 20
