"""Cleaning of text columns: Column in, Column out, null stays null.

Patterns are written for Java's regular expressions; WS is what Python's str.strip and re call white
space, which Java's \\s and Spark's trim don't cover.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import bounded, mapped

#: Character classes and patterns that define the cleaning steps.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
URL = rf"https?://[^{WS}]+"
#: What [^WS]+@[^WS]+\.[^WS]+ finds: always a run from its start to its end. Tried there alone, at its first @, a long run takes linear time.
EMAIL = rf"(?<![^{WS}])[^{WS}][^{WS}@]*+@[^{WS}]+\.[^{WS}]+"
CITATION = r"(?iu)\[(\p{Nd}+|citation needed)\]"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(column(c), rf"\A[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def remove_control(c: Column | str) -> Column:
    """Without control characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(column(c), CONTROL, "")


def normalize_lines(c: Column | str) -> Column:
    """Runs of spaces and tabs as one space, each line (cut at line feeds alone) stripped."""
    return F.array_join(F.transform(F.split(column(c), "\n", -1), lambda line: strip(F.regexp_replace(line, r"[ \t]+", " "))), "\n")


def cap_newlines(c: Column | str, most: int = 2) -> Column:
    """Runs of more than most line feeds as most of them."""
    return F.regexp_replace(column(c), rf"\n{{{most + 1},}}", "\n" * most)


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(column(c), URL, "")


def strip_emails(c: Column | str) -> Column:
    return F.regexp_replace(column(c), EMAIL, "")


def strip_citations(c: Column | str) -> Column:
    return F.regexp_replace(column(c), CITATION, "")


def _rewritten(c: Column | str, odd: Callable[[Column], Column], f: Callable[[str], str], once: bool = False) -> Column:
    """c with f applied to the texts that are odd: only these leave the JVM, in batches of bounded bytes.

    c stands once outside of what goes to the workers, so that what it is made by isn't evaluated again for each branch. once: the optimizer
    takes the function as one that may differ by call, and neither moves it into filters nor runs it twice.
    """
    bounded()

    @F.arrow_udf("string")
    def run(part):
        return mapped(part, f)

    c = column(c)
    return F.coalesce((run.asNondeterministic() if once else run)(F.when(odd(c), c)), c)


def _referring(c: Column) -> Column:
    return F.contains(c, F.lit("&"))


def _not_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def unescape(c: Column | str) -> Column:
    """HTML character references decoded once; only texts with an ampersand leave the JVM."""
    return _rewritten(c, _referring, html.unescape)


def normalize_unicode(c: Column | str, form: str = "NFC") -> Column:
    """Unicode normal form; texts of ASCII alone, which have one form, stay in the JVM."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    return _rewritten(c, _not_ascii, lambda x: unicodedata.normalize(form, x))


def unescape_normalized(c: Column | str, form: str = "NFC", once: bool = False) -> Column:
    """Character references decoded, then the normal form, in one worker; texts of ASCII without an ampersand stay in the JVM."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    return _rewritten(c, lambda x: _referring(x) | _not_ascii(x), lambda x: unicodedata.normalize(form, html.unescape(x)), once)


def normalize_text(c: Column | str, form: str = "NFC", stripped: bool = True) -> Column:
    out = normalize_unicode(c, form)
    return strip(out) if stripped else out


def preprocess(c: Column | str, unicode_form: str | None = "NFC", control: bool = True, whitespace: bool = True, most_newlines: int = 2, once: bool = False) -> Column:
    """Character references, Unicode form (None: left as it is), control characters, white space, in this order; empty stays empty.

    once: for a column that filters follow; it is then evaluated a single time, before these.
    """
    out = _rewritten(c, _referring, html.unescape, once) if unicode_form is None else unescape_normalized(c, unicode_form, once)
    if control:
        out = remove_control(out)
    if whitespace:
        out = cap_newlines(normalize_lines(out), most_newlines)
    return strip(out)


def preprocess_wiki(c: Column | str, **options) -> Column:
    """Without URLs, e-mail addresses and citation marks, then as preprocess; these go before references are decoded."""
    return preprocess(strip_citations(strip_emails(strip_urls(c))), **options)
