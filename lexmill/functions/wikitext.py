"""Wiki markup to plain text.

Nested constructs (templates, tables, links) need a scanner, which runs in Python on whole columns; the
passes after it are regular expressions in the JVM.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import bounded, mapped
from .text import column, strip

#: Tags whose content goes, the kinds of links that go whole, and the patterns of the passes after the scanner.
DROPPED_TAGS = ("ref", "references", "table", "gallery")
DROPPED_LINKS = ("file", "image", "category")
NAMESPACED = r"(?iu)\[\[(File|Image|Category):[^\]]+\]\]"
LABELLED = r"\[\[([^\]|]+\|)?([^\]]+)\]\]"
QUOTES, HEADERS, LINES, SPACES = "'{2,}", "(?d)={2,}.*?={2,}", r"\n{3,}", " {2,}"
#: Tags whose content is no markup, and those of them that show nothing.
RAW_TAGS = ("ce", "chem", "hiero", "math", "nowiki", "pre", "score", "source", "syntaxhighlight", "templatedata", "timeline", "gallery", "graph", "imagemap", "inputbox", "categorytree", "section")
UNSEEN_TAGS = ("math", "score", "templatedata", "timeline", "gallery", "graph", "imagemap", "inputbox", "categorytree", "section")
MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW_TAGS)})\b(?:[^<>]*?/>|[^<>]*>(?P<inner>.*?)</(?P=raw)\s*>)"
    rf"|<(?P<end>/?)(?P<tag>{'|'.join(DROPPED_TAGS)})\b[^<>]*?(?P<whole>/?)>|(?P<braces>\{{\{{+|\}}\}}+)|\{{\||\|\}}(?!\}})|\[\[|\]\]",
    re.S | re.I,
)
PARTNER = {"|}": "{|", "]]": "[["}
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]")
HEADING = re.compile(r"^(={1,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", re.M)


class Frame:
    """A construct that is open: its mark as written, what it is (a mark, a tag's name, or { for braces), how many braces, what has been kept within."""

    def __init__(self, mark: str = "", kind: str = "", braces: int = 0):
        self.mark, self.kind, self.braces, self.kept = mark, kind, braces, []

    def text(self) -> str:
        return "".join(self.kept)

    def undone(self) -> str:
        """What was never closed is ordinary text."""
        return ("{" * self.braces if self.kind == "{" else self.mark) + self.text()


def closed_braces(frames: list[Frame], n: int) -> None:
    """n closing braces: three close an argument, of which the default stays, two a template, of which nothing does; what is too many is text."""
    while n >= 2 and frames[-1].kind == "{":
        own = frames[-1]
        k = 3 if min(own.braces, n) >= 3 else 2
        shown = own.text().partition("|")[2] if k == 3 else ""
        own.braces, own.kept, n = own.braces - k, [shown], n - k
        if own.braces < 2:
            frames.pop()
            frames[-1].kept.append("{" * own.braces + shown)
    frames[-1].kept.append("}" * n)


def closed_tag(frames: list[Frame], tag: str) -> None:
    """The innermost open element of a name goes with all that it holds, open marks too; a stray end tag is nothing."""
    for k in range(len(frames) - 1, 0, -1):
        if frames[k].kind == tag:
            del frames[k:]
            return


def plain(markup: str) -> str:
    """Without comments, templates, tables, references and galleries; arguments as their defaults, links as their labels, headings as their text.

    A pushdown parser over all marks at once: elements of one name nest, what stands in nowiki or pre is
    text as it is, an element that is never closed is text without its tag.
    """
    aside = "\ufdd0"
    while aside in markup:
        aside += "\ufdd0"
    raw: list[str] = []
    frames = [Frame()]
    at = 0
    for m in MARK.finditer(markup):
        frames[-1].kept.append(markup[at : m.start()])
        at = m.end()
        mark = m[0]
        if mark.startswith("<!--"):
            continue
        if m["raw"]:
            if m["raw"].lower() not in UNSEEN_TAGS and m["inner"]:
                frames[-1].kept.append(f"{aside}{len(raw)}{aside}")
                raw.append(m["inner"])
        elif m["tag"]:
            if m["end"]:
                closed_tag(frames, m["tag"].lower())
            elif not m["whole"]:
                frames.append(Frame(mark, m["tag"].lower()))
        elif m["braces"]:
            if mark[0] == "{":
                frames.append(Frame(mark, "{", len(mark)))
            else:
                lift(frames, "{")
                closed_braces(frames, len(mark))
        elif mark in PARTNER:
            lift(frames, PARTNER[mark])
            if frames[-1].kind != PARTNER[mark]:
                frames[-1].kept.append(mark)
                continue
            own = frames.pop()
            if mark == "]]":
                frames[-1].kept.append(link(own.text()))
        else:
            frames.append(Frame(mark, mark))
    frames[-1].kept.append(markup[at:])
    while len(frames) > 1:
        own = frames.pop()
        frames[-1].kept.append(own.undone())
    out = HEADING.sub(r"\2", EXTERNAL.sub(lambda m: m[1] or "", frames[0].text()))
    out = html.unescape(TAG.sub("", out))
    return re.sub(f"{aside}([0-9]+){aside}", lambda m: raw[int(m[1])], out) if raw else out


def lift(frames: list[Frame], kind: str) -> None:
    """Elements that are open above the innermost mark of a kind aren't closed before it: their text joins it."""
    k = len(frames) - 1
    while k and frames[k].kind in DROPPED_TAGS:
        k -= 1
    if k and frames[k].kind == kind:
        while len(frames) > k + 1:
            own = frames.pop()
            frames[-1].kept.append(own.undone())


def link(inner: str) -> str:
    target, bar, label = inner.partition("|")
    if target.strip().lower().split(":")[0] in DROPPED_LINKS and ":" in target:
        return ""
    return label if bar else target


def plain_column(c: Column | str, once: bool = False) -> Column:
    """plain over a column; markup that can't be read gives null. once: as functions.text.preprocess has it."""
    bounded()

    def one(x):
        try:
            return plain(x)
        except (ValueError, RecursionError):
            return None

    @F.arrow_udf("string")
    def run(part):
        return mapped(part, one)

    return (run.asNondeterministic() if once else run)(column(c))


def remove_namespaced(c: Column | str) -> Column:
    """Without links to files, images and categories."""
    return F.regexp_replace(column(c), NAMESPACED, "")


def link_labels(c: Column | str) -> Column:
    """[[target|label]] as label, [[target]] as target."""
    return F.regexp_replace(column(c), LABELLED, "$2")


def remove_quotes(c: Column | str) -> Column:
    return F.regexp_replace(column(c), QUOTES, "")


def remove_headers(c: Column | str) -> Column:
    return F.regexp_replace(column(c), HEADERS, "")


def cap_runs(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(column(c), LINES, "\n\n"), SPACES, " ")


def markup_passes(c: Column | str) -> Column:
    """All passes after the scanner, then stripped."""
    return strip(cap_runs(remove_headers(remove_quotes(link_labels(remove_namespaced(c))))))


def clean(c: Column | str, once: bool = False) -> Column:
    return markup_passes(plain_column(c, once))
