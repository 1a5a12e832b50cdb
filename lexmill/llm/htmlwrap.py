"""Main text of pages, by wrappers inferred from each host's pages.

A wrapper is a regular expression without unions over a host's pages: elements, text slots (#),
optional parts and repeated groups. It is inferred by aligning one page after the other: neighbours
that repeat fold into a repeated group, what only some pages have becomes optional, text becomes a
slot. Alignment merges, so partitions build wrappers of their own pages, which then merge by host, a
few at a time; no task sees all pages of a host.

Then each page is aligned with its host's wrapper, which gives every block of text a slot, and over all
pages it is summed up how much text each slot has, how much of it in links, and whether it ever changes.
From these sums one element of the wrapper is chosen for each host: from the root down, past elements
that are links for the most part or always the same, the element that holds most of what is left and
more than a line (see decide). Tags and names like nav or sidebar count as much as being links, but never
against an element that has most of the text; without any of them the sums alone decide. Elements named as
comments are never chosen while there is a paragraph beside them, however long they are. Within the article links stay, unless
they are the same on all pages. A page that lacks the chosen element is decided by its own sums.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from difflib import SequenceMatcher
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, temporary, written
from .tokens import slices
from .urlfilter import host as host_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none")
#: Elements of HTML by what they do to the flow of text, and names that say what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div body".split())
MUTE = frozenset("select svg object canvas audio video button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = HEADINGS | frozenset("p blockquote pre dd td th li figcaption".split())
TOPS = frozenset(["", "html", "body"])
GENERAL = frozenset("div section center".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre article".split())
LISTS = frozenset("ul ol dl table nav menu".split())
LEFT_OUT_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies dialog footer form header login masthead menu modal nav navbar navigation newsletter notice notices alert overlay pager pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments disqus discussion replies reply respond".split())
NEGATIONS = frozenset("no not non has have with without is hide enable disable".split())
CONTAINERS = frozenset("area bar block bottom box container content group inner item items left list outer panel posts right section text top unit widget wrap wrapper".split())


#: Text beside comments that may be an article is this share of all text at least.
RICH = 0.005
#: Children of an element that are aligned in their order, at most (see infer).
WIDE = 64


def deep() -> None:
    """Pages may nest as deep as they like: functions here that call themselves need frames, which Python keeps on its heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def names_of(own: dict[str, str]) -> list[str]:
    """An element's names without numbers; names that hold one within are made by machines and don't count."""
    found = (x.rstrip("0123456789").rstrip("-_") for c in ("class", "id", "role") for x in own.get(c, "").split())
    return [x for x in found if x and not any(c.isdigit() for c in x)]


def means(name: str) -> str:
    """The part of a name like cookie-notice or comments-list that says what it is for; nothing for names like no-comments."""
    parts = [x for x in re.split("[-_]+", name) if x]
    if not parts or parts[0] in NEGATIONS:
        return ""
    last = len(parts) - 1
    while last and parts[last] in CONTAINERS:
        last -= 1
    return parts[last]


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def label(tag: str, names: list[str]) -> str:
    return ".".join([tag, *dict.fromkeys(x.replace(".", "-").replace("~", "-") for x in names)])


def parts(name: str) -> list[str]:
    """The tag and the names of a label."""
    return name.partition("~")[0].split(".")


def tag_of(node: list) -> str:
    return parts(node[0])[0]


def kind(node: list) -> str:
    """What an element of a general tag holds: paragraphs, lists, other elements or only text. Neighbours of one tag are alike only if this is."""
    tags = {tag_of(k) for k in node[1]}
    return "p" if tags & PARAGRAPHS else "l" if tags & LISTS else "d" if tags - {"#"} else "t"


def parse(page: str | None) -> list:
    """The tree of a page's block elements: [label, children]; a block's text is ["#", text, characters of it in links]. Unclosed and stray tags are taken as browsers do.

    What isn't shown has no part in it: scripts, styles, titles, comments, controls, graphics and hidden elements.
    """
    root: list = ["", []]
    # Tag, node (None for inline elements that aren't shown), whether what is within isn't shown.
    stack: list[tuple] = [("", root, False)]
    text: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                node = next(n for _, n, _ in reversed(stack) if n is not None)
                node[1].append(["#", block, min(linked, len(block))])
        linked = 0

    def close(k: int):
        if any(n is not None for _, n, _ in stack[k:]):
            flush()
        for tag, node, _ in stack[k:]:
            if tag in GENERAL:
                node[0] += f"~{kind(node)}"
        del stack[k:]

    for m in TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if stack[-1][2]:
                continue
            if piece[0] != "<" or piece == "<":
                piece = entities.unescape(piece)
                text.append(piece)
                if links:
                    linked += len(" ".join(piece.split()))
            elif m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in VOID:
            if not stack[-1][2]:
                text.append(" ")
                if tag == "hr":
                    flush()
            continue
        own = attributes(m[4])
        mute = stack[-1][2] or tag in MUTE or "hidden" in own or bool(UNSEEN.search(own.get("style", "")))
        if tag not in BLOCKS:
            # Inline elements are text, but for those that aren't shown.
            if tag == "a":
                links = 1
            if mute and not m[4].endswith("/"):
                text.append(" ")
                stack.append((tag, None, True))
            continue
        links = 0
        ends = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p" or stack[k][0] in ends:
                close(k)
            elif stack[k][0] in SCOPES:
                break
        mute = mute or stack[-1][2]
        flush()
        node: list = [label(tag, names_of(own)), []]
        if not mute:
            next(n for _, n, _ in reversed(stack) if n is not None)[1].append(node)
        stack.append((tag, node, mute))
    close(1)
    flush()
    return root


# Wrappers: [label, children, least, many]; least 0: optional, many: repeated. A repeated group of several elements has the label "()".


def wrapper(tree: list, wide: int = WIDE) -> list:
    """The wrapper of one page."""
    if tree[0] == "#":
        return ["#", [], 1, False]
    return [tree[0], fold([wrapper(k, wide) for k in tree[1]], wide), 1, False]


def both(a: list, b: list, wide: int = WIDE) -> list:
    """The wrapper of what either wrapper of one label matches."""
    return [a[0], align(a[1], b[1], wide), min(a[2], b[2]), a[3] or b[3]]


def narrow(kids: list, wide: int = WIDE) -> list:
    """Children that are more than wide, such as an article's of every kind in any order, as one repeated part for each label: their order says nothing, and comparing it takes its square in time."""
    if len(kids) <= wide:
        return kids
    out: dict = {}
    todo = kids[::-1]
    while todo:
        k = todo.pop()
        if k[0] == "()":
            todo += k[1][::-1]
        else:
            out[k[0]] = [*both(out[k[0]], k, wide)[:2], 0, True] if k[0] in out else [*k[:2], 0, True]
    return list(out.values())


def fold(kids: list, wide: int = WIDE) -> list:
    """Neighbours of one label become a repeated part, then runs of a few that recur a repeated group."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = [*both(out[-1], k, wide)[:3], True]
        else:
            out.append(k)
    for n in (2, 3, 4):
        i, folded = 0, []
        while i < len(out):
            names = [k[0] for k in out[i : i + n]]
            times = 1
            while len(names) == n and [k[0] for k in out[i + times * n : i + (times + 1) * n]] == names:
                times += 1
            if times > 1 and "()" not in names:
                group = out[i : i + n]
                for t in range(1, times):
                    group = [both(a, b, wide) for a, b in zip(group, out[i + t * n : i + (t + 1) * n])]
                folded.append(["()", group, 1, True])
                i += times * n
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return narrow(out, wide)


def grouped(kids: list, groups: list[list]) -> list:
    """kids with each run that has the labels of a group as one group."""
    for group in groups:
        names = [k[0] for k in group[1]]
        i, out = 0, []
        while i < len(kids):
            if [k[0] for k in kids[i : i + len(names)]] == names:
                out.append(["()", kids[i : i + len(names)], 1, True])
                i += len(names)
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def key(node: list) -> str:
    return node[0] if node[0] != "()" else "(" + " ".join(k[0] for k in node[1]) + ")"


def align(a: list, b: list, wide: int = WIDE) -> list:
    """Match two sequences of children; what only one of them has becomes optional."""
    if (groups := [k for k in a if k[0] == "()"]) and any(k[0] != "()" for k in b):
        b = grouped(b, groups)
    if (groups := [k for k in b if k[0] == "()"]) and any(k[0] != "()" for k in a):
        a = grouped(a, groups)
    x, y = [key(k) for k in a], [key(k) for k in b]
    if x == y:
        return [both(p, q, wide) for p, q in zip(a, b)]
    out: list = []
    for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [both(p, q, wide) for p, q in zip(a[i:j], b[k:m])]
        else:
            out += [[p[0], p[1], 0, p[3]] for p in (*a[i:j], *b[k:m])]
    merged: list = []
    for node in out:  # the optional leftovers of both may stand side by side
        if merged and key(merged[-1]) == key(node):
            merged[-1] = [*both(merged[-1], node, wide)[:2], max(merged[-1][2], node[2]), True]
        else:
            merged.append(node)
    return narrow(merged, wide)


def expression(node: list) -> str:
    """A wrapper as a regular expression over tags and text slots."""
    inner = "".join(expression(k) for k in node[1])
    body = "#" if node[0] == "#" else inner if node[0] in ("", "()") else f"<{'.'.join(parts(node[0]))}>{inner}</{tag_of(node)}>"
    mark = {(1, False): "", (0, False): "?", (1, True): "+", (0, True): "*"}[node[2], node[3]]
    return f"({body}){mark}" if mark else body


def dumped(whole: list) -> str:
    """A wrapper as JSON: its nodes with their depths, parents first."""
    out, todo = [], [(0, whole)]
    while todo:
        depth, node = todo.pop()
        out.append([depth, node[0], node[2], int(node[3])])
        todo += [(depth + 1, k) for k in reversed(node[1])]
    return json.dumps(out, separators=(",", ":"))


def loaded(text: str) -> list:
    """The wrapper that was dumped; each node has its number, in the order of the dump, as fifth."""
    path: list = []
    for number, (depth, name, least, many) in enumerate(json.loads(text)):
        node = [name, [], least, bool(many), number]
        del path[depth:]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def places(kids: list, known: list, wide: int = WIDE) -> list:
    """The node among the wrapper's children known for each of a page's children: runs of one label, then groups, then alignment as in align().

    What doesn't align takes the first node of its label; None where the wrapper has no such label.
    """
    runs: list = []
    for i, k in enumerate(kids):
        if runs and runs[-1][0] == k[0]:
            runs[-1][1].append(i)
        else:
            runs.append([k[0], [i]])
    if groups := [k for k in known if k[0] == "()"]:
        runs = grouped(runs, groups)
    items: list = []
    for run in runs:
        if items and items[-1][0] == key(run):
            items[-1][1].append(run)
        else:
            items.append((key(run), [run]))
    x, y = [k for k, _ in items], [key(k) for k in known]
    if x == y:
        to = dict(enumerate(range(len(y))))
    elif len(x) > wide:
        to = {}
    else:
        to = {m.a + n: m.b + n for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for n in range(m.size)}
    first: dict = {}
    if len(to) < len(x):
        for node in known:
            for own in node[1] if node[0] == "()" else [node]:
                first.setdefault(own[0], own)
    out: list = [None] * len(kids)
    for i, (_, same) in enumerate(items):
        j = to.get(i)
        for run in same:
            for r, (name, members) in enumerate(part[:2] for part in (run[1] if run[0] == "()" else [run])):
                at = first.get(name) if j is None else known[j][1][r] if run[0] == "()" else known[j]
                for k in members:
                    out[k] = at
    return out


def slots(tree: list, whole: list, chosen: dict | None = None, wide: int = WIDE):
    """(slot, text, characters in links) of the blocks of a page in page order; a slot is the number of the wrapper's node.

    Blocks that the wrapper doesn't have get the slot of the last element above them that it has. With chosen (see
    decide) only blocks in the elements taken, without those left out.
    """
    taken, out = (set(chosen["take"]), set(chosen["out"])) if chosen else (frozenset(), frozenset())
    todo: list = [(tree, whole, whole[4], not chosen or whole[4] in taken)]
    while todo:
        node, known, slot, inside = todo.pop()
        if node[0] == "#":
            if inside:
                yield slot, node[1], node[2]
            continue
        for k, at in zip(reversed(node[1]), reversed(places(node[1], known[1] if known else [], wide))):
            if at is None:
                todo.append((k, None, slot, inside))
            elif at[4] not in out:
                todo.append((k, at, at[4], inside or at[4] in taken))


def comment_regions(whole: list, sums: dict[int, tuple[int, int]]) -> frozenset[int]:
    """Numbers of the elements that are named as comments, if there is other text that may be an article: a paragraph, or RICH of all text at least.

    Text in headings, and in elements whose tag or name says that they are something else, is none. What holds the
    page's own heading or main element isn't a region of comments.
    """
    found: list[int] = []
    plain = {s: total - linked for s, (total, linked) in sums.items()}
    rest, prose = 0, False
    todo = [(whole, False, False)]
    while todo:
        node, spent, within = todo.pop()
        tag, *names = parts(node[0])
        said = {means(x) for x in names} if tag not in TOPS else set()
        if said & COMMENT_NAMES and tag != "main" and not holds(node, ("h1", "main")):
            found.append(node[4])
            continue
        spent = spent or tag in LEFT_OUT_TAGS or tag in HEADINGS or bool(said & LEFT_OUT_NAMES)
        within = within or tag in PROSE
        if not spent and plain.get(node[4], 0):
            rest, prose = rest + plain[node[4]], prose or within
        todo += [(k, spent, within) for k in node[1]]
    return frozenset(found) if prose or rest and rest >= RICH * sum(plain.values()) else frozenset()


def holds(node: list, tags: tuple[str, ...]) -> bool:
    todo = list(node[1])
    while todo:
        k = todo.pop()
        if tag_of(k) in tags:
            return True
        todo += k[1]
    return False


def decide(whole: list, sums: dict[int, tuple[int, int]], fixed: frozenset[int] = frozenset()) -> dict[str, list[int]]:
    """Numbers of the wrapper's nodes whose text is the article (take), and of those left out within them (out).

    sums: by slot the characters of its texts and those of them in links; fixed: slots whose text never changes.
    """
    deep()
    size: dict[int, list[int]] = {}  # characters outside links, all characters, characters outside links that change, all that change
    comments = comment_regions(whole, sums)

    def add(node):
        total, linked = sums.get(node[4], (0, 0)) if node[4] not in comments else (0, 0)
        changing = 0 if node[4] in fixed else total
        own = [total - linked, total, changing and total - linked, changing]
        for k in node[1]:
            add(k)
            own = [a + b for a, b in zip(own, size[k[4]])]
        size[node[4]] = own if node[4] not in comments else [0] * 4

    add(whole)

    def kids(node):
        for k in node[1]:
            if k[0] == "()":
                yield from kids(k)
            elif size[k[4]][1]:
                yield k

    def junk(node, frame, top, inside):
        """Whether an element isn't the article's; frame: the element within which it is judged, top: which is the page; inside: which is the article.

        Links within the article are its own unless they are the same on all pages.
        """
        plain, total, _, changing = size[node[4]]
        share = plain / max(1, size[frame[4]][0])
        tag, *names = parts(node[0])
        if tag in LEFT_OUT_TAGS and (top or tag != "header") and share < 0.8:
            return True
        said = {means(x) for x in names} if tag not in TOPS else set()
        if said & COMMENT_NAMES and share < 0.9 or said & LEFT_OUT_NAMES and (top or "header" not in said) and share < 0.5:
            return True
        return tag not in PROSE and size[frame[4]][0] > 0 and total - plain >= 0.6 * total and share < 0.5 and not (inside and changing)

    def judged(node, frame, top, inside=False):
        """The parts of node that are junk. Where others change from page to page, those of a page that never do are it too."""
        own = list(kids(node))
        found = [k for k in own if junk(k, frame, top, inside)]
        if top and any(size[k[4]][2] for k in own if k not in found):
            found += [k for k in own if not size[k[4]][2] and k not in found]
        return found

    def elements(node):
        return [k for k in kids(node) if k[0] != "#"]

    at, take, top = whole, [], True
    while True:
        tag = tag_of(at)
        if tag == "article":
            break
        # Below the page only what the page's own frame calls junk shows that an element is a frame as well.
        own = elements(at)
        bad = judged(at, at, top)
        good = [k for k in own if k not in bad]
        rich = [k for k in good if elements(k)]
        marked = [k for k in rich if tag_of(k) in ("article", "main")]
        weight = lambda k: (size[k[4]][2], size[k[4]][0])
        if not rich:
            break
        best = max(rich, key=weight)
        if marked and weight(max(marked, key=weight)) >= tuple(x / 4 for x in weight(best)):
            best = max(marked, key=weight)
        others = [k for k in good if k is not best]
        headings = [k for k in others if tag_of(k) in HEADINGS and not elements(k)]
        lines = [k for k in others if not elements(k) and not k[3] and tag_of(k) not in PROSE]
        rivals = sum(size[k[4]][2] for k in kids(at) if k[0] == "#" or k in others and k not in headings and k not in lines)
        alone = len(good) == 1 and len(own) == 1
        framed = tag in TOPS or len(own) > len(good) or len(lines) + len(headings) == len(others) and not headings
        if not alone and not (framed and size[best[4]][2] > rivals):
            break
        take += [k[4] for k in headings if k[4] < best[4]] if not alone else []
        at, top = best, tag in TOPS and tag_of(best) in TOPS
    out: list[int] = sorted(comments)

    def leave(node):
        bad = judged(node, at, top, not top)
        for k in kids(node):
            if k in bad:
                out.append(k[4])
            else:
                leave(k)

    leave(at)
    return {"take": [*take, at[4]], "out": out}


def main_text(page: str | None, whole: list, fixed: frozenset[int], chosen: dict, wide: int = WIDE) -> str:
    """whole: the wrapper of the page's host; fixed: its slots whose text never changes; chosen: what its sums decide.

    A page in which the chosen elements have no text is decided by its own sums.
    """
    tree = parse(page)
    found = [text for _, text, _ in slots(tree, whole, chosen, wide)]
    if not found and (own := summed(slots(tree, whole, None, wide))):
        found = [text for _, text, _ in slots(tree, whole, decide(whole, own, fixed), wide)]
    return "\n".join(found)


def summed(blocks) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for slot, text, linked in blocks:
        a, b = out.get(slot, (0, 0))
        out[slot] = a + len(text), b + linked
    return out


def _learn(batches, wide):
    """Rows of wrappers (host, wrapper, pages)."""
    import pyarrow as pa

    deep()
    wrappers: dict[str, list] = {}

    def out():
        rows = [(h, dumped(w), n) for h, (w, n) in wrappers.items()]
        wrappers.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["host", "wrapper", "pages"])

    for batch in batches:
        for part in slices(batch, rows=256, text="html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                own = wrapper(parse(page), wide)
                if host in wrappers:
                    known = wrappers[host]
                    known[:] = [both(known[0], own, wide), known[1] + 1]
                else:
                    wrappers[host] = [own, 1]
            if len(wrappers) > 5_000:
                yield out()
    if wrappers:
        yield out()


def _merge(pdf, wide):
    import pandas as pd

    deep()
    rows = sorted(zip(pdf["wrapper"], pdf["pages"]))
    whole, pages = loaded(rows[0][0]), rows[0][1]
    for other, n in rows[1:]:
        whole, pages = both(whole, loaded(other), wide), pages + n
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [dumped(whole)], "pages": [pages]})


#: Wrappers that one task merges.
MERGED = 64
#: Bytes of wrappers that are sent to the workers at once.
BROADCAST_BYTES = 32 << 20


def merged(own: DataFrame, wide: int = WIDE) -> DataFrame:
    """One row a host of own (host, wrapper, pages): a host's different wrappers merge MERGED at a time, round by round."""
    shape = "host string, wrapper string, pages long"
    while True:
        own = written(own.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages")), "wrappers")
        tasks = written(own.groupBy("host").agg(F.ceil(F.count("*") / MERGED).cast("int").alias("tasks"), F.count("*").alias("n")).where("n > 1"), "merges")
        if tasks.isEmpty():
            return own
        dealt = own.join(tasks, "host").withColumn("share", F.pmod(F.xxhash64("wrapper"), F.col("tasks")))
        own = own.join(tasks, "host", "left_anti").unionByName(dealt.select(*own.columns, "share").groupBy("host", "share").applyInPandas(lambda pdf: _merge(pdf, wide), shape))


def with_rules(rows: DataFrame, rules: DataFrame, make):
    """rows, and a function that gives make(of the rules' columns but host) for each row of a batch.

    The rules go to the workers at once while they take BROADCAST_BYTES at most; beyond that rows are joined with them by host.
    """
    names = [c for c in rules.columns if c != "host"]
    size = rules.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast({r[0]: tuple(r)[1:] for r in rules.select("host", *names).collect()})
        rows = rows.withColumns({f"rule_{c}": F.lit(None).cast("string") for c in names})
    else:
        known = rows.sparkSession.sparkContext.broadcast(None)
        rows = rows.join(rules.select(F.col("host").alias("own"), *(F.col(c).alias(f"rule_{c}") for c in names)), F.col("host") == F.col("own"), "left").drop("own")
    cached: dict[str, tuple] = {}

    def get(part):
        for host, *own in zip(*(part.column(c).to_pylist() for c in ("host", *(f"rule_{c}" for c in names)))):
            if host not in cached:
                if len(cached) > 1000:
                    cached.clear()
                cached[host] = make(*(own if known.value is None else known.value[host]))
            yield cached[host]

    return rows, get


def infer(pages: DataFrame, url: str = "url", html: str = "html", wide: int = WIDE) -> DataFrame:
    """host, wrapper (JSON), pages, slots (JSON: number, characters, characters in links, and whether the text is the same on all pages that have it, two different ones at least), one row a host.

    Pages are different if any text in their slots is; copies, also under other URLs or in other frames, count as one page.

    wide: an element of more children, runs and recurring groups counted once, is a repeated part for each label in its
    wrapper, without order or optional parts: aligning takes the square of this number in time. Whatever it is, no text is lost.

    Pages of null url or url without host are the host "". Null and empty html are pages without elements.
    """
    prepare(pages.sparkSession)
    rows = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    wrappers = merged(rows.mapInArrow(partial(_learn, wide=wide), "host string, wrapper string, pages long"), wide)
    rows, rules = with_rules(rows, wrappers.select("host", "wrapper"), loaded)

    def run(batches):
        """Slots of pages (host, slot, characters, in links, least and greatest digest of its text, the same of its pages' whole texts)."""
        import hashlib

        import pyarrow as pa

        found: dict[tuple[str, int], list] = {}

        def digest(blocks):
            return hashlib.md5("\n".join(blocks).encode("utf-8", "replace")).hexdigest()

        def out():
            cells = [(h, p, *v) for (h, p), v in found.items()]
            found.clear()
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*cells), kinds)], names=["host", "slot", "chars", "linked", "low", "high", "first", "last"])

        for batch in batches:
            for part in slices(batch, rows=256, text="html"):
                for host, page, whole in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), rules(part)):
                    blocks = list(slots(parse(page), whole, None, wide))
                    seen: dict[int, list[str]] = {}
                    for slot, text, _ in blocks:
                        seen.setdefault(slot, []).append(text)
                    own = digest([text for texts in seen.values() for text in texts])
                    for slot, (chars, linked) in summed(blocks).items():
                        text = digest(seen[slot])
                        known = found.get((host, slot), (0, 0, text, text, own, own))
                        found[host, slot] = [known[0] + chars, known[1] + linked, min(known[2], text), max(known[3], text), min(known[4], own), max(known[5], own)]
                if len(found) > 20_000:
                    yield out()
        if found:
            yield out()

    sums = rows.mapInArrow(run, "host string, slot int, chars long, linked long, low string, high string, first string, last string")
    sums = sums.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
    # A host has as many slots as its wrapper has nodes, at most.
    row = F.array("slot", "chars", "linked", ((F.col("first") < F.col("last")) & (F.col("low") == F.col("high"))).cast("long"))
    return wrappers.join(sums.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("slots")), "host", "left")


def rule(wrapper: str, slots: str | None) -> tuple[list, frozenset[int], dict]:
    """A host's wrapper, the slots whose text never changes, and what is chosen."""
    whole, own = loaded(wrapper), json.loads(slots or "[]")
    fixed = frozenset(s for s, _, _, same in own if same)
    return whole, fixed, decide(whole, {s: (chars, linked) for s, chars, linked, _ in own}, fixed)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wide: int = WIDE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    text: the article's blocks in page order, one line each; white space inside a block is one space.
    wide: see infer; it tells slots apart and keeps all text.
    Null or empty html and pages without text have the text "". Broken markup is read on, whole texts
    of any length and elements of any depth are kept. Repeated rows are extracted alike; an empty table gives no rows; other columns are ignored.
    """
    with temporary(pages.sparkSession) as scope:
        rules = written(infer(pages, url_col, html_col, wide).select("host", "wrapper", "slots"), "rules")
        scope.keep(rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows, get = with_rules(rows.withColumn("host", host_of(F.col("url"))), rules, rule)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=256, text="html"):
                texts = [main_text(page, *own, wide) for page, own in zip(part.column("html").to_pylist(), get(part))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
