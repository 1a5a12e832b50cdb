"""URL rules, HTML wrappers and WARC archives."""

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter

import pytest

from lexmill.llm import htmlwrap, urlfilter, warc
from lexmill.llm.queries import URL_RULES, op5_url_filter, op8_html

SF = "/root/testdata/sf0.01"


def split(url):
    """Host and path by the contract's words."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme/x", "://", "http://", "http://NET/", "http://net", "http://a.net?x=/", "https://example.net/en/", "https://a.Example.NET/en", "ftp://x.example.com/de/1#y://z", "http://example.com/DE/", "http://org/fr/q?u=http://b.net/",
    "http://myorg/fr/", "http://a.org/fr", "http://é.NET/\n/x", "http://a b.net/ /", "x://y://net/", "http://ÄNET/", "http://.net/", "http://user@a.net:80/",
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([*enumerate(URLS), (3, "http://twice.net/")], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as items")
    rows = urlfilter.judge(df, URL_RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        if r.page_id != 3:
            host, path = split(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path))
        assert r.verdict == URL_RULES[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urlfilter.judge(df.where("false"), URL_RULES).count() == 0


def test_rules_are_mined(spark):
    rng = random.Random(0)
    urls = [f"http://s{rng.randrange(30)}.{'casino' if k % 3 == 0 else 'paper'}.test/{'win' if k % 2 else 'news'}/{k}" for k in range(400)]
    labels = spark.createDataFrame([(u, "block" if "casino" in u and "/win/" in u else "allow") for u in urls[:300]], "url string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls[300:])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, {}, labels=labels).collect()}
    assert got == {k: "block" if "casino" in u and "/win/" in u else "allow" for k, u in enumerate(urls[300:])}


def test_long_rules_are_mined(spark):
    """Only all five words together tell what is blocked."""
    words = ["one", "two", "three", "four", "five"]
    sets = [[w for k, w in enumerate(words) if bits >> k & 1] for bits in range(32)]
    labels = spark.createDataFrame([(f"http://h.test/{'/'.join(own)}", "block" if len(own) == 5 else "allow") for own in sets for _ in range(4)], "url string, verdict string")
    pages = spark.createDataFrame([(k, f"http://h.test/{'/'.join(own)}") for k, own in enumerate(sets)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, {}, labels=labels).collect()}
    assert got == {k: "block" if len(own) == 5 else "allow" for k, own in enumerate(sets)}


def test_long_shared_paths_are_mined_at_once(spark):
    """40 words that always come together, with either verdict, and a host that settles it."""
    path = "/".join("".join(chr(97 + (k * d) % 26) for d in (1, 7, 11)) + chr(97 + k // 26) for k in range(1, 41))
    urls = [(f"http://{'good' if k % 3 else 'bad'}.test/{path}/{'more' if k % 2 else 'less'}", "allow" if k % 3 or k % 2 else "block") for k in range(60)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, {}, labels=spark.createDataFrame(urls, "url string, verdict string")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(urls)}


def test_mined_verdicts_of_held_out_urls(spark):
    """URLs that a given rule decides, a third of them held out: what is mined from the others says the same of nearly all."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    ruled = [(r.page_id, r.url, URL_RULES[rule_of(*split(r.url))]) for r in df.select("page_id", "url").collect() if rule_of(*split(r.url))]
    learn, held = [(u, v) for k, u, v in ruled if k % 3], [(k, u) for k, u, _ in ruled if k % 3 == 0]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(held, "page_id long, url string"), {}, labels=spark.createDataFrame(learn, "url string, verdict string")).collect()}
    want = {k: v for k, _, v in ruled}
    for verdict in ("allow", "block"):
        own = [want[k] == verdict for k, v in got.items() if v == verdict]
        print(verdict, len(own), sum(own) / len(own))
        assert len(own) > 50 and sum(own) / len(own) > 0.9


def test_many_given_rules(spark):
    """2,000 rules over hosts of several depths, against comparing each."""
    rng = random.Random(5)
    hosts = [".".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(300)]
    rules = {f"{rng.choice(hosts)}/{rng.choice(['', 'x/', 'x/y', 'z'])}": rng.choice(["allow", "block"]) for _ in range(2_000)}
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'x/', 'x/yy', 'q'])}" for _ in range(200)]
    rows = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in rows:
        fits = [x for x in rules if (r.host == x.partition("/")[0] or r.host.endswith("." + x.partition("/")[0])) and r.path.startswith("/" + x.partition("/")[2])]
        assert r.rule == max(fits, key=lambda x: (len(x), x), default=None) and (not fits or r.verdict == rules[r.rule])


def test_very_long_urls(spark):
    urls = ["http://a.net/" + "x/" * 200_000, "http://" + "a." * 20_000 + "example.com/de/", "http://b.org/" + "-".join(f"w{k}" for k in range(20_000))]
    rows = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()}
    assert rows[0] == ("net/", "block") and rows[1] == ("example.com/de/", "block") and rows[2][0] is None


def test_rules_match_as_brute_force(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample("abcdefgh", rng.randrange(0, 6))) for _ in range(60)]
    rules = [(f"r{k}", sorted(rng.sample("abcdefgh", rng.randrange(1, 4))), rng.choice(["allow", "block"]), rng.choice([0.8, 0.9, 1.0]), rng.random()) for k in range(15)]
    frame = spark.createDataFrame([(i, t, len(t), v, c, s) for i, t, v, c, s in rules], "rule_id string, items array<string>, size int, verdict string, confidence double, support double")
    rows = urlfilter.match(spark.createDataFrame([(s,) for s in sets], "items array<string>"), frame).collect()
    got = {tuple(r["items"]): r["mined"] for r in rows}
    for s in sets:
        fits = [r for r in rules if set(r[1]) <= set(s)]
        assert got.get(tuple(s)) == (max(fits, key=lambda r: (r[3], r[4], len(r[1]), r[0]))[2] if fits else None)


def test_url_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op5_url_filter(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path)) and (not r.rule or r.verdict == URL_RULES[r.rule])


def url_tokens(url):
    host, path = split(url)
    labels = [x for x in host.split(".") if x]
    parts = [y for x in labels for y in x.split("-") if y]
    words = [w for w in re.split(r"[\W_]+", path.lower()) if w and not w.isnumeric()]
    names = [n.lower() for n in re.findall(r"[?&]([^=&#]+)=", url or "")]
    return {f"label:{x}" for x in labels} | ({f"top:{labels[-1]}"} if labels else set()) | ({f"part:{x}" for x in parts} if len(parts) > len(labels) else set()) | {f"path:{x}" for x in words} | {f"query:{x}" for x in names}


def mined_verdicts(learn, urls, min_support=0.01, min_confidence=0.8):
    """By all subsets: learn has (url, verdict), the result verdicts of urls or None."""
    rows = [(url_tokens(u), v) for u, v in learn]
    least = math.ceil(min_support * len(rows) - 1e-9)
    having = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            having.setdefault(t, []).append(k)
    own = {}
    for t in sorted(having):
        if len(having[t]) >= least:
            own.setdefault(tuple(having[t]), t)
    item = {t: own[tuple(h)] for t, h in having.items() if len(h) >= least}
    counts = {}
    for tokens, v in rows:
        items = sorted({item[t] for t in tokens if t in item})
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(items, n):
                counts.setdefault(part, Counter())[v] += 1
    rules = {(p, v): (n / sum(c.values()), n / len(rows)) for p, c in counts.items() for v, n in c.items() if n >= least and n >= min_confidence * sum(c.values())}
    kept = [(p, v, *r) for (p, v), r in rules.items() if not any(rules.get((q, v), (0,))[0] >= r[0] for n in range(1, len(p)) for q in itertools.combinations(p, n))]
    out = []
    for u in urls:
        has = {item.get(t, t) for t in url_tokens(u)}
        fits = [(c, s, len(p), f"{v} {' '.join(p)}", v) for p, v, c, s in kept if set(p) <= has]
        out.append(max(fits)[4] if fits else None)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_url_query_mines_as_brute_force(spark, sf):
    """The verdicts of all URLs that no given rule fits, by rules from all subsets of the others' tokens."""
    path = f"/root/testdata/{sf}"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    given = {k: rule_of(*split(u)) for k, u in urls.items()}
    rest = [k for k in urls if not given[k]]
    want = dict(zip(rest, mined_verdicts([(u, URL_RULES[given[k]]) for k, u in urls.items() if given[k]], [urls[k] for k in rest])))
    got = {r.page_id: r.verdict for r in op5_url_filter(spark, path).collect() if r.page_id in want}
    assert got == {k: v or "allow" for k, v in want.items()}
    assert sum(v is not None for v in want.values()) > len(want) / 2


def texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.test/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as wrapper", "3 as fixed")
    return [r.text for r in sorted(htmlwrap.extract(df).collect())]


def texts_of_hosts(spark, hosts):
    """The texts of the pages of several hosts, in one go."""
    rows = [(1_000 * h + k, f"http://h{h}.test/{k}", p) for h, pages in enumerate(hosts) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [[got[1_000 * h + k] for k in range(len(pages))] for h, pages in enumerate(hosts)]


PAGE = """<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="x">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li>Menu {k}</ul></nav><div class="notice cookie">We use cookies {k}</div><aside id="sidebar">side {k}</aside>
<article><h1>Head {k} &amp; more</h1><p>One   two<br>three <b>bold</b>, <i>it</i>.<p>Second &lt;b&gt; {k}</p>{extra}<form><input>Search {k}</form><div class="ad-box">Buy {k}</div>
<section class="comments"><article class="comment"><p>First! {k}</p></article></section></article><footer>&copy; {k}</footer>"""


def test_articles(spark):
    extra = ["", "<ul><li>a<li>b</ul>", "<blockquote>q\nq</blockquote><!-- <p>no</p> -->", "<table><tr><td>x<td>y</table>", "<p></p><p> </p>"]
    added = [[], ["a", "b"], ["q q"], ["x", "y"], []]
    got = texts(spark, [PAGE.format(k=k, extra=e) for k, e in enumerate(extra)])
    assert got == ["\n".join([f"Head {k} & more", "One two three bold, it.", f"Second <b> {k}", *a]) for k, a in enumerate(added)]


def test_hosts_without_articles(spark):
    pages = [f"<body><div id=top>Always the same</div><div class=body><p>Story {k}</p><p>More {k}</p></div><div>Always the same too</div></body>" for k in range(4)]
    assert texts(spark, pages) == [f"Story {k}\nMore {k}" for k in range(4)]


def test_slots_are_aligned(spark):
    """One path, two slots: only the wrapper tells the line that stays from the story; a main element that never changes isn't the article."""
    pages = [f"<body><p>Always the same</p><h2>Title {k}</h2><p>Story {k}</p></body>" for k in range(3)]
    assert texts(spark, pages) == [f"Title {k}\nStory {k}" for k in range(3)]
    pages = [f"<body><main><p>Our house</p></main><div class=content><h1>Title {k}</h1><p>By us</p></div></body>" for k in range(3)]
    assert texts(spark, pages) == [f"Title {k}\nBy us" for k in range(3)]


def test_copies_keep_their_text(spark):
    copy = "<body><div class=bq><p>Once upon</p><p>a time</p></div><footer>{}</footer></body>"
    assert texts(spark, [copy.format(1)] * 3) == ["Once upon\na time"] * 3
    assert texts(spark, [copy.format(k) for k in range(3)]) == ["Once upon\na time"] * 3
    other = [f"<body><div id=top>Always the same</div><p>Story {k}</p></body>" for k in range(2)]
    assert texts(spark, [copy.format(1)] * 2 + other) == ["Once upon\na time"] * 2 + ["Story 0", "Story 1"]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>w{k} " + "x" * 50 for k in range(20_000)) + "</article>"
    pages = [None, "", "plain text", "<", "<p", "a < b &lt; c", deep, "<article></article>", "</div></p>x</body>y", "<p>é\xa0\u2003ü</p>", long, "<!-- never closed <p>x</p>", "<script>never closed", "<a title='>'>t</a>", "<article>&#0;&bogus;&#x1F389;</article>"]
    got = texts(spark, pages)
    assert got[:6] == ["", "", "plain text", "<", "<p", "a < b < c"] and got[6] == "deep" and got[7] == "" and got[8] in ("x\ny", "x y", "xy") and got[9] == "é ü"
    assert got[10].count("\n") == 19_999 and got[11:14] == ["", "", "t"] and got[14] == html.unescape("&#0;&bogus;&#x1F389;")


def test_wrappers_are_inferred():
    make = lambda items, note: f"<body><ul>{'<li>x' * items}</ul>{note}<h2>h</h2><p>a</p><p>b</p><h2>h</h2><p>c</p></body>"
    whole = htmlwrap.wrapper(htmlwrap.parse(make(1, "")))
    for page in (make(3, "<div>n</div>"), make(2, "")):
        whole = htmlwrap.both(whole, htmlwrap.wrapper(htmlwrap.parse(page)))
    assert htmlwrap.expression(whole) == "<body><ul>(<li>#</li>)+</ul>(<div>#</div>)?(<h2>#</h2>(<p>#</p>)+)+</body>"


def test_inference_by_parts(spark):
    pages = [PAGE.format(k=k, extra="<ul><li>z</ul>" * (k % 3)) for k in range(30)]
    df = spark.createDataFrame([(k, "http://h.test/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    one, many = (htmlwrap.infer(df.coalesce(1)).first(), htmlwrap.infer(df.repartition(6)).first())
    assert one.pages == many.pages == 30
    chosen = [htmlwrap.rule(r.wrapper, r.slots) for r in (one, many)]
    for whole, _, own in chosen:
        found = [text for _, text, _ in htmlwrap.slots(htmlwrap.parse(pages[1]), whole, own)]
        assert found[0] == "Head 1 & more" and found[-1] == "z" and len(found) == 4


def neutral(page):
    """The page without any name or tag that says what an element is for."""
    page = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b", r"<\1div", page)
    return re.sub(r' (class|id|role)=("[^"]*"|[^ >]+)', "", page)


def test_names_and_tags_are_not_needed(spark):
    """All pages without tags like article and nav and without class names: the same texts."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, neutral(r.html)) for r in df.collect()]
    assert not any(re.search("<(article|nav|footer)|class=", h) for _, _, h in rows)
    want = {r.page_id: r.text for r in htmlwrap.extract(df).collect()}
    assert {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(rows, df.schema)).collect()} == want


def test_names_do_not_delete_articles(spark):
    body = "<{0}><h1>Title {1}</h1><p>Body text {1}.</p><p class='notice-board'>Board {1} <span class=share>shared</span> <math><mi>x</mi></math>.</p></{2}>"
    hosts = []
    for tag in ("article class='post no-comments'", "div class='has-sidebar content'", "div class='with-header-menu'", "div class=widget", "main id=comments-page", "form id=aspnetForm", "div"):
        pages = [f"<body><nav><a href=x>Menu {k}</a></nav>{body.format(tag, k, tag.split()[0])}</body>" for k in range(3)]
        hosts += [pages[:1], pages]
    want = [f"Title {k}\nBody text {k}.\nBoard {k} shared x." for k in range(3)]
    assert texts_of_hosts(spark, hosts) == [want[: len(pages)] for pages in hosts]


def test_parts_that_go(spark):
    """Names of several words, hidden elements, controls, and comments longer than the article; lists of links that change are the article's."""
    parts = ["<div class=cookie-notice>Cookies {0}</div>", "<div class='comments-list'>" + "<p>Long comment {0} indeed</p>" * 9 + "</div>", "<ul><li><a href=a>One {0}</a><li><a href=b>Two</a></ul>", "<p hidden>no</p><div style='display: none'><p>no {0}</div>", "<p>A <button>Buy {0}</button><span hidden>no</span>line {0}</p>"]
    pages = [f"<body><nav><a href=x>Menu {k}</a></nav><article><h1>Title {k}</h1><p>The story of number {k}, told well</p>{''.join(parts).format(k)}<p>End {k}</p></article></body>" for k in range(3)]
    assert texts(spark, pages) == [f"Title {k}\nThe story of number {k}, told well\nOne {k}\nTwo\nA line {k}\nEnd {k}" for k in range(3)]


COMMENTS = [
    ("<div class=comments>{}</div>", "<p>Comment {} of many, as long as a paragraph</p>"),
    ("<section id=comment-list>{}</section>", "<article class=comment><p>Comment {} of many, long</p></article>"),
    ("<div><div class='replies box'>{}</div></div>", "<div class=reply>Comment {} of many, quite long</div>"),
]


def test_comments_never_win(spark):
    """From half to 99.8 % of a page's text are comments, beside the article and within it, with one page and with three a host."""
    hosts, want = [], []
    for (region, one), count, inside, pages in itertools.product(COMMENTS, (2, 8, 60, 900), (True, False), (1, 3)):

        def page(k):
            article = f"<h1>Title {k}</h1><p>The story of number {k}.</p><p>It goes on for some time {k}.</p><p>And on.</p><p>Then it ends {k}.</p>"
            own = region.format("".join(one.format(f"{k}-{j}") for j in range(count)))
            body = f"<article class=post>{article}{own}</article>" if inside else f"<article class=post>{article}</article>{own}"
            return f"<body><nav><a href=x>Menu</a></nav>{body}<footer>Us</footer></body>"

        hosts.append([page(k) for k in range(pages)])
        want.append([f"Title {k}\nThe story of number {k}.\nIt goes on for some time {k}.\nAnd on.\nThen it ends {k}." for k in range(pages)])
    assert texts_of_hosts(spark, hosts) == want


def test_comments_alone_stay(spark):
    """Where nothing else is rich the named region is the page's text."""
    pages = [f"<body><h1>Guests {k}</h1><div class=comments>{''.join(f'<p>Entry {j} of {k}</p>' for j in range(9))}</div></body>" for k in range(3)]
    assert all("Entry 8 of" in t for t in texts(spark, pages))


def test_parts_that_stay(spark):
    """Linked sources, tables of links, closing lines: all the article's, with one page and with three."""
    told = [f"Paragraph {j} of story {{0}}, with words enough." for j in range(4)]
    text = "".join(f"<p>{line}</p>" for line in told)
    sources = "<h2>Sources</h2><ul>{}</ul>".format("".join(f"<li><a href=x{j}>Source {j} of {{0}}</a></li>" for j in range(12)))
    table = "<table>{}</table>".format("".join(f"<tr><td><a href=x{j}>Cell {j} of {{0}}</a></td></tr>" for j in range(12)))
    cases = [
        (f"<nav><a href=x>Menu</a></nav><article><h1>T {{0}}</h1>{text}{sources}</article>", ["Sources", *(f"Source {j} of {{0}}" for j in range(12))]),
        (f"<div><a href=x>Menu</a></div><div class=content><h1>T {{0}}</h1>{text}{table}</div>", [f"Cell {j} of {{0}}" for j in range(12)]),
        (f"<h1>T {{0}}</h1>{text}<div>A closing sentence {{0}}.</div>", ["A closing sentence {0}."]),
    ]
    want = [["\n".join(["T {0}", *told, *rest]).format(k) for k in range(n)] for _, rest in cases for n in (1, 3)]
    assert texts_of_hosts(spark, [[f"<body>{page.format(k)}</body>" for k in range(n)] for page, _ in cases for n in (1, 3)]) == want


def test_menus_stay_menus_in_the_deep(spark):
    page = "<body>" + "<div>" * 400 + "<nav><a href=x>MENU {0}</a></nav><div><h1>Head {0}</h1><p>Text {0}</p></div>" + "</div>" * 400 + "</body>"
    assert texts(spark, [page.format(k) for k in range(3)]) == [f"Head {k}\nText {k}" for k in range(3)]
    deep = htmlwrap.wrapper(htmlwrap.parse("<div>" * 5000 + "x"))
    assert htmlwrap.dumped(htmlwrap.loaded(htmlwrap.dumped(deep))) == htmlwrap.dumped(deep)


def test_pages_of_another_kind(spark):
    """A host of two layouts: pages that lack what the host's sums choose are decided by their own."""
    pages = [f"<body><div><a href=x>Menu {k}</a></div><div><h1>Head {k}</h1><p>Text {k} and more of it</p></div></body>" for k in range(4)] + [f"<body><div><a href=x>Menu {k}</a></div><table><tr><td>Cell {k}</td><td>other {k}</td></tr></table></body>" for k in range(2)]
    assert texts(spark, pages) == [f"Head {k}\nText {k} and more of it" for k in range(4)] + [f"Cell {k}\nother {k}" for k in range(2)]


def test_long_articles_of_every_kind(spark):
    """Thousands of blocks in any order: all are kept, in order, and the wrapper stays small, however wide it may be."""
    rng = random.Random(3)
    kinds = ["<p>{0}</p>", "<h2>{0}</h2>", "<ul><li>{0}</ul>", "<blockquote>{0}</blockquote>", "<pre>{0}</pre>"]
    blocks = [[f"block {k} {j}" for j in range(n)] for k, n in enumerate((3_000, 2_500, 70, 5))]
    pages = [f"<body><div><a href=x>Menu {k}</a></div><div>{''.join(rng.choice(kinds).format(b) for b in own)}</div></body>" for k, own in enumerate(blocks)]
    assert texts(spark, pages) == ["\n".join(own) for own in blocks]
    whole = htmlwrap.wrapper(htmlwrap.parse(pages[0]))
    assert len(htmlwrap.dumped(htmlwrap.both(whole, htmlwrap.wrapper(htmlwrap.parse(pages[1]))))) < 2_000
    df = spark.createDataFrame([(k, "http://h.test/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in sorted(htmlwrap.extract(df, wide=5).collect())] == ["\n".join(own) for own in blocks]


def test_wide_elements_keep_their_order():
    """70 children of 7 kinds: beyond wide each kind is one repeated part, up to it order and optional parts are told."""
    page = "<body>" + "".join(f"<{t}>x</{t}>" for k in range(70) for t in (["h2", "p", "pre", "ul", "ol", "dl", "blockquote"][k * k % 7],)) + "</body>"
    tree = htmlwrap.parse(page)
    narrow, wide = htmlwrap.wrapper(tree, wide=8), htmlwrap.wrapper(tree, wide=500)
    assert max(len(narrow[1][0][1]), 8) == 8 < len(wide[1][0][1])
    assert all(k[2] == 0 and k[3] for k in narrow[1][0][1]) and not any(k[2] == 0 for k in wide[1][0][1])


def test_join_extracts_alike(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    by_broadcast = sorted(tuple(r) for r in htmlwrap.extract(df).collect())
    monkeypatch.setattr(htmlwrap, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in htmlwrap.extract(df).collect()) == by_broadcast


def test_html_query_returns_the_documents(spark):
    """The pages wrap documents, whose number ends their path: the heading is cut from the text that follows."""
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = op8_html(spark, SF).collect()
    assert len(pages) == 250 and all(r.n_chars == len(r.text) for r in pages)
    for r in pages:
        own = docs[int(re.search(r"/(\d+)", r.url.split("://")[1])[1])]
        assert " ".join(r.text.split("\n")[1:]) == own


PAYLOADS = {1: "a" * 1000, 2: "a" * 1000, 5: "a" * 1000, 3: "a" * 999, 4: "a" * 999, 6: None, 7: "", 8: "é" * 600, 9: "é" * 600, 10: "\r\n\r\nWARC/1.1\r\n" * 200, 11: "x" * 3_000_000}


def test_archives_round_trip(spark):
    rows = [(k, f"http://h.test/{k}", p) for k, p in PAYLOADS.items()] + [(12, None, "b" * 2000), (12, None, "b" * 2000), (None, "http://n/", "c" * 2000), (None, "http://n/", "c" * 2000), (13, "http://h/\r\n%0D", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as size", "2 as digest", "3 as refers").repartition(4)
    path = warc.new_path(spark)
    warc.write_warc(df, path, file_bytes=2000)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for page, url, text in rows:
        r, raw = by_id[page], (text or "").encode()
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), hashlib.sha1(raw).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert {p: r.refers_to for p, r in by_id.items() if r.record_type == "revisit"} == {1: 5, 2: 5, 8: 9}


@pytest.mark.parametrize("useful", [0.01, 1.0])
def test_pages_that_the_filter_takes_wrongly(spark, monkeypatch, useful):
    """A filter that knows every page: all payloads are looked up, or joined if it is of no use; none is lost."""
    from lexmill.llm import bloom

    monkeypatch.setattr(bloom, "USEFUL", useful)
    monkeypatch.setattr(bloom, "build", lambda keys, column: bloom.Bloom(warc_all()))
    df = spark.createDataFrame([(k, f"http://h.test/{k}", p) for k, p in PAYLOADS.items()], "page_id long, url string, html string").repartition(3)
    path = warc.new_path(spark)
    warc.write_warc(df, path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {1: 5, 2: 5, 8: 9}
    assert all(bytes(r.payload) == (PAYLOADS[p] or "").encode() for p, r in got.items() if r.record_type == "response") and len(got) == len(PAYLOADS)


def warc_all():
    import numpy as np

    return np.full(64, 2**64 - 1, np.uint64)


def test_archives_are_plain_zstandard(spark):
    import zstandard

    path = warc.new_path(spark)
    warc.write_warc(spark.read.parquet(f"{SF}/pages.parquet"), path)
    data = bytes(warc.read_blobs(spark, path).first().content)
    magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    assert magic == 0x184D2A5D and data[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    plain = sum(len(r.html.encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    assert len(data) < plain / 2
    with pytest.raises(ValueError):
        list(warc.records(data[: len(data) // 2]))


def test_empty_archive(spark):
    path = warc.new_path(spark)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0
