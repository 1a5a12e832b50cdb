"""Vocabularies, training, encoding, decoding, cleaning, sources, streams."""

import bz2
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import runtime
from lexmill.__main__ import main
from lexmill.functions import pretokens as P
from lexmill.functions import text as X
from lexmill.functions import wikitext as K
from lexmill.functions.sql import register
from lexmill.operators import codec, report, train
from lexmill.operators.vocab import BOS, EOS, PAD, Vocabulary
from lexmill.plans import queries as Q
from lexmill.sources import files, wiki
from lexmill.streaming import text as streams

SENTENCES = ["The quick brown fox jumps over the lazy dog.", "Hello world, this is a test.", "Python programming is fun.", "Machine learning and deep learning."]


def corpus(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def rules(vocab):
    return [(*pair, new) for pair, new in vocab.merges]


GOLDEN = [
    (["aa"] * 3 + ["bb"] * 2, 258, 2, [(97, 97, 256), (98, 98, 257)]),
    (["abab"] * 10, 260, 2, [(97, 98, 256), (256, 256, 257)]),
    (["aa"] * 10 + ["bb"], 258, 5, [(97, 97, 256)]),
    (["hello"] * 10, 260, 2, [(101, 108, 256), (104, 256, 257), (257, 108, 258), (258, 111, 259)]),
    (["abc"] * 2 + ["bc"] * 5 + ["ab"] * 10, 259, 2, [(97, 98, 256), (98, 99, 257)]),
    ([], 260, 2, []),
]


@pytest.mark.parametrize(("texts", "size", "least", "want"), GOLDEN)
def test_training_goldens(spark, texts, size, least, want):
    df = corpus(spark, texts)
    assert rules(train.train(df, size, least)) == want
    assert rules(train.train(df, size, least, kernel_words=0 if texts else 1)) == want


def test_exact_counting_is_the_textbook(spark):
    assert rules(train.train(corpus(spark, ["hello"] * 10), 260, counting="exact")) == [(101, 108, 256), (104, 256, 257), (108, 111, 258), (257, 258, 259)]
    assert rules(train.train(corpus(spark, GOLDEN[4][0]), 259, counting="exact")) == [(97, 98, 256), (98, 99, 257), (256, 99, 258)]


def merged(tokens, pair, new):
    out, k = [], 0
    while k < len(tokens):
        hit = tuple(tokens[k : k + 2]) == pair
        out.append(new if hit else tokens[k])
        k += 1 + hit
    return out


def textbook(words, n, least):
    state, out = {w: list(w) for w in words}, []
    while len(out) < n:
        count = {}
        for w, f in words.items():
            for p in zip(state[w], state[w][1:]):
                count[p] = count.get(p, 0) + f
        if not count or max(count.values()) < least:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        out.append((pair, 256 + len(out)))
        state = {w: merged(t, *out[-1]) for w, t in state.items()}
    return out


@given(st.dictionaries(st.binary(min_size=1, max_size=8).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 9), max_size=12))
@settings(max_examples=150, deadline=None)
def test_exact_counting_against_recounting(words):
    assert train.learn(words.items(), 12, 2, "exact") == textbook(words, 12, 2)


def test_exact_counting_beyond_the_kernel(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["aaaa aaa abab", "hello"] * 3
    words = {r.pre_token.encode(): r.freq for r in P.word_counts(corpus(spark, texts)).collect()}
    assert rules(train.train(corpus(spark, texts), 266, counting="exact", kernel_words=0)) == [(*p, n) for p, n in textbook(words, 10, 2)]


@pytest.mark.parametrize("counting", ["compat", "exact"])
@pytest.mark.parametrize(("seed", "batch", "compact"), [(1, 1, 3), (3, 64, 2)])
def test_relational_steps_of_many_merges(spark, counting, seed, batch, compact):
    """Many words with few letters in common: several merges a step give what one after the other gives."""
    rng = random.Random(seed)
    words = {bytes(rng.choice([b"ab", b"cd", b"ef", b"abc"])[0:1] * rng.randrange(1, 3) + bytes(rng.choices(rng.choice([b"ab", b"cde", b"fgh", b"ij"]), k=rng.randrange(1, 6)))): rng.randrange(1, 40) for _ in range(40)}
    frame = spark.createDataFrame([(f, list(w)) for w, f in words.items()], "freq long, toks array<int>")
    steps = []
    want = train.learn(words.items(), 10, 2, counting)
    real, train.written = train.written, lambda df, name, *a: (steps.append(name), real(df, name, *a))[1]
    try:
        assert train.learn_relational(frame, 10, 2, counting, batch=batch, compact=compact) == want
        assert len(want) == 10 and (batch == 1 or steps.count("visited") < 10)
        assert train.learn_relational(frame, 6, 2, counting, known=want[:4], batch=batch) == want[:6] == train.learn(words.items(), 6, 2, counting, known=want[:4])
    finally:
        train.written = real


def test_training_goes_on(spark):
    df = corpus(spark, SENTENCES * 9)
    whole, part = train.train(df, 300), train.train(df, 270)
    assert train.train(df, 300, resume=part).merges == whole.merges and part.merges == whole.merges[:14]
    assert train.train(df, 300, resume=part, kernel_words=0).merges == whole.merges
    # Another corpus: the rules learned before stay, whether or not it has their pairs.
    other = train.train(corpus(spark, ["zzzz zz"] * 5), 272, resume=part)
    assert other.merges[:14] == part.merges and other.merges[14][0] == (122, 122)


def test_training_ignores_order_and_partitions(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["low", "lower", "newest", "widest", "aaa", "aaaa"]) for _ in range(9)) for _ in range(60)]
    first = rules(train.train(corpus(spark, texts), 290))
    rng.shuffle(texts)
    assert first == rules(train.train(corpus(spark, texts).repartition(7), 290))
    words = {}
    for r in P.word_counts(corpus(spark, texts)).collect():
        words[r.pre_token.encode()] = r.freq
    assert first == [(*p, n) for p, n in train.learn(words.items(), 34)]


def test_training_refuses_bad_sizes(spark):
    for bad in ({"min_frequency": 0}, {"vocab_size": 300_002}, {"counting": "other"}):
        with pytest.raises(ValueError):
            train.train(corpus(spark, ["a"]), **bad)


def test_vocabulary_lookups_and_files(spark, tmp_path):
    v = Vocabulary()
    assert v.vocab_size == len(v) == 259 and v.get_token_bytes(65) == b"A" and v.get_token_id(b"A") == 65
    v = v.add_merge((65, 66), 256).add_merge((256, 67), 257)
    assert v.get_token_bytes(257) == b"ABC" and v.get_token_id(b"ABC") == 257 and v.ranks == {(65, 66): (0, 256), (256, 67): (1, 257)}
    assert v.get_token_bytes(99999) is None and v.get_token_id(b"zz") is None and v.get_token_bytes(EOS) == b"<|endoftext|>" and v.get_special_token_id("<|padding|>") == PAD
    assert Vocabulary.from_dict(v.to_dict()) == v
    v.save(tmp_path / "m")
    assert Vocabulary.load(tmp_path / "m") == v == Vocabulary.read(spark, str(tmp_path / "m"))
    assert "65 66 -> 256" in (tmp_path / "m" / "merges.txt").read_text().splitlines()
    config = json.loads((tmp_path / "m" / "config.json").read_text())
    assert config["tokenizer_type"] == "BPE" and config["num_merges"] == 2 and config["special_tokens"]["<|startoftext|>"] == BOS
    with pytest.raises(FileNotFoundError):
        Vocabulary.load(tmp_path / "nowhere")
    assert Vocabulary.of_merges([(65, 66), ((256, 67), 257)]) == v
    assert v.get_vocab()["ABC"] == 257 and v.get_vocab()["<0xff>"] == 255 and v.get_vocab()["<|endoftext|>"] == EOS


@pytest.fixture(scope="module")
def tokenizer(spark):
    return codec.Tokenizer(train.train(corpus(spark, SENTENCES * 50), 300))


TEXTS = [
    "", "Hello world", "The quick brown fox", "café", "日本語", "emoji 🎉", "Ümläut", " ", "  ", "\n", "\t", "a\r\n\r\n b", "Hello 123 café 日本語 🎉", "𝕳", "it's 'ſ don't", "x" * 5000, "Hello world " * 1000, "<|endoftext|>", "\x85\xa0  end",
]


def test_round_trips(spark, tokenizer):
    ids = tokenizer.encode_batch(spark, TEXTS)
    assert tokenizer.decode_batch(spark, ids) == TEXTS
    assert ids[0] == [] and 256 < tokenizer.vocab_size <= 303
    marked = tokenizer.encode_batch(spark, TEXTS, specials=True)
    assert marked[0] == [] and all(m == [BOS, *i, EOS] for m, i in zip(marked[1:], ids[1:]))
    assert tokenizer.decode_batch(spark, marked) == TEXTS
    assert tokenizer.decode_batch(spark, marked[1:2], skip_special=False) == ["<|startoftext|>Hello world<|endoftext|>"]
    assert tokenizer.encode_batch(spark, [None], specials=True) == [[]]


def test_decoding_in_workers_is_the_same(spark, tokenizer):
    rows = spark.createDataFrame([([72, 101, 999999, EOS],), ([195, 97],), ([],), (None,), ([256, 257],)], "ids array<int>")
    for skip in (True, False):
        inside = codec.decode(rows, tokenizer.vocab, skip_special=skip).collect()
        assert inside == codec.decode(rows, tokenizer.vocab, skip_special=skip, jvm_tokens=0).collect()


def test_both_modes_agree(spark, tokenizer):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id int, text string")
    a = {r.doc_id: r.ids for r in codec.encode(df, tokenizer.vocab, specials=True).collect()}
    assert a == {r.doc_id: r.ids for r in codec.encode(df, tokenizer.vocab, specials=True, mode="join").collect()}


def test_join_keeps_rows_of_one_id_apart(spark, tokenizer, monkeypatch):
    rows = [(1, "ab cd"), (1, "xyz"), (None, "the the"), (2, ""), (2, None), (1, "ab cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (10_000, 3, 0):
        monkeypatch.setattr(codec, "HOT_WORDS", hot)
        one, other = (codec.encode(df, tokenizer.vocab, mode=m) for m in ("map", "join"))
        assert other.columns == one.columns and sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_frequent_words_stay_within_their_bound(spark, tokenizer, monkeypatch):
    """Frequent, rare and long words in one text; quotes, line ends and letters beyond two bytes; ties at the bound's edge."""
    from pyspark.sql import functions as F

    long = "x" * (codec.HOT_LENGTH + 1)
    texts = [f'the "the" 🎈 {long} one\n\\ \0 é', f"the the {long} two 🎈🎈", long * 3, "the " * 50 + "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {r.doc_id: r.ids for r in codec.encode(df, tokenizer.vocab).collect()}
    for hot in (0, 1, 2, 5, 100):
        monkeypatch.setattr(codec, "HOT_WORDS", hot)
        assert want == {r.doc_id: r.ids for r in codec.encode(df, tokenizer.vocab, mode="join").collect()}
    words = spark.createDataFrame([("a", 9, [1]), ("b", 2, [2]), ("c", 2, [3]), (long, 99, [4])], "pre_token string, freq long, part array<int>")
    for hot, found in ((2, ["a"]), (3, ["a", "b", "c"]), (0, [])):
        monkeypatch.setattr(codec, "HOT_WORDS", hot)
        known = codec.frequent(words)
        assert [r.pre_token for r in words.where(known(F.col("pre_token")).isNotNull()).orderBy("pre_token").collect()] == found


def test_vocabularies_on_any_file_system(spark, tokenizer, tmp_path):
    tokenizer.vocab.write(spark, f"file://{tmp_path}/v")
    assert Vocabulary.read(spark, f"file://{tmp_path}/v") == tokenizer.vocab
    tokenizer.vocab.save(tmp_path / "w")
    assert Vocabulary.read(spark, f"file://{tmp_path}/w") == tokenizer.vocab == Vocabulary.load(tmp_path / "w")
    data = tokenizer.vocab.to_dict()
    assert Vocabulary.from_dict({k: v for k, v in data.items() if k != "special_tokens"}) == tokenizer.vocab and Vocabulary.from_dict(data | {"special_tokens": {}}).special_tokens == {}


def test_other_tokenizers_are_compared(spark):
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids)).replace("z", "?")

    df = corpus(spark, ["abc", "xyz", None, ""])
    found = report.benchmark_other(df, Letters(), "letters", iterations=3)
    assert (found["total_tokens"], found["total_chars"], found["roundtrip_errors"], found["name"]) == (18, 18, 1, "letters")
    assert report.compare(report.benchmark(df, Vocabulary(), "own", 3), found)["token_efficiency"] == 1
    assert report.benchmark_other(df.where("false"), Letters(), "none")["tokens_per_char"] is None


def test_unreadable_pages_are_told(spark, monkeypatch):
    pages = spark.createDataFrame([("A", "0", "x" * 600), ("B", "1", "y")], "title string, ns string, text string")
    assert wiki.unreadable(pages).count() == 0
    monkeypatch.setattr(K, "plain_column", lambda c: F.lit(None).cast("string"))
    assert [r.title for r in wiki.unreadable(pages).collect()] == ["A"] and wiki.articles(pages).count() == 0


@given(st.lists(st.tuples(st.integers(97, 99), st.integers(97, 99)), max_size=4), st.text("abc", max_size=90))
@settings(max_examples=200, deadline=None)
def test_heap_and_scan_merge_alike(base, word):
    merges = list(dict.fromkeys(base))
    merges += [(256 + k, 97) for k in range(len(merges))] + [(256, 256)] * bool(merges)
    ranks = Vocabulary.of_merges(merges).ranks
    assert codec._merge_short(list(word.encode()), ranks) == codec._merge_long(list(word.encode()), ranks)


def test_pre_tokens(spark):
    cases = {"Hello  world": ["Hello", " ", " world"], "12345": ["123", "45"], "'second": ["'s", "econd"], "hi!\n\nx": ["hi", "!\n\n", "x"], "a \n\n  b": ["a", " \n\n", " ", " b"], "I'm don't": ["I", "'m", " don", "'t"], "": []}
    rows = spark.createDataFrame(list(cases.items()), "t string, want array<string>").select("want", P.pre_tokenize("t").alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    odd = ["".join(random.Random(k).choice("aé1 \n\r\t\x85\xa0'sſ!🎉́٣") for _ in range(30)) for k in range(300)]
    assert corpus(spark, odd).where(F.array_join(P.pre_tokenize("text"), "") != F.col("text")).count() == 0
    assert spark.createDataFrame([("é",)], "t string").select(P.text_bytes("t")).first()[0] == [195, 169]


def test_cleaning(spark):
    import html
    import unicodedata

    def reference(t, form="NFC", n=2):
        if not t:
            return t
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", unicodedata.normalize(form, html.unescape(t)))
        t = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n"))
        return re.sub("\n{%d,}" % (n + 1), "\n" * n, t).strip()

    texts = [r[1] for r in Q.MARKED] + ["a &amp;amp; b &nbsp;", "ﬁ Å é", "&lt;p&gt;\n\n\n\n&#10;x"]
    for form, n in (("NFC", 2), ("NFKD", 0), ("NFD", 1)):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.preprocess("t", form, most_newlines=n).alias("x")).collect()
        assert {r.k: r.x for r in rows} == {k: reference(t, form, n) for k, t in enumerate(texts)}
    with pytest.raises(ValueError):
        X.normalize_unicode("t", "NFX")
    raw = spark.createDataFrame([("see http://a.b x@y.z, [1] ok",)], "t string").select(X.preprocess_wiki("t")).first()[0]
    assert raw == "see ok"


def test_preprocess_covers_all_documents(spark, tmp_path):
    import html
    import unicodedata

    texts = ["a &amp;amp; b &nbsp;", "&lt;p&gt;\n\n\n\n&#10;x", "e&#x301; &bogus; &", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.QUERIES["preprocess_text"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + len(Q.MARKED)
    for r in rows:
        t = texts[r.id - 1000] if r.id >= 1000 else dict(Q.MARKED)[r.id]
        if t:
            t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", unicodedata.normalize("NFC", html.unescape(t)))
            t = re.sub("\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n"))).strip()
        assert r.clean == t


def test_wikitext(spark):
    cases = {
        "a {{t|{{u}}|x}} b": "a b", "x<ref name='q'>c [[d]]</ref>y<ref name=z />z": "xyz", "{| class=w\n| a {{b}}\n|}t": "t", "[[A|b]] [[C]] [[File:x.png|thumb|[[Y]] z]]w": "b C w", "'''b''' ''i''": "b i",
        "== H ==\nt": "H\nt", "[http://e.org lab] [http://e.org]": "lab", "<gallery>\nx\n</gallery>a<!-- c -->b &amp; c": "ab & c", "open {{ never": "open {{ never", "<b>x</b>": "x", "]] }} |}": "]] }} |}",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", K.clean("t").alias("x")).collect()
    assert {r.t: r.x for r in got} == cases


@pytest.mark.parametrize("suffix", [".xml", ".xml.bz2"])
def test_dumps(spark, tmp_path, suffix):
    pages = "".join(f"<page><title>T{k}</title><ns>{k % 3}</ns><id>{k}</id><revision><text bytes='9' xml:space='preserve'>Body {k} &lt;b&gt;it&lt;/b&gt; {'word ' * 120}</text></revision></page>\n" for k in range(30))
    xml = f"<mediawiki xmlns='http://www.mediawiki.org/xml/export-0.11/'><siteinfo/>{pages}</mediawiki>"
    file = tmp_path / f"dump{suffix}"
    file.write_bytes(bz2.compress(xml.encode()) if suffix.endswith("bz2") else xml.encode())
    assert wiki.read_pages(spark, str(file)).count() == 30
    rows = wiki.read_articles(spark, str(file)).collect()
    assert sorted(r.title for r in rows) == sorted(f"T{k}" for k in range(0, 30, 3)) and all(r.text.startswith(f"Body {r.title[1:]} it word") for r in rows)
    assert wiki.read_articles(spark, str(file), max_articles=4).count() == 4 and wiki.read_articles(spark, str(file), min_length=5000).count() == 0


def test_download(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<page>one</page>")
    place = wiki.download(spark, f"file://{tmp_path}/d.xml", f"file://{tmp_path}/into/it")
    assert place.endswith("/into/it/d.xml") and (tmp_path / "into/it/d.xml").read_text() == "<page>one</page>"
    (tmp_path / "d.xml").write_text("other")
    assert wiki.download(spark, f"file://{tmp_path}/d.xml", f"file://{tmp_path}/into/it") == place and "one" in (tmp_path / "into/it/d.xml").read_text()
    assert sorted(p.name for p in (tmp_path / "into/it").iterdir() if not p.name.endswith(".crc")) == ["d.xml"]
    with pytest.raises(Exception, match="gone"):
        wiki.download(spark, f"file://{tmp_path}/gone.xml", f"file://{tmp_path}/into")


def test_downloads_over_http(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "web").mkdir()
    (tmp_path / "web/dump.xml").write_text("<page>by http</page>" * 500)
    quiet = type("Quiet", (SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(quiet, directory=str(tmp_path / "web")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        place = wiki.download(spark, f"http://127.0.0.1:{server.server_port}/dump.xml", f"file://{tmp_path}/got")
    finally:
        server.shutdown()
    assert (tmp_path / "got/dump.xml").read_text() == "<page>by http</page>" * 500 and place.endswith("got/dump.xml")


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text(" one \n\n two\n")
    (tmp_path / "c" / "b.txt").write_text(" \n")
    (tmp_path / "c" / "x.md").write_text("no")
    assert [r.text for r in files.read_corpus(spark, str(tmp_path / "c")).collect()] == [" one \n\n two\n"]
    assert sorted(r.text for r in files.read_corpus(spark, str(tmp_path / "c" / "a.txt")).collect()) == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, str(tmp_path / "none"))
    assert files.from_strings(spark, ["a", None]).count() == 2


def test_sql_functions(spark, tokenizer):
    register(spark, tokenizer.vocab)
    corpus(spark, [*TEXTS, None]).createOrReplaceTempView("sql_texts")
    rows = spark.sql("select text, pre_tokenize(text) as p, bpe_decode(bpe_encode(text)) as d, strip_text(text) as s, clean_control(text) as c from sql_texts").collect()
    assert all(r.d == (r.text or "") and "".join(r.p) == (r.text or "") for r in rows)
    assert all(r.s == r.text.strip() for r in rows if r.text is not None)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("\n".join(SENTENCES * 20))
    model = str(tmp_path / "model")
    assert main(["train", str(tmp_path / "in.txt"), model, "--vocab-size", "280"]) == 0 and Vocabulary.load(model).num_merges == 24
    assert main(["encode", model, str(tmp_path / "in.txt"), str(tmp_path / "ids")]) == 0 and spark.read.parquet(str(tmp_path / "ids")).count() == 80
    capsys.readouterr()
    assert main(["bench", model]) == 0 and json.loads(capsys.readouterr().out)["roundtrip_errors"] == 0
    assert main(["train", str(tmp_path / "gone"), model]) == 1


def test_report(spark, tokenizer):
    texts = files.benchmark_texts(spark)
    found = report.totals(texts, tokenizer.vocab).first()
    assert found.roundtrip_errors == 0 and found.total_chars == sum(map(len, files.BENCHMARK_TEXTS))
    own = report.benchmark(texts, tokenizer.vocab, "own", iterations=2)
    other = report.benchmark(texts, Vocabulary(), "bytes")
    assert own["total_tokens"] == 2 * found.total_tokens and own["throughput_chars"] > 0 and own["name"] == "own"
    assert report.compare(own | {"total_tokens": found.total_tokens}, other)["token_efficiency"] > 1


def test_streams(spark, tokenizer, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    df.select("text", F.timestamp_seconds(F.col("conv_id") * 60).alias("at")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, max_files=1)

    def drain(frame, mode, name):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    counted = drain(streams.running_word_counts(stream), "complete", "words_now")
    assert counted.exceptAll(P.word_counts(df)).isEmpty() and counted.count() == P.word_counts(df).count()
    coded = drain(streams.clean_and_encode(stream, tokenizer.vocab), "append", "coded_now")
    assert coded.count() == df.count() and codec.decode(coded, tokenizer.vocab).where("decoded <> text").isEmpty()
    assert drain(streams.windowed_word_counts(stream, "at", "10 minutes", "1 minute"), "update", "windows_now").count() > 0


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_against_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(cols).collect()]
    if name not in Q.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(f"select {', '.join(cols)} from ({Q.SQL[name]})")
    key = lambda rows: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(want.columns) == cols and key(got) == key(want.fetchall())


def test_written_frames_go_with_their_scope(spark):
    df = spark.range(5)
    before = len(runtime._OPEN.get())
    with runtime.temporary(spark) as outer:
        with runtime.temporary(spark) as inner:
            a, b, c = (runtime.written(df, name) for name in "abc")
            inner.keep(a, b)
        assert files.exists(spark, a._lexmill_path)[0] and not files.exists(spark, c._lexmill_path)[0]
        outer.keep(b)
    assert b.count() == 5 and not files.exists(spark, a._lexmill_path)[0] and len(runtime._OPEN.get()) == before
    with pytest.raises(KeyError), runtime.temporary(spark):
        d = runtime.written(df, "d")
        raise KeyError
    assert not files.exists(spark, d._lexmill_path)[0]


def test_words_are_joined_once_a_chunk(spark, monkeypatch):
    """Chunks of any size, rows that are chunks of their own, rows that repeat, null and empty texts, further columns: the ids of mode map; a word goes to a chunk once, not to each of its places."""
    texts = ["the cat the cat the", None, "", "on the mat " * 400, "é́ ß the", "\x00 the", "in the rain in spain", " "] * 6
    docs = spark.createDataFrame([(k % 5, {"a": k % 3}, t) for k, t in enumerate(texts)], "doc_id int, more map<string,int>, text string")
    vocab = Vocabulary.of_merges([(116, 104), (256, 101), (32, 257), (105, 110)])
    for size in (1, 60, 4 << 20):
        monkeypatch.setattr(codec, "CHUNK_BYTES", size)
        for specials in (False, True):
            found = codec.encode(docs, vocab, mode="join", specials=specials)
            assert found.columns == ["doc_id", "more", "text", "ids"]
            assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, codec.encode(docs, vocab, specials=specials).collect()), key=str)
    none = codec.encode(docs.limit(0), vocab, mode="join")
    assert none.collect() == []
    kept = {}
    monkeypatch.setattr(codec, "written", lambda df, name: kept.setdefault(name, df.cache()))
    codec.encode(docs.coalesce(1), vocab, mode="join").collect()
    long_rows = 6
    words = {w for t in texts for w in ("" if not t or len(t) > 1000 else t).split()}
    assert kept["chunk-words"].where("own = ' the'").count() <= 1 + long_rows and len(words) > 5


def test_exact_visits_look_at_neighbours_alone():
    """True counts after each merge against counting anew; a merge in a very long word costs what it changes, not the word's pairs in Python."""
    import random
    import time
    from collections import Counter

    rng = random.Random(6)
    words = [("".join(rng.choice("aab") for _ in range(rng.randrange(1, 14))).encode(), rng.randrange(1, 9)) for _ in range(80)]
    learner = train.Learner(words, "exact")
    for new in range(256, 290):
        if (pair := learner.best(1)) is None:
            break
        learner.merge(pair, new)
        anew = Counter()
        for own, freq in zip(learner.tokens, learner.freq):
            for i in range(len(own) - 1):
                anew[own[i : i + 2]] += freq
        assert anew == {p: n for p, n in learner.count.items() if n}
    long = bytes(rng.choice(b"abcdefgh") for _ in range(300_000)) + bytes(range(128, 256))
    learner = train.Learner([(long, 1)], "exact")
    start = time.process_time()
    for k in range(60):
        learner.merge(chr(128 + 2 * k) + chr(129 + 2 * k), 256 + k)
    assert time.process_time() - start < 1.5
