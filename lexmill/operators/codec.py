"""Encoding and decoding of text columns with a vocabulary, and the same for single strings."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.pretokens import pre_tokenize
from ..functions.text import column
from ..runtime import prepare, written
from .vocab import BOS, EOS, FIRST_MERGE, PAD, SPECIAL_TOKENS, Vocabulary

SHORT = 48
#: Words that joined_back sends to all workers, and the longest of them.
HOT_WORDS, HOT_LENGTH = 20_000, 100
#: Bytes of the texts that mode "join" encodes at a time, and how many times the usual length a row has that is encoded alone.
CHUNK_BYTES, LONG_ROW = 4 << 20, 8
CACHED = 300_000
#: Rules up to which a batch's words meet one rule after the other, all words at once; what stands between words there, which is no id.
FEW_RULES, BETWEEN = 256, chr(0x10FFFF)


def encode_word(word: bytes, ranks: dict) -> list[int]:
    """Merge the pair of the lowest priority, leftmost first, one at a time, until no pair has a rule."""
    ids = list(word)
    return _merge_short(ids, ranks) if len(ids) <= SHORT else _merge_long(ids, ranks)


def _merge_short(ids: list[int], ranks: dict) -> list[int]:
    while len(ids) > 1:
        rules = [ranks.get(p) for p in zip(ids, ids[1:])]
        found = [(rule[0], k, rule[1]) for k, rule in enumerate(rules) if rule]
        if not found:
            break
        _, k, new = min(found)
        ids[k : k + 2] = [new]
    return ids


def _merge_long(ids: list[int], ranks: dict) -> list[int]:
    """The same over a linked list and a heap: a long run costs n log n."""
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(k: int):
        if k >= 0 and (to := after[k]) >= 0 and (rule := ranks.get((ids[k], ids[to]))):
            heapq.heappush(heap, (rule[0], k, ids[k], ids[to], rule[1]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, k, left, right, new = heapq.heappop(heap)
        to = after[k]
        if not alive[k] or ids[k] != left or to < 0 or ids[to] != right:
            continue
        ids[k], alive[to], after[k] = new, False, after[to]
        if after[k] >= 0:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [x for x, ok in zip(ids, alive) if ok]


class WordCache(dict):
    def __init__(self, ranks: dict):
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        ids = encode_word(word.encode(), self.ranks)
        if len(self) >= CACHED:
            self.clear()
        self[word] = ids
        return ids


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "ids", specials: bool = False, mode: str = "map") -> DataFrame:
    """docs with a column out of ids (array<int>), for batch and streaming frames alike.

    Texts are cut into pre-tokens in the JVM. mode "map": each worker encodes the pre-tokens it meets,
    each once while its cache holds; no shuffle. mode "join" (batch frames): the
    distinct pre-tokens of the whole corpus are encoded once and joined back, which pays when rules are slow.
    specials: start and end marks around the ids. Null and empty texts have no ids, with specials too.
    """
    if mode == "join":
        return _encode_by_join(docs, vocab, text_col, out, specials)
    if mode != "map":
        raise ValueError("mode is map or join")
    prepare(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocab.ranks)

    @F.arrow_udf("array<int>")
    def run(parts):
        return _encode_lists(parts, known.value)

    return docs.withColumn(out, _wrapped(run(pre_tokenize(text_col)), F.col(text_col), specials))


_CACHES: dict[int, WordCache] = {}


def _in_turn(ranks: dict) -> bool:
    """Whether rules are few, and each uses only what rules before it make: then one after the other over a text is what the lowest first is over each word."""
    if len(ranks) > FEW_RULES:
        return False
    made = {new: k for k, new in ranks.values()}
    return len(made) == len(ranks) and all(new >= FIRST_MERGE and made.get(left, -1) < k and made.get(right, -1) < k for (left, right), (k, new) in ranks.items())


def _encoded_at_once(words: list[str], ranks: dict):
    """The ids of words one behind the other and each word's number of them, every rule in one pass over all words; for rules _in_turn."""
    import numpy as np

    held = BETWEEN.join(word.encode().decode("latin-1") for word in words) + BETWEEN
    for (left, right), (_, new) in sorted(ranks.items(), key=lambda rule: rule[1]):
        held = held.replace(chr(left) + chr(right), chr(new))
    flat = np.frombuffer(held.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    ends = np.flatnonzero(flat == ord(BETWEEN))
    return flat[flat != ord(BETWEEN)], np.diff(ends, prepend=-1) - 1


def _encode_lists(lists, ranks: dict):
    import numpy as np
    import pyarrow as pa

    # Each distinct word of a batch is encoded once; its places take its ids in columns.
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    if distinct and _in_turn(ranks):
        values, sizes = _encoded_at_once(distinct, ranks)
    else:
        if id(ranks) not in _CACHES:
            _CACHES.clear()
            _CACHES[id(ranks)] = WordCache(ranks)
        parts = [_CACHES[id(ranks)][word] for word in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        values = np.fromiter(chain.from_iterable(parts), np.int32, int(sizes.sum()))
    flat, ends = _gathered(words.indices.to_numpy(zero_copy_only=False), values, np.cumsum(sizes) - sizes, sizes)
    return pa.ListArray.from_arrays(pa.array(ends[_places(lists)].astype(np.int32)), pa.array(flat))


def _places(lists):
    """Where each of an array of lists begins in its flat values, and where the last ends; null lists are empty."""
    import numpy as np
    import pyarrow.compute as pc

    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _gathered(which, values, starts, sizes):
    """The stretches starts, sizes of values that which names, one behind the other, and where each begins and the last ends."""
    import numpy as np

    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((starts[which] - ends[:-1]).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


class TokenTable:
    """The bytes of tokens, for arrays of ids at once; unknown ids have none."""

    #: Ids up to here are places in a table.
    DENSE = 1 << 20

    def __init__(self, table: dict[int, bytes]):
        import numpy as np

        self.ids = np.array(sorted(table), dtype=np.int64)
        texts = [table[int(i)] for i in self.ids]
        # Last stands what is unknown.
        self.sizes = np.array([*map(len, texts), 0], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        top = int(self.ids[-1]) if len(self.ids) else 0
        self.place = None
        if top < self.DENSE and (not len(self.ids) or self.ids[0] >= 0):
            self.place = np.full(top + 2, len(self.ids), dtype=np.int64)
            self.place[self.ids] = np.arange(len(self.ids))

    def which(self, ids):
        import numpy as np

        if self.place is not None:
            return self.place[np.where((ids >= 0) & (ids < len(self.place)), ids, len(self.place) - 1)]
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, len(self.ids))

    def texts(self, lists):
        """An array of texts from one of lists of ids: null for null, U+FFFD for bytes that aren't UTF-8."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        data, ends = _gathered(self.which(ids), self.values, self.starts, self.sizes)
        offsets = ends[_places(lists)].astype(np.int32)
        # Where lists are null the text is, too.
        valid = None if not lists.null_count else pc.cast(pc.is_valid(lists), pa.uint8()).to_numpy(zero_copy_only=False)
        bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        raw = pa.Array.from_buffers(pa.binary(), len(lists), [bits, pa.py_buffer(offsets), pa.py_buffer(data)])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


#: Tables that a worker has made, by the broadcast they came from.
_TABLES: dict[int, TokenTable] = {}


def token_texts(lists, table: dict[int, bytes]):
    if id(table) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(table)] = TokenTable(table)
    return _TABLES[id(table)].texts(lists)


def _wrapped(ids: Column, text: Column, specials: bool) -> Column:
    empty = F.array().cast("array<int>")
    if specials:
        ids = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    return F.when(text.isNull() | (text == ""), empty).otherwise(ids)


def _encode_by_join(docs: DataFrame, vocab: Vocabulary, text_col: str, out: str, specials: bool) -> DataFrame:
    """Rows lie in chunks of neighbours. Each chunk asks once for each of its words, so that a word is shuffled once a chunk and not once a place."""
    spark = docs.sparkSession
    prepare(spark)
    known = spark.sparkContext.broadcast(vocab.ranks)

    @F.arrow_udf("array<int>")
    def run(words):
        import numpy as np
        import pyarrow as pa

        return _encode_lists(pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32)), words), known.value)

    # Rows are told apart by a number of their own, which a written frame keeps: ids may repeat.
    base = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    length = F.coalesce(F.octet_length(text_col), F.lit(0))
    usual = max(1, int(base.agg(F.avg(length)).first()[0] or 0))
    # Numbers of a partition begin at a multiple of 1 << 33; a row much longer than usual is a chunk of its own.
    near = F.floor(F.col("__row") / F.lit(max(1, CHUNK_BYTES // usual))).cast("long") * 2
    chunk = F.when(length > LONG_ROW * usual, F.col("__row") * 2 + 1).otherwise(near)
    asked = base.select(chunk.alias("__chunk"), F.explode(pre_tokenize(text_col)).alias("own")).distinct()
    asked = written(asked, "chunk-words")
    parts = written(asked.select("own").distinct().select("own", run("own").alias("part")), "encoded-words")
    rows = base.withColumn("__chunk", chunk).drop("__row").repartition("__chunk").withColumn("__words", pre_tokenize(text_col))
    schema = StructType([*docs.schema.fields, StructField("__ids", ArrayType(IntegerType()))])
    found = rows.groupBy("__chunk").cogroup(asked.join(parts, "own").groupBy("__chunk")).applyInArrow(_chunk_encoded, schema)
    return found.withColumn(out, _wrapped(F.col("__ids"), F.col(text_col), specials)).drop("__ids")


def _chunk_encoded(rows, parts):
    """The rows of a chunk with __ids in place of __words and __chunk; parts: own, part of all their words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists, own, part = rows.column("__words").combine_chunks(), parts.column("own").combine_chunks(), parts.column("part").combine_chunks()
    starts = _places(part)
    which = pc.index_in(lists.flatten(), value_set=own).to_numpy(zero_copy_only=False)
    flat, ends = _gathered(which, part.flatten().to_numpy(zero_copy_only=False), starts[:-1], np.diff(starts))
    ids = pa.ListArray.from_arrays(pa.array(ends[_places(lists)].astype(np.int32)), pa.array(flat.astype(np.int32)))
    return rows.drop_columns(["__words", "__chunk"]).append_column("__ids", ids)


def held(table: DataFrame, key: str, value: str) -> Callable[[Column], Column]:
    """The value of a key in table, null for others, as an expression that may stand within others; each key once, of a table of bounded size.

    The table goes through the driver into the plan, as an array of small maps found by the key's hash: no map is searched for long.
    """
    size = max(HOT_WORDS, 1)
    place = lambda c: F.pmod(F.hash(c), F.lit(size))
    cells: list[dict | None] = [None] * size
    for row in table.select(place(F.col(key)).alias("at"), F.col(key).alias("key"), F.to_json(F.struct(F.col(value).alias("x"))).alias("value")).collect():
        cells[row.at] = {**(cells[row.at] or {}), row.key: json.loads(row.value)["x"]}
    maps = F.from_json(F.lit(json.dumps(cells)), f"array<map<string,{table.schema[value].dataType.simpleString()}>>")
    return lambda c: F.element_at(F.element_at(maps, place(c) + 1), c)


def frequent(table: DataFrame) -> Callable[[Column], Column]:
    """The ids of a word if it is among the most frequent of table (pre_token, freq, part), else null, as an expression.

    The words are those above a frequency that HOT_WORDS words of up to HOT_LENGTH characters pass at most.
    """
    step = F.floor(F.log2("freq") * 8)
    short = table.where(F.length("pre_token") <= HOT_LENGTH)
    total, least = 0, None
    for row in short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += row.n
        if total > HOT_WORDS:
            break
        least = row.step
    if least is None:
        return lambda word: F.lit(None).cast("array<int>")
    return held(short.where(step >= least), "pre_token", "part")


def joined_back(base: DataFrame, table: DataFrame, text_col: str, out: str, specials: bool) -> DataFrame:
    """base (numbered by __row) without __row and with out, the ids of its words in order; table: pre_token, freq, part of all words.

    The frequent words' ids are looked up where the rows are. Only the other words' places are shuffled, to the words and back to their rows.
    """
    known = frequent(table)
    words = pre_tokenize(text_col)
    rare = F.filter(F.transform(words, lambda w, k: F.struct(k.alias("pos"), w.alias("own"))), lambda x: known(x["own"]).isNull())
    met = base.select(F.col("__row").alias("__own"), F.inline(rare)).join(table.select(F.col("pre_token").alias("own"), "part"), "own")
    met = met.groupBy("__own").agg(F.collect_list(F.struct("pos", "part")).alias("__rare"))
    here = F.filter(F.transform(words, lambda w, k: F.struct(k.alias("pos"), known(w).alias("part"))), lambda x: x["part"].isNotNull())
    parts = F.when(F.col("__rare").isNull(), here).otherwise(F.sort_array(F.concat(here, F.coalesce("__rare", F.array()))))
    joined = base.join(met, F.col("__row") == F.col("__own"), "left")
    return joined.withColumn(out, _wrapped(F.flatten(F.transform(parts, lambda x: x["part"])), F.col(text_col), specials)).drop("__row", "__own", "__rare")


def token_bytes_column(ids: Column | str, vocab: Vocabulary, skip_special: bool = True) -> Column:
    """The bytes of an array of ids, within the JVM; unknown ids are left out. For vocabularies of a few thousand tokens.

    Tokens up to the last of a learned vocabulary lie in an array at their ids; only what lies beyond (special ones) is searched.
    """
    table = {i: b for i, b in vocab.token_bytes.items() if i not in SPECIAL_TOKENS.values()} | {i: b"" if skip_special else t.encode() for t, i in SPECIAL_TOKENS.items()}
    dense = FIRST_MERGE + 2 * len(table)
    cells = F.array(*(F.lit(table.get(i, b"").hex()) for i in range(dense)))
    shown = {i: b for i, b in table.items() if b and not 0 <= i < dense}

    def found(i: Column) -> Column:
        far = F.lit("")
        for own, b in shown.items():
            far = F.when(i == own, b.hex()).otherwise(far)
        return F.coalesce(F.get(cells, i), far)

    return F.unhex(F.array_join(F.transform(column(ids), found), ""))


def decode(rows: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out: str = "decoded", skip_special: bool = True, jvm_tokens: int = 0) -> DataFrame:
    """rows with a column out of text. Unknown ids are left out, special ones too unless skip_special is off; bytes that
    aren't UTF-8 become U+FFFD. Null ids give null.

    Tokens are sent to the workers, which decode a batch at once; a vocabulary of up to jvm_tokens tokens becomes part of the plan, without a worker but slower.
    """
    if len(vocab.token_bytes) <= jvm_tokens:
        return rows.withColumn(out, F.make_valid_utf8(token_bytes_column(ids_col, vocab, skip_special).cast("string")))
    prepare(rows.sparkSession)
    table = {**vocab.token_bytes, **{i: b"" if skip_special else t.encode() for t, i in SPECIAL_TOKENS.items()}}
    known = rows.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("string")
    def run(lists):
        return token_texts(lists, known.value)

    return rows.withColumn(out, run(F.col(ids_col)))


class Tokenizer:
    """A vocabulary with what goes with it: columns by encode and decode, plain lists by the _batch methods."""

    eos_token_id, bos_token_id, pad_token_id = EOS, BOS, PAD

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    @classmethod
    def from_pretrained(cls, path: str) -> Tokenizer:
        """From a folder of Vocabulary.save; models are not downloaded."""
        return cls(Vocabulary.load(path))

    @property
    def vocab_size(self) -> int:
        return self.vocab.vocab_size

    def __len__(self) -> int:
        return self.vocab_size

    def __repr__(self) -> str:
        return f"Tokenizer(vocab_size={self.vocab_size}, num_merges={self.vocab.num_merges})"

    def get_vocab(self) -> dict[str, int]:
        return self.vocab.get_vocab()

    def encode(self, docs: DataFrame, **options) -> DataFrame:
        return encode(docs, self.vocab, **options)

    def decode(self, rows: DataFrame, **options) -> DataFrame:
        return decode(rows, self.vocab, **options)

    def encode_batch(self, spark: SparkSession, texts: list[str | None], specials: bool = False) -> list[list[int]]:
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
        return [r.ids for r in encode(rows, self.vocab, specials=specials).orderBy("k").collect()]

    def encode_text(self, spark: SparkSession, text: str | None, specials: bool = False) -> list[int]:
        return self.encode_batch(spark, [text], specials)[0]

    def decode_ids(self, spark: SparkSession, ids: list[int], skip_special: bool = True) -> str:
        return self.decode_batch(spark, [ids], skip_special)[0]

    def decode_batch(self, spark: SparkSession, ids: list[list[int]], skip_special: bool = True) -> list[str]:
        rows = spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>")
        return [r.decoded for r in decode(rows, self.vocab, skip_special=skip_special).orderBy("k").collect()]
