"""Encoding and decoding by vocabularies that are frames: no Python worker, and no table in the driver beyond a set size.

A rule is a row of priority, l, r, new_token, as Vocabulary.merges_frame or a saved table has it. Ids are
held as characters of a string (glyphs), so that the JVM's own replace merges a pair all over a word in one pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pretokens import pre_tokenize, word_counts
from ..functions.text import column
from ..runtime import remove, temporary, written
from .codec import BETWEEN, FEW_RULES, _in_turn, _wrapped, held, joined_back
from .vocab import FIRST_MERGE

#: Rules that a vocabulary may have: their ids lie between the bytes' and the special tokens'.
MOST_RULES = 300_001 - FIRST_MERGE
#: Code points from here on are moved by so many, past those that no text may hold.
HOLE, MOVED = 0xD800, 0x800
#: A priority that no rule has.
NEVER = (1 << 31) - 1
#: Rules up to which words look theirs up where they are; more of them are joined with the words' pairs.
HELD_RULES = 20_000
#: Tokens up to which decoding looks them up where the ids are.
HELD_TOKENS = 20_000
#: Bytes of tokens that decoding sends to all workers; a larger table is joined by id, each id's rows dealt over SALTS.
SENT_BYTES, SALTS = 32 << 20, 16


def glyph(token_id: Column | str) -> Column:
    """The character that stands for an id."""
    c = column(token_id)
    point = c + F.when(c >= HOLE, MOVED).otherwise(0)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def token_of(char: Column | str) -> Column:
    """The id that a character stands for."""
    point = F.ascii(column(char))
    return (point - F.when(point >= HOLE + MOVED, MOVED).otherwise(0)).cast("int")


def glyphs(c: Column | str) -> Column:
    """The characters of a string."""
    return F.regexp_extract_all(column(c), F.lit("(?s)."), F.lit(0))


def checked(rules: DataFrame) -> DataFrame:
    """rules, written once, if they are a vocabulary's: ids unique and above the bytes', both sides bytes or made by a rule before. ValueError otherwise."""
    rules = written(rules.select(*(F.col(c).cast("int") for c in ("priority", "l", "r", "new_token"))), "rules")
    size = rules.agg(
        F.count("*").alias("n"), F.count_distinct("new_token").alias("ids"), F.count_distinct("priority").alias("priorities"),
        F.coalesce(F.bool_and((F.col("new_token") >= FIRST_MERGE) & (F.col("l") >= 0) & (F.col("r") >= 0)), F.lit(True)).alias("within"),
    ).first()
    if size.n > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not size.n == size.ids == size.priorities or not size.within:
        raise ValueError("a rule lacks an id or a priority of its own")
    sides = rules.select("priority", F.explode(F.array("l", "r")).alias("side")).where(F.coalesce(F.col("side") >= FIRST_MERGE, F.lit(True)))
    made = rules.select(F.col("new_token").alias("side"), F.col("priority").alias("at"))
    early = sides.join(made, "side", "left").where(~F.coalesce(F.col("at") < F.col("priority"), F.lit(False)))
    if not early.isEmpty():
        raise ValueError("a rule uses a token that no rule before it makes")
    return rules


def token_bytes(rules: DataFrame) -> DataFrame:
    """token_id, bytes of the 256 bytes and of each rule's token, by pointer doubling.

    A token begins as its two sides; in each round every side becomes what it stands for by then, so a token
    that is d rules deep takes log2(d) rounds. No rules: the bytes. Rules that are no vocabulary's: ValueError.
    """
    spark = rules.sparkSession
    base = spark.range(FIRST_MERGE).select(F.col("id").cast("int").alias("token_id"), glyph("id").alias("s"))
    with temporary(spark) as scope:
        rules = checked(rules)
        state = written(rules.select(F.col("new_token").alias("token_id"), F.concat(glyph("l"), glyph("r")).alias("s")), "tokens")
        deep = F.col("s").rlike("[^\\u0000-\\u00ff]")
        while not state.where(deep).isEmpty():
            parts = state.where(deep).select("token_id", F.posexplode(glyphs("s")).alias("pos", "side"))
            known = state.select(glyph("token_id").alias("own"), F.col("s").alias("whole"))
            # A byte stands for itself: only what is deeper is looked up, so the commonest sides are not joined.
            inner = F.col("side").rlike("[^\\u0000-\\u00ff]")
            looked = parts.where(inner).join(known, F.col("side") == F.col("own")).select("token_id", "pos", "whole")
            pieces = looked.unionByName(parts.where(~inner).select("token_id", "pos", F.col("side").alias("whole")))
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "whole"))), lambda x: x["whole"]), "")
            after = written(pieces.groupBy("token_id").agg(joined.alias("s")).unionByName(state.where(~deep)), "tokens")
            scope.remove(state._lexmill_path)
            remove(spark, state._lexmill_path)
            state = after
        out = written(base.unionByName(state).select("token_id", F.encode("s", "ISO-8859-1").alias("bytes")), "token-bytes")
        scope.keep(out)
    return out


def encoded_words(words: DataFrame, rules: DataFrame) -> DataFrame:
    """words (pre_token, each once) with part, their ids (array<int>): the lowest priority first, leftmost first.

    In a round each word meets the rules of its pairs, and applies them by priority, up to the first that a token made
    in this round could come before: what uses a token is never before the first rule that has it as a side. The
    words that no rule fits any more leave. Rounds: as many as a word has rules that wait for another, at most; each is written.
    """
    spark = words.sparkSession
    with temporary(spark) as scope:
        rules = checked(rules)
        used = rules.select(F.explode(F.array("l", "r")).alias("side"), "priority").groupBy("side").agg(F.min("priority").alias("until"))
        last = rules.groupBy("l", "r").agg(F.max(F.struct("priority", "new_token")).alias("x")).select("l", "r", "x.*")
        table = last.join(used, F.col("new_token") == F.col("side"), "left").select(
            F.concat(glyph("l"), glyph("r")).alias("pair"), glyph("new_token").alias("new"), "priority", F.coalesce("until", F.lit(NEVER)).alias("until")
        )
        table = written(table.select("pair", F.struct("priority", "pair", "new", "until").alias("rule")), "pair-rules")
        known = held(table, "pair", "rule") if table.count() <= HELD_RULES else None
        # Bytes as characters. Numbers of their own, that a written frame keeps, stand for words while they are in rounds.
        state = written(words.select(F.monotonically_increasing_id().alias("k"), "pre_token", F.decode(F.encode("pre_token", "utf-8"), "ISO-8859-1").alias("s")), "glyph-words")
        done = []
        while True:
            chars = glyphs("s")
            n = F.greatest(F.size(chars) - 1, F.lit(0))
            pairs = F.array_distinct(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda l, r: F.concat(l, r)))
            if known:
                found = F.filter(F.transform(pairs, known), lambda x: x.isNotNull())
                seen = state.withColumn("found", F.when(F.size(found) > 0, F.sort_array(found)))
            else:
                # checked() bounds the rules, so that they may go to all workers.
                met = state.select("k", F.explode(pairs).alias("pair")).join(F.broadcast(table), "pair")
                seen = state.join(met.groupBy("k").agg(F.sort_array(F.collect_list("rule")).alias("found")), "k", "left")
            rounds = written(seen.select("k", "pre_token", _applied(F.col("s"), F.col("found")).alias("s"), F.col("found").isNotNull().alias("more")), "glyph-words")
            done.append(rounds.where("not more").select("pre_token", "s"))
            state = rounds.where("more").drop("more")
            if state.isEmpty():
                break
        out = done[0]
        for frame in done[1:]:
            out = out.unionByName(frame)
        out = written(out.select("pre_token", F.transform(glyphs("s"), token_of).alias("part")), "encoded-words")
        scope.keep(out)
    return out


def _applied(s: Column, found: Column) -> Column:
    """s after the rules found, in order, as long as none could have come between."""
    start = F.struct(s.alias("s"), F.lit(NEVER).alias("until"))

    def step(state, rule):
        now = F.replace(state["s"], rule["pair"], rule["new"])
        until = F.when(F.contains(state["s"], rule["pair"]), F.least(state["until"], rule["until"])).otherwise(state["until"])
        return F.when(rule["priority"] < state["until"], F.struct(now.alias("s"), until.alias("until"))).otherwise(state)

    return F.coalesce(F.aggregate(found, start, step)["s"], s)


def few_in_turn(rules: DataFrame) -> list[tuple[int, int, int]] | None:
    """l, r, new_token of rules in their order, if they are few and may meet a text one after the other (codec._in_turn); else None."""
    rows = rules.orderBy("priority").limit(FEW_RULES + 1).collect()
    ranks = {(r.l, r.r): (r.priority, r.new_token) for r in rows}
    if len(rows) > FEW_RULES or not _in_turn(ranks):
        return None
    return [(*pair, new) for pair, (_, new) in sorted(ranks.items(), key=lambda rule: rule[1])]


def _character(token_id: int) -> str:
    """glyph of one id."""
    return chr(token_id + MOVED if token_id >= HOLE else token_id)


def _in_place(text: Column | str, rules: list[tuple[int, int, int]]) -> Column:
    """The ids of a text, rule after rule over all its pre-tokens at once; what stands between these is no id."""
    words = F.transform(pre_tokenize(text), lambda w: F.decode(F.encode(w, "utf-8"), "ISO-8859-1"))
    s = F.array_join(words, BETWEEN)
    for left, right, new in rules:
        s = F.replace(s, F.lit(_character(left) + _character(right)), F.lit(_character(new)))
    # Splitting at nothing is quicker than a pattern; ids below the hole are what their characters are.
    near = all(new < HOLE for _, _, new in rules)
    return F.transform(F.split(F.replace(s, F.lit(BETWEEN), F.lit("")), ""), (lambda c: F.ascii(c)) if near else token_of)


def encode_by_rules(docs: DataFrame, rules: DataFrame, text_col: str = "text", out: str = "ids", specials: bool = False) -> DataFrame:
    """docs with a column out of ids (array<int>), as codec.encode gives with the same rules.

    All of it in the JVM: up to codec.FEW_RULES rules meet each text where it lies, one rule after the other, without a shuffle; where they are
    more each distinct pre-token is encoded once and joined back. Null and empty texts have no ids, with
    specials too; rows may repeat; no rules: bytes. Rules that are no vocabulary's: ValueError. A pre-token of
    n bytes that meets m rules costs n * m: runs of a million letters are better left to codec.encode.
    """
    with temporary(docs.sparkSession):
        few = few_in_turn(checked(rules))
    if few is not None:
        return docs.withColumn(out, _wrapped(_in_place(text_col, few), F.col(text_col), specials))
    base = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    with temporary(docs.sparkSession) as scope:
        counts = written(word_counts(base, text_col), "word-counts")
        parts = encoded_words(counts.select("pre_token"), rules)
        table = written(counts.join(parts, "pre_token"), "encoded-words")
        scope.keep(table)
    return joined_back(base, table, text_col, out, specials)


def _held_tokens(table: DataFrame) -> Callable[[Column], Column] | None:
    """The hex of an id in table (own, hex), null for others, as an expression; None if no array of a few cells a token holds each in a cell of its own."""
    import numpy as np

    tokens = {r.own: r.hex for r in table.where("own is not null").collect()}
    ids = np.array([*tokens, -1][: len(tokens) or 1], dtype=np.int64)
    size = len(ids)
    # The remainder of an id is its place. Ids that lie close together, and a few far ones, soon have places of their own.
    while len(np.unique(ids % size)) < len(ids):
        size += 1 + size // 20
        if size > 4 * len(ids) + 1024:
            return None
    cells: list[dict | None] = [None] * size
    for own, text in tokens.items():
        cells[own % size] = {"own": own, "hex": text}
    held_cells = F.from_json(F.lit(json.dumps(cells)), "array<struct<own:bigint,hex:string>>")

    def find(i: Column) -> Column:
        cell = F.get(held_cells, F.pmod(i, F.lit(size)).cast("int"))
        return F.when(cell["own"] == i, cell["hex"])

    return find


def decode_by_join(rows: DataFrame, tokens: DataFrame, ids_col: str = "ids", out: str = "decoded", skip_special: bool = True, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """rows with a column out of text, as codec.decode gives it, by a join with tokens: token_id, bytes and, if there are any, special.

    Of an id given twice the special one counts, then the one of the greater bytes. Unknown and null ids give nothing; null ids arrays
    give null, empty ones an empty text; bytes that aren't UTF-8 become U+FFFD. Tokens of up to sent_bytes go to all
    workers, measured: HELD_TOKENS of them at most within the plan, so that rows stay where they are, more by a join; beyond that rows and tokens are joined by id and salt, so that a frequent id is many tasks' work.
    """
    if "special" not in tokens.columns:
        tokens = tokens.withColumn("special", F.lit(False))
    best = tokens.groupBy("token_id").agg(F.max(F.struct("special", "bytes")).alias("x")).select(F.col("token_id").alias("own"), "x.*")
    table = written((best.where("not special") if skip_special else best).select("own", F.hex("bytes").alias("hex")), "token-bytes")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.length("hex") + 16), F.lit(0))).first()
    text_of = lambda parts: F.make_valid_utf8(F.unhex(F.array_join(parts, "")).cast("string"))
    if n <= HELD_TOKENS and size <= sent_bytes and (known := _held_tokens(table)):
        return rows.withColumn(out, F.when(F.col(ids_col).isNotNull(), text_of(F.transform(ids_col, known))))
    base = written(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    if size <= sent_bytes:
        # Rows move before they are taken apart, so that tokens needn't.
        flat = base.select("__row", ids_col).repartition("__row").select("__row", F.posexplode(ids_col).alias("pos", "id"))
        met = flat.join(F.broadcast(table), F.col("id") == F.col("own"))
    else:
        salted = table.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        flat = base.select("__row", F.posexplode(ids_col).alias("pos", "id"))
        met = flat.withColumn("salt", F.col("pos") % SALTS).join(salted, (F.col("id") == F.col("own")) & (F.col("salt") == F.col("own_salt")))
    whole = met.groupBy(F.col("__row").alias("__own")).agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    text = text_of(F.transform("parts", lambda x: x["hex"]))
    joined = base.join(whole.select("__own", text.alias("__text")), F.col("__row") == F.col("__own"), "left")
    return joined.withColumn(out, F.when(F.col(ids_col).isNotNull(), F.coalesce("__text", F.lit("")))).drop("__row", "__own", "__text")
