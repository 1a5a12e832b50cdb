"""Secrets in texts, by patterns and by entropy, with DataFrame operations alone.

Patterns find what names itself: assignments, access keys, long hexadecimal strings. What doesn't is a long run of
characters that tokens are made of, with much entropy: a window slides over each such candidate, and the counts of
its characters and of their kinds are kept up by what enters and what leaves. A window's entropy must reach the
threshold of its character class. Candidates that an allow-list knows are left alone.

Matches' places come from the lengths of what lies between them, so one projection reads the texts and only
lengths and matches go on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import temporary, written

#: The patterns of the base kinds, in the order in which spans that start together are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
#: Characters of an assigned value and of an access key at least.
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Candidates: runs of WINDOW characters at least. BASE is what the base kinds name already.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"""
#: Least entropy of a window, in bits a character, by the class of its characters.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base36": 3.5, "entropy_base64": 3.8}
KINDS = (*PATTERNS, *THRESHOLDS)
#: Candidates that are no secrets: universally unique ids; words and short numbers joined by signs; examples; runs of the keyboard or the alphabet; beginnings of embedded pictures.
ALLOWED = (
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
    r"^[+/_=-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[+/_=-]*$",
    r"(?i:example|sample|dummy|placeholder|changeme|your_|xxxx|0123456789|abcdefgh|qwertyui)",
    r"iVBORw0KGgo|R0lGOD|/9j/4AAQ",
)

#: Entropies are compared as whole numbers: a window of counts c has log2 WINDOW less the sum of c log2 c by WINDOW.
UNIT = 1 << 32
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
MOST = {kind: math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT) for kind, bits in THRESHOLDS.items()}
#: Characters count from "+" to "z"; their kinds.
FIRST, LAST = ord("+"), ord("z")
DIGIT, LOWER_HEX, LOWER, UPPER_HEX, UPPER, SIGN = range(6)


def kind_of(c: str) -> int:
    if c.isdigit():
        return DIGIT
    if not c.isalpha():
        return SIGN
    return (LOWER_HEX if c <= "f" else LOWER) if c.islower() else UPPER_HEX if c <= "F" else UPPER


KIND_OF = [kind_of(chr(k)) for k in range(FIRST, LAST + 1)]


def passes(kinds: Column, total: Column) -> dict[str, Column]:
    """Whether a window is one of each class and has the entropy that it asks for. kinds: how many characters of each kind; total: the sum of TERMS."""
    n = [F.get(kinds, F.lit(k)) for k in range(6)]
    digits, lower, upper = n[DIGIT], n[LOWER] + n[LOWER_HEX], n[UPPER] + n[UPPER_HEX]
    is_hex = (digits > 0) & (n[LOWER_HEX] + n[UPPER_HEX] > 0) & (n[LOWER] + n[UPPER] + n[SIGN] == 0)
    is_36 = ~is_hex & (digits >= 3) & (n[SIGN] == 0) & ((lower == 0) != (upper == 0))
    is_64 = ~is_hex & (digits > 0) & (lower > 0) & (upper > 0)
    return {k: c & (total <= MOST[k]) for k, c in zip(THRESHOLDS, (is_hex, is_36, is_64))}


def entropy_class(candidate: Column) -> Column:
    """The first class of which a window of the candidate has the entropy, null if none."""
    names = list(THRESHOLDS)
    terms, kind_of_code = F.array(*map(F.lit, TERMS)), F.array(*map(F.lit, KIND_OF))
    zeros = lambda n: F.array_repeat(F.lit(0), n)

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            # The window that ended before is judged, then one character enters and one may leave.
            came, gone = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1)
            of_came, of_gone = F.get(kind_of_code, came), F.when(gone >= 0, F.get(kind_of_code, gone)).otherwise(-1)
            left = F.get(state["counts"], gone)
            had = F.get(state["counts"], came) - (came == gone).cast("int")
            total = state["total"] + F.get(terms, had + 1) - F.get(terms, had)
            total = F.when(gone >= 0, total + F.get(terms, left - 1) - F.get(terms, left)).otherwise(total)
            moved = lambda counts, a, b: F.transform(counts, lambda c, k: c + (k == a).cast("int") - (k == b).cast("int"))
            found = judged(state, i)
            return F.struct(moved(state["counts"], came, gone).alias("counts"), moved(state["kinds"], of_came, of_gone).alias("kinds"), total.alias("total"), *(found[k].alias(k) for k in names))

        def judged(state: Column, size: Column) -> dict[str, Column]:
            return {k: state[k] | ((size >= WINDOW) & ok) for k, ok in passes(state["kinds"], state["total"]).items()}

        def last(state: Column) -> Column:
            found = judged(state, F.size(codes))
            return F.coalesce(*(F.when(found[k], F.lit(k)) for k in names))

        start = F.struct(zeros(LAST - FIRST + 1).alias("counts"), zeros(6).alias("kinds"), F.lit(0).cast("long").alias("total"), *(F.lit(False).alias(k) for k in names))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, last)

    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST)
    # Within a lambda the codes are worked out once, not for each step.
    return F.get(F.transform(F.array(F.filter(codes, lambda c: c >= 0)), slide), F.lit(0))


def cuts(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order, each with the length of what lies between it and the one before; null if there is none."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["match"].isNotNull()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    A span is kind:start:end in code points, end exclusive; spans are listed by start, then kind (see KINDS), with
    commas. Base kinds: an assignment with a value of LEAST_VALUE characters at least, an access key of LEAST_ACCESS, a run of
    24 hexadecimal digits, the leftmost that don't overlap of each kind. n_ counts and base_sha256 (of their
    spans) are of these. Entropy adds whole candidates: runs of WINDOW characters at least outside of base matches and
    without any within them, of which a window reaches its class's threshold and which no expression of ALLOWED or allow finds.

    A null text is empty; a text without secrets has the counts 0 and the spans "". Repeated rows and
    rows of null id are scanned alike; whole texts of any length are read; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = [*PATTERNS.values(), f"{BASE}|{CANDIDATE}"]
    with temporary(docs.sparkSession) as scope:
        found = docs.select(F.col(id_col).alias("doc_id"), *(cuts(text, p).alias(f"cuts{k}") for k, p in enumerate(patterns)))
        found = written(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
        scope.keep(found)
    groups = F.filter(F.array(*(F.struct(F.lit(k).alias("group"), F.col(f"cuts{k}").alias("cuts")) for k in range(len(patterns)))), lambda g: g["cuts"].isNotNull())
    some = found.select("doc_id", "row", groups.alias("groups")).where(F.size("groups") > 0)
    each = some.select("doc_id", "row", F.explode("groups").alias("g")).select("doc_id", "row", "g.group", F.posexplode("g.cuts").alias("pos", "cut"))
    so_far = Window.partitionBy("row", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("doc_id", "row", "group", F.col("cut.match").alias("match"), F.sum(F.col("cut.gap") + F.length("cut.match")).over(so_far).alias("end"))
    allowed = F.lit(False)
    for p in (BASE, *ALLOWED, *allow):
        allowed |= F.col("match").rlike(p)
    kind = (
        F.when(F.col("group") == 0, F.when(F.length(F.regexp_extract("match", PATTERNS["assign"], 1)) >= LEAST_VALUE, "assign"))
        .when(F.col("group") == 1, F.when(F.length("match") >= LEAST_ACCESS, "access"))
        .when(F.col("group") == 2, "hex")
        .otherwise(F.when(~allowed, entropy_class(F.col("match"))))
    )
    each = each.select("doc_id", "row", kind.alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", place, F.concat_ws(":", "kind", "start", "end").alias("span")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS]
    told = each.groupBy("row", "doc_id").agg(*counts, F.array_sort(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["place"] <= len(PATTERNS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: s["span"]), ",")
    names = [f"n_{k}" for k in PATTERNS]
    told = told.select("doc_id", *names, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
    none = found.where(F.coalesce(*(F.col(f"cuts{k}.gap") for k in range(len(patterns)))).isNull())
    none = none.select("doc_id", *(F.lit(0).cast("long").alias(n) for n in names), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return told.unionByName(none)
