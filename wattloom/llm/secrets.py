"""Secrets in texts: three base patterns and windows of high entropy, as spans of code points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Kinds of spans, in the order in which spans of equal start are listed.
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
#: Harmless high-entropy strings.
ALLOWED = [
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    "(?i)example|sample|dummy|placeholder|changeme",
    "^[0-9_+/=-]+$",  # numbers, dates, rules
]
#: Without a digit a candidate is taken for words or a path, unless single small letters stand
#: between capitals at two places.
LETTERS = "^[A-Za-z_+/=-]+$"
MIXED = "[A-Z][a-z][A-Z](?:[a-z][A-Z]|.*[A-Z][a-z][A-Z])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WIDTH = 20
#: Class of characters -> bits per character from which a window counts as random.
LIMITS = {"hex": 2.9, "base64": 3.7}
_UNIT = 1_000_000


def matches(text: Column, pattern: str, found: Column | None = None) -> Column:
    """All leftmost matches that don't overlap, as (start, end, value) in code points.

    The text is split at the matches; the lengths of the gaps and of the matches before
    one add up to its start.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found
    pieces = let(F.struct(hits.alias("m"), F.split(text, pattern, -1).alias("g")), lambda x: F.aggregate(
        F.arrays_zip(x["m"].alias("m"), F.slice(x["g"], 1, F.size(x["m"])).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda a, p: let(a["at"] + F.length(p["g"]), lambda start: let(start + F.length(p["m"]), lambda end: F.struct(
            end.alias("at"),
            F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value"))).alias("out")))),
    )["out"])
    return pieces


def _cost(count: int) -> int:
    """count * log2(count) in millionths, so that sums are whole numbers."""
    return round(count * math.log2(count) * _UNIT) if count > 1 else 0


COSTS = [_cost(c) for c in range(WIDTH + 1)]


def most_cost(bits: float) -> int:
    """A window of WIDTH characters has at least ``bits`` per character iff the costs of
    its character counts add up to at most this."""
    return math.floor(WIDTH * (math.log2(WIDTH) - bits) * _UNIT)


def random_span(value: Column, limit: Column) -> Column:
    """(first, last): from the first window's start to the last window's end among the
    windows of WIDTH characters with entropy at or above the limit; null without one.

    The window slides one character at a time. The counts of its characters and the sum
    of their costs are kept, and only the leaving and the entering character change them.
    """
    alphabet, costs = F.lit(ALPHABET), F.array(*[F.lit(c).cast("long") for c in COSTS])
    code = lambda i: F.expr("0") + F.instr(alphabet, F.substring(value, i, F.lit(1))) - 1
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("cost"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(c: Column, a: Column, i: Column) -> Column:
        def change(x: Column) -> Column:
            goes = let(F.get(a["counts"], x["old"]), lambda n: F.get(c, n - 1) - F.get(c, n))
            had = F.get(a["counts"], x["new"]) - F.when(x["new"] == x["old"], 1).otherwise(0)
            comes = let(had, lambda n: F.get(c, n + 1) - F.get(c, n))
            counts = F.transform(a["counts"], lambda n, k: n + F.when(k == x["new"], 1).otherwise(0) - F.when(k == x["old"], 1).otherwise(0))
            cost = a["cost"] + comes + F.when(x["old"] >= 0, goes).otherwise(F.lit(0).cast("long"))
            return let(F.struct(counts.alias("counts"), cost.alias("cost")), lambda y: let(
                (i >= WIDTH) & (y["cost"] <= limit), lambda hit: F.struct(
                    y["counts"].alias("counts"), y["cost"].alias("cost"),
                    F.when(a["first"].isNull() & hit, i - WIDTH).otherwise(a["first"]).alias("first"),
                    F.when(hit, i).otherwise(a["last"]).alias("last"))))

        old = F.when(i > WIDTH, code(i - WIDTH)).otherwise(F.lit(-1))
        return let(F.struct(code(i).alias("new"), old.alias("old")), change)

    return let(costs, lambda c: F.aggregate(F.sequence(F.lit(1), F.length(value)), state, lambda a, i: step(c, a, i)))


def _entropy_spans(text: Column) -> Column:
    """Spans of random windows in the candidate strings of ``text`` that no allow-list entry names."""
    def of_candidate(m: Column) -> Column:
        is_hex = m["value"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        limit = F.when(is_hex, F.lit(most_cost(LIMITS["hex"]))).otherwise(F.lit(most_cost(LIMITS["base64"])))
        return let(random_span(m["value"], limit), lambda s: F.struct(
            (m["start"] + s["first"]).alias("start"),
            F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64")).alias("kind"),
            (m["start"] + s["last"]).alias("end")))

    def allowed(m: Column) -> Column:
        words = m["value"].rlike(LETTERS) & ~m["value"].rlike(MIXED)
        return F.greatest(words, *[m["value"].rlike(p) for p in ALLOWED])

    found = F.filter(matches(text, CANDIDATE), lambda m: ~allowed(m))
    return F.filter(F.transform(found, of_candidate), lambda s: s["start"].isNotNull())


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) by start and kind, kind a place in KINDS.

    ``base`` has the pattern matches, ``spans`` these and the entropy spans. With ``keep``
    the text comes along. Null and empty texts have none. Repeated rows have equal spans.
    """
    rows = pick(docs, doc_id=key, text=text).select("doc_id", F.col("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))
    return with_spans(rows, F.col("text")).select("doc_id", *(["raw"] if keep else []), "base", "spans")


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    kind = "array<struct<start:int,kind:int,end:int>>"
    none = F.array().cast(kind)
    low = F.lower(text)
    named = F.greatest(*[F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])

    def spans(if_any: Column, pattern: str, number: int, good=None) -> Column:
        found = matches(text, pattern)
        found = F.filter(found, good) if good else found
        return F.when(if_any, F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))).otherwise(none)

    long_value = lambda m: F.length(F.regexp_extract(m["value"], f"^{ASSIGN}$", 2)) >= 6
    base = F.concat(
        spans(named, ASSIGN, 0, long_value),
        spans(F.contains(text, F.lit("AKIA")), ACCESS, 1),
        spans(text.rlike(HEX), HEX, 2))
    random = F.when(text.rlike(CANDIDATE), _entropy_spans(text)).otherwise(none)
    found = rows.withColumn("base", F.sort_array(base))
    found = found.withColumn("spans", F.sort_array(F.concat("base", random.cast(kind))))
    return found


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every run of overlapping spans replaced by ``mask``."""
    return let(F.struct(text.alias("t"), F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("any")),
        lambda a, s: F.when(a["any"] & (s["start"] < a["at"]), F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"), F.lit(True).alias("any")),
        ).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out"),
            F.lit(True).alias("any"))),
    ).alias("a")), lambda x: F.concat(x["a"]["out"], F.substring(x["t"], x["a"]["at"] + 1, F.length(x["t"]))))


def without_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; the column ``length``, if there, counts the
    code points of the new text. Texts without spans and null texts stay as they are."""
    names = docs.columns
    plain = [f"_{i}" for i in range(len(names))]
    raw = docs.toDF(*plain)
    at = F.col(plain[names.index(text)])
    found = with_spans(raw, F.coalesce(at, F.lit("")))
    new = F.when(F.size("spans") > 0, redacted(at, F.col("spans"), mask)).otherwise(at)
    kept = found.select(*plain, new.alias("new"), (F.size("spans") > 0).alias("changed"))
    out = []
    for p, n, kind in zip(plain, names, (f.dataType for f in docs.schema.fields), strict=True):
        if p == plain[names.index(text)]:
            out.append(F.col("new").alias(n))
        elif n == length:
            out.append(F.when(F.col("changed"), F.length("new").cast(kind)).otherwise(F.col(p)).alias(n))
        else:
            out.append(F.col(p).alias(n))
    return kept.select(*out)
