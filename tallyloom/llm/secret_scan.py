"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Everything is built-in functions inside one projection per row: no shuffle, no
Python on the executors. A row is scanned whole; a text without a hit costs one
pass of each pattern.

Positions. Spark's regular expressions return matched strings, not positions.
``split`` with the same pattern returns what lies between the matches, so the
lengths of both, added up, are the positions (code points, end exclusive).

Entropy. A candidate is a maximal run of one character class. A window of
``window`` characters slides over it; counts per character are an array that each
step changes by one in and one out, and with it the sum ``T`` of ``c * log2(c)``.
The window's entropy is ``log2(window) - T / window``. ``T`` is kept in millionths
as a whole number, so that adding and removing leave no rounding behind. Windows at
or above the class's threshold merge into spans, unless the candidate matches the
allow-list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import text_or_empty

# The patterns and lengths of the contract, in the order of the kinds.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters and more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters and more

_MILLION = 1_000_000
_BLOCK = 512


@dataclass(frozen=True)
class CharClass:
    """A character class whose runs are candidates."""

    name: str
    alphabet: str
    pattern: str  # one character of the class, as a regular expression
    bits: float  # a window with at least this entropy is reported


DEFAULT_CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", "[0-9a-fA-F]", 3.0),
    CharClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        "[A-Za-z0-9+/_=-]",
        4.1,
    ),
)

# Candidates that look random and are not secrets: placeholders, ordered alphabets,
# identifiers in the 8-4-4-4-12 form, and strings without any digit.
DEFAULT_ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|x{8}",
    r"0123456789|(?i:abcdefghij)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
)


@dataclass(frozen=True)
class SecretScan:
    """``window`` characters per window; ``classes`` and ``allow`` as described above."""

    window: int = 24
    classes: tuple[CharClass, ...] = DEFAULT_CLASSES
    allow: tuple[str, ...] = DEFAULT_ALLOW
    kinds: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "kinds", ("assign", "access", "hex", *(c.name for c in self.classes)))


def _running_starts(lengths: Column) -> Column:
    """For lengths l0, l1, ...: 0, l0, l0 + l1, ...

    In blocks, since each step of an aggregation copies the array it builds.
    """

    def starts(values: Column) -> Column:
        step = F.aggregate(
            values,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
        )
        return step["out"]

    n = F.size(lengths)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(_BLOCK)), lambda i: F.slice(lengths, i + 1, _BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, starts(totals), lambda b, at: F.transform(starts(b), lambda s: s + at)))


def _matches(text: Column, pattern: str, least: Column | None = None) -> Column:
    """Array of (start, end, value) of all matches; NULL where there is none."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.slice(between, 1, F.size(found))
    lengths = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m))
    at = _running_starts(lengths)
    spans = F.zip_with(
        F.zip_with(at, pieces, lambda a, p: (a + F.length(p)).cast("int")),
        found,
        lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("value")),
    )
    return F.when(text.rlike(pattern), spans)


def _f_table(window: int) -> Column:
    """Millionths of c * log2(c) for c = 0 .. window, at positions 1 .. window + 1."""
    return F.array(*(F.lit(round(c * math.log2(c) * _MILLION) if c else 0).cast("long") for c in range(window + 1)))


def _entropy_spans(value: Column, cls: CharClass, window: int) -> Column:
    """Merged windows of one candidate as an array of (start, end) within it."""
    f = _f_table(window)
    # H >= bits  <=>  T <= window * (log2(window) - bits)
    most = math.floor(window * (math.log2(window) - cls.bits) * _MILLION)
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    init = F.struct(
        F.lit(0).alias("i"),
        F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"),
        F.lit(0).cast("long").alias("t"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"),
    )

    def step(acc: Column, pair: Column) -> Column:
        gone, new, i = pair["gone"], pair["new"], acc["i"] + 1
        # One out, then one in; code 0 stands for "nothing" while the window fills.
        was = F.element_at(acc["counts"], gone + 1)
        t = F.when(gone > 0, acc["t"] - F.element_at(f, was + 1) + F.element_at(f, was)).otherwise(acc["t"])
        counts = F.transform(acc["counts"], lambda c, j: F.when((j == gone) & (gone > 0), c - 1).otherwise(c))
        now = F.element_at(counts, new + 1)
        t2 = t - F.element_at(f, now + 1) + F.element_at(f, now + 2)
        counts = F.transform(counts, lambda c, j: F.when(j == new, c + 1).otherwise(c))
        hit = (i >= window) & (t2 <= most)
        joins = hit & (acc["end"] >= i - window)
        opens = hit & ~joins
        return F.struct(
            i.alias("i"),
            counts.alias("counts"),
            t2.alias("t"),
            F.when(opens, i - window).otherwise(acc["start"]).cast("int").alias("start"),
            F.when(hit, i).otherwise(acc["end"]).cast("int").alias("end"),
            F.when(opens & (acc["end"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"], acc["end"]))))
            .otherwise(acc["out"])
            .alias("out"),
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"], acc["end"]))
        return F.when(acc["end"] >= 0, F.concat(acc["out"], last)).otherwise(acc["out"])

    pad = F.array_repeat(F.lit(0), window)
    pairs = F.zip_with(
        F.slice(F.concat(pad, codes), 1, F.size(codes)),
        codes,
        lambda gone, new: F.struct(gone.cast("int").alias("gone"), new.cast("int").alias("new")),
    )
    return F.aggregate(pairs, init, step, finish)


def _entropy_matches(text: Column, cls: CharClass, scan: SecretScan) -> Column:
    """Merged windows of all candidates of one class as an array of (start, end)."""

    def not_allowed(m: Column) -> Column:
        suppressed = F.lit(False)
        for pattern in scan.allow:
            suppressed = suppressed | m["value"].rlike(pattern)
        return ~suppressed

    def windows(m: Column) -> Column:
        return F.transform(
            _entropy_spans(m["value"], cls, scan.window),
            lambda w: F.struct((m["start"] + w["start"]).alias("start"), (m["start"] + w["end"]).alias("end")),
        )

    candidates = F.filter(_matches(text, f"{cls.pattern}{{{scan.window},}}"), not_allowed)
    return F.flatten(F.transform(candidates, windows))


def _spans_column(text: Column, scan: SecretScan) -> Column:
    """All spans as an array of (start, kind number, end), sorted."""
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def as_spans(found: Column, kind: int) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].cast("int").alias("start"), F.lit(kind).alias("kind"), m["end"].cast("int").alias("end")
            ),
        )

    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assigned = F.filter(
        F.zip_with(
            _matches(text, ASSIGN.replace("([A-Za", "(?:[A-Za")),
            values,
            lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.length(v).alias("n")),
        ),
        lambda m: m["n"] >= ASSIGN_LEAST,
    )
    parts = [as_spans(assigned, 0), as_spans(_matches(text, ACCESS), 1), as_spans(_matches(text, HEX), 2)]
    for number, cls in enumerate(scan.classes, start=3):
        parts.append(as_spans(_entropy_matches(text, cls, scan), number))
    return F.array_sort(F.concat(*(F.coalesce(p, empty) for p in parts)))


def find_secrets(docs: DataFrame, scan: SecretScan = SecretScan(), text: str = "text") -> DataFrame:
    """``docs`` with a column ``secrets``: an array of (start, kind, end), sorted by start.

    ``kind`` is a position in ``scan.kinds``. A NULL or empty text has no secrets; repeated
    rows are scanned each on their own; other columns pass through untouched.
    """
    return docs.withColumn("secrets", _spans_column(text_or_empty(text), scan))


def joined_spans(spans: Column, scan: SecretScan, kinds: int | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined; only the first ``kinds`` kinds if given."""
    names = F.array(*(F.lit(k) for k in scan.kinds))
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def secret_digest(docs: DataFrame, scan: SecretScan = SecretScan()) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), scan)
    spans = F.col("secrets")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(spans, scan, 3).cast("binary"), 256).alias("base_sha256"),
        joined_spans(spans, scan).alias("spans"),
    )


def redact_secrets(docs: DataFrame, scan: SecretScan = SecretScan(), mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans become one mask.

    A NULL text stays NULL; the column ``n_chars``, where there is one, is counted anew.
    """
    text = F.col("text")
    merged = F.aggregate(
        F.col("secrets"),
        F.struct(
            F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")
        ),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] <= acc["at"], acc["out"])
            .when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, F.length(text)))),
    )
    clean = F.when(text.isNull() | (F.size("secrets") == 0), text).otherwise(F.array_join(merged, ""))
    out = find_secrets(docs, scan).withColumn("text", clean).drop("secrets")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
