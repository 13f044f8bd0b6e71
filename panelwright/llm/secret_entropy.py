"""Secrets in texts: fixed patterns, and strings whose sliding-window entropy is high.

Built from SQL functions only.  Match places come from the lengths of the
matches and of the text between them, as code points, end exclusive.  The
entropy of a window is kept up by counts: a character comes in, one goes out,
and the sum of ``count * log2(count)`` changes by two terms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Pattern and shortest length of what is kept, by kind; the order breaks ties of place.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = (*BASE, "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class of a candidate or of a part of it between separators: what it must look like, and the bits per character from
#: which a window is suspect.  Of random windows of 20 characters over the alphabets of a class at most about 1% lie
#: below (1% points: 2.90 of 16 letters, 3.35 of 32, 3.40 of 36, 3.58 of 52, 3.65 of 62 and 64).  Where separators, or
#: digits at one end only, make words likelier, the bound of strings in one case is higher.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 2.89),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.6),
    ("word and number", r"^(?:[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+)$", 3.7),
    ("single case", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.34),
    ("single case in parts", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.7),
    ("mixed letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", 3.58),
)
#: Words as letter case shows them; strings without a digit are suspect if there is one for every four characters or fewer.
CASE_WORD, CASE_WORD_LENGTH = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", 4
#: What is never reported by entropy alone: windows that overlap a match are acquitted, the rest of a candidate is not.
#: Identifiers, dated names and paths of words are bounded in length, so that no long secret passes for one of them.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|your[_-]",
    r"(?i)0123456789|abcdefgh|(.)\1{7}",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_=-]{0,80}",
    r"^//[^/]{0,80}(?:/[^/]{0,40})*$|^/?(?:[A-Za-z_]+/){2}(?:[^/]{0,40}/)*[^/]{0,40}$",
)
_STEP = 256


def _let(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with the value computed once, however often the function's lambdas use it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _running(values: Column) -> Column:
    """Sums of all values before each, and of all; linear in chunks of _STEP values."""
    def grow(start: Column, items: Column) -> Column:
        return F.aggregate(
            items, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )

    count = F.ceil(F.size(values) / F.lit(_STEP)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(values, i * _STEP + 1, _STEP))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("int"), lambda a, x: a + x))
        return _let(grow(F.lit(0).cast("int"), sums), lambda bases: F.flatten(
            F.transform(parts, lambda part, i: F.slice(grow(F.get(bases, i), part), 1, F.size(part)))
        ))

    return _let(parts, joined)


def matches(text: Column, pattern: str, kind: str, group: int = 0, shortest: int = 0) -> Column:
    """Leftmost, non-overlapping matches whose group has ``shortest`` characters: (start, rank, end, kind, value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(all_: Column) -> Column:
        steps = F.zip_with(F.slice(all_["gaps"], 1, F.size(all_["found"])), F.transform(all_["found"], F.length), lambda a, b: a + b)
        # Where a match begins: after all earlier gaps and matches, and its own gap.
        begins = F.zip_with(_let(steps, _running), F.slice(all_["gaps"], 1, F.size(all_["found"])), lambda a, b: a + b)
        return F.zip_with(
            F.zip_with(begins, all_["found"], lambda start, value: F.struct(start.alias("start"), value.alias("value"))),
            all_["kept"],
            lambda m, part: F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"),
                (F.length(part) >= shortest).alias("keep"),
            ),
        )

    rows = F.filter(
        _let(F.struct(found.alias("found"), kept.alias("kept"), gaps.alias("gaps")), placed), lambda r: r["keep"]
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,keep:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def window_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits per character, of the windows of a string.

    A string shorter than the window has no window and gives 0.
    """
    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))

    def step(state: Column, i: Column, places: Column) -> Column:
        new = F.get(places, i - 1)
        old = F.when(i > window, F.get(places, i - 1 - window)).otherwise(F.lit(-1))
        up = F.get(state["counts"], new)
        added = state["total"] + weight(up + 1) - weight(up)
        counts = F.transform(state["counts"], lambda c, j: c + F.when(j == new, 1).otherwise(0))
        down = F.get(counts, old)
        total = F.when(old >= 0, added + weight(down - 1) - weight(down)).otherwise(added)
        counts = F.transform(counts, lambda c, j: c - F.when(j == old, 1).otherwise(0))
        entropy = F.when(i >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
        return F.struct(
            counts.alias("counts"), total.alias("total"), F.greatest(state["best"], entropy).alias("best")
        )

    def best(places: Column) -> Column:
        """From the number of each character among the different ones."""
        none = F.transform(F.sequence(F.lit(0), F.array_max(places)), lambda _: F.lit(0))
        start = F.struct(none.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(places)), start, lambda s, i: step(s, i, places), lambda s: s["best"]
        )

    def numbered(letters: Column) -> Column:
        return F.transform(F.split(value, ""), lambda c: F.array_position(letters, c).cast("int") - 1)

    return _let(F.array_distinct(F.split(value, "")), lambda letters: _let(numbered(letters), best))


def _suspect(value: Column, window: int, allowed: Sequence[str]) -> Column:
    """Whether a candidate has a window that reaches the bound of its class and overlaps nothing allowed.

    What lies between allowed parts is judged whole, and by its parts between separators.
    """
    def reaches(part: Column) -> Column:
        bits = F.when(F.lit(False), F.lit(0.0))
        for name, pattern, least in CLASSES:
            fits = part.rlike(pattern)
            if name == "mixed letters":
                words = F.size(F.regexp_extract_all(part, F.lit(CASE_WORD), F.lit(0)))
                fits &= words * CASE_WORD_LENGTH >= F.length(part)
            bits = bits.when(fits, F.lit(least))
        return F.when(bits.isNotNull(), window_entropy(part, window) >= bits).otherwise(F.lit(False))

    def long_parts(whole: Column, between: str) -> Column:
        return F.filter(F.split(whole, between, -1), lambda p: F.length(p) >= window)

    pieces = long_parts(value, "|".join(f"(?:{a})" for a in allowed)) if allowed else F.array(value)
    return _let(pieces, lambda free: F.exists(
        F.array_union(free, F.flatten(F.transform(free, lambda p: long_parts(p, r"[^A-Za-z0-9]+")))), reaches
    ))


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """One row per input row: key, text, ``base`` and ``spans``, both arrays of (start, rank, end, kind, value, keep).

    ``spans`` has the base spans and, of the other strings of 20 or more
    characters, those with a window whose entropy reaches the bound of the
    character class of the string, or of its part between separators, without
    overlapping an ``allowed`` part (patterns may refer back to the first group
    of all of them only), unless they touch a base span.  A null
    text counts as empty and has no spans; repeated rows and null keys stay
    rows of their own; other columns are not looked at.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")
    )
    return _with_spans(rows, "_text", window, allowed).select(
        F.col("_key").alias(key), F.col("_text").alias(text), F.col("_base").alias("base"), F.col("_spans").alias("spans")
    )


def _with_spans(rows: DataFrame, text: str, window: int, allowed: Sequence[str]) -> DataFrame:
    found = {
        f"_{kind}": matches(F.col(text), pattern if kind != "hex" else r"[0-9a-f]{24,}", kind, group, least)
        for kind, (pattern, group, least) in BASE.items()
    }
    found["_entropy"] = matches(F.col(text), CANDIDATE, "entropy")
    rows = rows.withColumns(found)
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{kind}") for kind in BASE])))
    extra = F.filter(
        "_entropy",
        lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        & _suspect(c["value"], window, allowed),
    )
    spans = F.when(F.size("_entropy") > 0, F.array_sort(F.concat("_base", extra))).otherwise(F.col("_base"))
    return rows.withColumn("_spans", spans)


def redact_secrets(
    docs: DataFrame, text: str = "text", length: str | None = "n_chars", window: int = 20,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """The rows of ``docs``, with all their columns; secrets in the text are replaced by a mark.

    ``length`` names a column with the number of characters, brought up to date
    where the text changes.  A null text stays null.
    """
    whole = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    at = f"_{docs.columns.index(text)}"
    rows = docs.select(*whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_body"))
    rows = _with_spans(rows, "_body", window, allowed)
    changed = F.size("_spans") > 0
    rows = rows.withColumn(at, F.when(changed, redacted("_body", "_spans")).otherwise(F.col(at)))
    if length in docs.columns:
        n = f"_{docs.columns.index(length)}"
        rows = rows.withColumn(n, F.when(changed, F.length(at).cast(docs.schema[length].dataType)).otherwise(F.col(n)))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def span_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of each row."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(key, *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones taken together, replaced by ``mark``."""
    def join(state: Column, span: Column) -> Column:
        inside = span["start"] < state["at"]
        gap = F.col(text).substr(state["at"] + 1, span["start"] - state["at"])
        parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, F.lit(mark))))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    tail = F.aggregate(
        spans, start, join,
        lambda s: F.concat(F.array_join(s["parts"], ""), F.col(text).substr(s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, tail).otherwise(F.col(text))
