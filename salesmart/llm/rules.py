"""Quality rules as a short-circuit cascade of built-in expressions.

A rule says when a text is rejected.  Rules need not agree in cost: one is a
comparison of counts already made, another scans the text.  On a sample of the
texts that pass the base, each rule's cost (seconds for the sample, beyond what
reading it takes) and its selectivity (share rejected) are measured; the cascade
tries the rules by rejections per second, most first, and stops at the first
that rejects.  The order never changes the verdict, which is that no rule
rejects; only ``rejected_by``, the first rule met, depends on it, so give the
``order`` where that has to be repeatable.

Everything is native: arrays of words and lines with higher-order functions, no
Python on any executor and no shuffle.  Repeated windows are found by sorting
a text's windows and comparing neighbours, about 200 bytes a word of one text.

Null and empty texts have no words and fail the base.  Rows may repeat.  Other
columns stay; those named like a result give way to it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import apart
from salesmart.session import cut

# fixed values: what separates words, and what counts as a symbol
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL = r"[^#*$%&|<>]+"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3
SAMPLE_ROWS = 4000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*MEASURES, "base_failed", "rejected_by", "kept"]


def _percent(part: Column, whole: Column, most: int) -> Column:
    return part * 100 > whole * most


def _letters(pattern: str) -> Column:
    """Characters of the text that ``pattern``, a negated class, leaves."""
    return F.char_length(F.regexp_replace("text", pattern, F.lit("")))


def _lines_like(pattern: str) -> Column:
    return F.size(F.filter("_lines", lambda line: line.rlike(pattern)))


def default_rules() -> dict[str, Column]:
    """When a text is rejected, over its measures, ``text``, ``_words`` and ``_lines`` (lines with a word).

    Thresholds are round figures of published rule sets for web text.
    """
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "word_length": (chars < 2 * words) | (chars > 12 * words),
        "symbols": _percent(F.col("n_symbols"), words, 20),
        "duplicate_lines": _percent(F.col("n_dup_lines"), F.size("_lines"), 30),
        "capitals": _percent(_letters(r"[^\p{Lu}]+"), _letters(r"[^\p{L}]+"), 60),
        "few_letters": _percent(chars - _letters(r"[^\p{L}]+"), chars, 50),
        "bullets": _percent(_lines_like(r"^[\x20\t]*[-\x{2022}\x{25CF}\x{25E6}*][\x20\t]"), F.size("_lines"), 90),
        "cut_lines": _percent(_lines_like(r"(\.\.\.|\x{2026})[\x20\t\r]*$"), F.size("_lines"), 30),
        "placeholder": F.lower("text").contains("lorem ipsum"),
        "few_kinds": F.size(F.array_distinct("_words")) * 100 < words * 2,
    }


def measured(docs: DataFrame) -> DataFrame:
    """Add the five counts, ``_words`` and ``_lines`` to every text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text", text).withColumns({
        "_words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
    })
    return rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace("text", SYMBOL, F.lit(""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    })


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A lambda's variable is bound before its body runs, whichever plan the
    optimizer makes; a column read within a lambda could be computed per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the array.

    Windows are sorted with their places, so equal ones are neighbours; each
    repeated window covers its words up to the next repeated one.
    """
    def windows(words: Column) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
        return F.sort_array(F.transform(starts, lambda word, i: F.struct(
            F.concat(word, *[c for k in range(1, WINDOW) for c in (F.lit(" "), F.get(words, i + k))]).alias("w"),
            i.alias("at"))))

    def places(windows: Column) -> Column:
        def place(window: Column, i: Column) -> Column:
            again = (window["w"] == F.get(windows, i - 1)["w"]) | (window["w"] == F.get(windows, i + 1)["w"])
            return F.when(again, window["at"])
        return F.sort_array(F.array_compact(F.transform(windows, place)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, i: F.least(
            F.lit(WINDOW), F.coalesce(at - F.get(places, i - 1), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)
    return _let(_let(_let(words, windows), places), covered)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | _percent(F.col("n_repeat_words"), F.col("n_words"), REPEATED_PERCENT)


def profile(docs: DataFrame, rules: dict[str, Column] | None = None, rows: int = SAMPLE_ROWS,
            seed: int = 7) -> dict[str, tuple[float, float]]:
    """Seconds and share rejected of each rule on a sample of about ``rows`` texts that pass the base.

    The sample is drawn by chance from the whole table and written once, with the
    counts; each rule is then timed alone, beside a run that only reads.
    """
    rules = rules or default_rules()
    total = docs.select(F.count(F.lit(1))).first()[0]
    # drawn by all tasks; what is written is bounded by ``rows``, so one task holds it and wall time is its cost
    sample = cut(docs.select("text").sample(min(1.0, rows / max(total, 1)), seed))
    sample = cut(measured(sample.coalesce(1))).where(~base_failed())

    def timed(rule: Column) -> tuple[float, int, int]:
        start = time.perf_counter()
        found = sample.select(F.count(F.lit(1)), F.count_if(rule)).first()
        return time.perf_counter() - start, *found
    # twice each, the first run also compiles
    idle, size, _ = min(timed(F.size("_words") + F.size("_lines") + F.length("text") < 0) for _ in range(2))
    runs = {name: min(timed(rule) for _ in range(2)) for name, rule in rules.items()}
    return {name: (max(seconds - idle, 1e-3), rejected / max(size, 1)) for name, (seconds, _, rejected) in runs.items()}


def best_order(profiled: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first; the cheaper of equal ones first, then by name."""
    return sorted(profiled, key=lambda name: (-profiled[name][1] / profiled[name][0], profiled[name][0], name))


def apply_rules(docs: DataFrame, rules: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``rejected_by`` (the first rule met) and ``kept``.

    Without ``order`` the rules are measured on a sample first.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    names = docs.columns
    docs = apart(docs)      # a column may be called like a helper
    rules = rules or default_rules()
    order = order or best_order(profile(docs, rules))
    if sorted(order) != sorted(rules):
        raise ValueError("the order must name every rule once")
    # the branches of CASE are tried in turn; texts that fail the base meet no rule
    cascade = F.when(base_failed(), F.lit("base"))
    for name in order:
        cascade = cascade.when(rules[name], F.lit(name))
    text = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in docs.columns])
    rows = measured(text).withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade)
    rest = [F.col("_text" if c == "text" else f"`{c}`").alias(name) for c, name in zip(docs.columns, names)]
    return rows.select(*rest, *MEASURES, "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))
