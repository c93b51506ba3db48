"""Quality rules as a short-circuit cascade of native predicates over whole texts.

Words are maximal runs of characters other than blank, tab, newline, vertical tab, form feed and carriage return.
``Measures`` gives the counts that rules speak of, each made only where it is asked for, ``RULES`` the predicates that reject a text,
``order_rules`` estimates cost and selectivity of each on a random sample, and ``cascade`` applies them in order of rejection per cost: a
rule is evaluated, and what it counts is counted, only for texts that no rule before it rejected. A text is split into words once.
The order changes the work done and which rule is named first, never the verdict. ``quality_measures`` has five counts to make for every
text; the verdict beyond them is a cascade too.

Defined results: a null or empty text, or one of blanks only, has no words and is rejected as too short. Very long texts
are worked through in full: all steps are linear but one sort of the repeated windows. Repeated rows are judged row
by row. Empty tables give empty tables. Columns of the input are carried unchanged, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The words of a text in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def lines(text: Column) -> Column:
    """The newline-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: name -> predicate that rejects, given a lookup of measures.
RULES = {
    "too_short": lambda c: c("n_words") < 50,
    "repeats_itself": lambda c: 100 * c("n_repeat_words") > 50 * c("n_words"),
    "symbols": lambda c: 100 * c("n_symbols") > 30 * c("n_words"),
    "same_lines": lambda c: (c("n_dup_lines") >= 5) & (2 * c("n_dup_lines") > c("n_lines")),
    "capitals": lambda c: 2 * c("n_capitals") > c("word_chars"),
    "word_length": lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once. A name bound inside an expression, unlike a column, stays bound when
    Catalyst moves a filter on the result below the projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words of the list ``w`` in windows of three that occur twice or more."""

    def of_windows(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
        at = F.filter(F.transform(s, lambda x, i: F.when(same(x, i), x["i"])), lambda x: x.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), hashed), of_windows))


class Measures:
    """A lookup of measures of a text whose words are ``w``, each an expression of its own, so that a rule pays for what it needs only."""

    def __init__(self, text: Column, w: Column, known: dict[str, Column] | None = None):
        self.known = known or {}
        self.made = {
            "n_words": lambda: F.size(w),
            "word_chars": lambda: F.length(F.array_join(w, "")),
            "n_symbols": lambda: F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")),
            "n_lines": lambda: F.size(lines(text)),
            "n_dup_lines": lambda: _let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_capitals": lambda: F.length(F.regexp_replace(text, "[^A-Z]+", "")),
            "n_repeat_words": lambda: _repeat_words(w),
        }

    def __call__(self, name: str) -> Column:
        return self.known[name] if name in self.known else self.made[name]().cast("long")


def _sample(docs: DataFrame, text: str, size: int, seed: int = 7) -> DataFrame:
    """About ``size`` texts, each row drawn with the same chance; all of them where there are no more."""
    n = docs.count()
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(min(1.0, size / max(n, 1)), seed)


def order_rules(docs: DataFrame, text: str = "text", sample: int = 500, work: int = 4_000_000) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) by falling rejection per second, measured on about ``sample`` rows.

    Every rule is timed over the sample as often as makes ``work`` characters, less the time that splitting the same texts takes without it.
    The sample serves the estimate only; the cascade runs over all rows. Without rows the order is that of ``RULES``.
    """
    rows = written(_sample(docs, text, sample).repartition(4))
    n, size = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    if not n:
        return [(name, 0.0, 0.0) for name in RULES]
    many = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(min(100, max(1, work // max(1, size)))))))

    def timed(rejects: Callable[[Callable], Column]) -> tuple[float, float]:
        began = time.perf_counter()
        hit = many.agg(F.avg(_let(words(F.col("text")), lambda w: rejects(Measures(F.col("text"), w))).cast("int"))).first()[0]
        return hit, time.perf_counter() - began

    # the first job of its kind pays for starting up
    base = min([timed(lambda c: c("n_words") < 0)[1] for _ in range(3)][1:])
    found = [(name, hit, max(took - base, 1e-3)) for name, rule in RULES.items() for hit, took in [timed(rule)]]
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(text: Column, order: list[str], rules: dict[str, Callable] = RULES) -> Column:
    """The first rule of ``order`` that rejects the text, else null. Later rules are not evaluated once one rejects."""
    whole = F.coalesce(text, F.lit(""))
    return _let(words(whole), lambda w: _first(order, Measures(whole, w), rules))


def _first(order: list[str], measure: Callable[[str], Column], rules: dict[str, Callable] = RULES, out: Column = F) -> Column:
    for name in order:
        out = out.when(rules[name](measure), F.lit(name))
    return out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with their columns as they came."""
    order = [name for name, _, _ in order_rules(docs, text)]
    return docs.where(cascade(F.col(text), order).isNull())


def quality_measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five counts, base_failed and kept of every row."""
    order = [name for name, _, _ in order_rules(docs, text) if name not in ("too_short", "repeats_itself")]
    whole = F.coalesce(F.col(text), F.lit(""))

    def counted(w: Column) -> Column:
        measure = Measures(whole, w)
        return _let(F.struct(*[measure(name).alias(name) for name in MEASURES]), lambda m: judged(w, m))

    def judged(w: Column, m: Column) -> Column:
        known = {name: m[name] for name in MEASURES}
        failed = base_failed(known["n_words"], known["n_repeat_words"])
        verdict = _first(order, Measures(whole, w, known), out=F.when(failed, F.lit("base")))
        return F.struct(*[c.alias(name) for name, c in known.items()], failed.alias("base_failed"), verdict.isNull().alias("kept"))

    return docs.select(F.col(key), _let(words(whole), counted).alias("m")).select(key, "m.*")
