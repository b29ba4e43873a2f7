"""Quality rules: a threshold table compiled into one projection.

Rows of ``RULES`` name a measure and its allowed range; ``compile_rules``
turns the table into one Boolean expression.  Measures are built-in
functions over the text and its word and line arrays, so a document is
judged where it is read: no shuffle, no user function.

Repeated windows are found without comparing all windows: each window's
hash and place are packed into one long, the longs are sorted, and only
windows whose hash part equals a neighbour's are compared by their words.

Defined results: a null or empty text has no words and fails the base rule;
equal rows are judged alike; extra columns are kept by ``keep_documents`` and
ignored by ``measure_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import SPACES, word_array

SYMBOLS = "#*$%&|<>"
# Frequent short words of the corpus's languages (en, de, fr, es).
STOP_WORDS = (
    "the be to of and that have with is it for in on as are this or by was at from "
    "der die das und ist von mit zu den dem nicht ein eine auf für im "
    "le la les de des et est que qui dans un une du pour sur en "
    "el los las y del por con para no se es una al"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None: no bound.  Rules of a shorter
    text than ``least_words`` do not apply."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


BASE_RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
)
RULES = (
    Rule("mean_word_chars", low=1.5, high=14.0),
    Rule("symbol_word_ratio", high=0.3),
    Rule("stop_words", low=2),
    Rule("dup_line_ratio", high=0.5),
    Rule("letter_word_ratio", low=0.6),
    Rule("upper_letter_ratio", high=0.6),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.5),
)

# The place takes 31 bits of a packed long, the hash the other 33.
PLACE_BITS = 31


def _measures(docs: DataFrame, text_col: str, prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with helper columns, and each measure as an expression."""
    c = lambda name: F.col(prefix + name)
    col = lambda df, name, e: df.withColumn(prefix + name, e)
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = col(docs, "text", text)
    df = col(df, "words", word_array(c("text")))
    df = col(df, "n", F.size(c("words")).cast("long"))
    # Sorted longs of (hash of three words, place): only hash ties go on.
    packed = F.when(
        c("n") >= 3,
        F.sort_array(
            F.transform(
                F.slice(c("words"), 1, F.greatest(F.size(c("words")) - 2, F.lit(0))),
                lambda w, i: F.shiftleft(F.xxhash64(w, F.get(c("words"), i + 1), F.get(c("words"), i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = col(df, "packed", packed)
    df = col(df, "next", F.slice(c("packed"), 2, F.greatest(F.size(c("packed")) - 1, F.lit(0))))
    # ties[j]: packed[j] and packed[j+1] share the hash part (the last has no next: null)
    df = col(
        df,
        "ties",
        F.zip_with(c("packed"), c("next"), lambda a, b: F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))),
    )
    places = F.filter(
        F.transform(
            c("packed"),
            lambda p, j: F.when(
                F.get(c("ties"), j) | F.coalesce(F.get(c("ties"), j - 1), F.lit(False)), p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
            ),
        ),
        lambda p: p.isNotNull(),
    )
    df = col(df, "places", places)
    # The words of those windows, sorted: equal neighbours are true repeats.
    df = col(
        df,
        "windows",
        F.sort_array(F.transform(c("places"), lambda i: F.struct(F.concat_ws(" ", *(F.get(c("words"), i + j) for j in range(3))).alias("w"), i.alias("i")))),
    )
    df = col(df, "wnext", F.slice(c("windows"), 2, F.greatest(F.size(c("windows")) - 1, F.lit(0))))
    df = col(df, "same", F.zip_with(c("windows"), c("wnext"), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))))
    starts = F.sort_array(
        F.filter(
            F.transform(c("windows"), lambda x, j: F.when(F.get(c("same"), j) | F.coalesce(F.get(c("same"), j - 1), F.lit(False)), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    df = col(df, "starts", starts)
    df = col(df, "snext", F.slice(c("starts"), 2, F.greatest(F.size(c("starts")) - 1, F.lit(0))))
    # Each start covers three words, or as many as lie before the next start.
    covered = F.aggregate(
        F.zip_with(c("starts"), c("snext"), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda x, y: x + y
    )
    df = col(df, "repeat", covered)
    blanks = F.length(F.translate(c("text"), SPACES, ""))
    df = col(df, "wordchars", blanks.cast("long"))
    df = col(df, "symbols", (F.length(c("text")) - F.length(F.translate(c("text"), SYMBOLS, ""))).cast("long"))
    df = col(df, "lines", F.filter(F.split(c("text"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    df = col(df, "dup", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))
    df = col(df, "letters", F.length(F.regexp_replace(c("text"), r"\P{L}+", "")))
    some = lambda e: F.greatest(e, F.lit(1))
    n, lines = some(c("n")), some(F.size(c("lines")))
    measures = {
        "n_words": c("n"),
        "word_chars": c("wordchars"),
        "n_symbols": c("symbols"),
        "n_dup_lines": c("dup"),
        "n_repeat_words": c("repeat"),
        "repeat_word_ratio": c("repeat") / n,
        "mean_word_chars": c("wordchars") / n,
        "symbol_word_ratio": c("symbols") / n,
        "dup_line_ratio": c("dup") / lines,
        "stop_words": F.size(F.filter(c("words"), lambda w: F.lower(w).isin(STOP_WORDS))),
        "letter_word_ratio": c("letters") / some(c("wordchars")),
        "upper_letter_ratio": F.length(F.regexp_replace(c("text"), r"\P{Lu}+", "")) / some(c("letters")),
        "bullet_line_ratio": F.size(F.filter(c("lines"), lambda x: x.rlike(r"^\s*[-*•]"))) / lines,
        "ellipsis_line_ratio": F.size(F.filter(c("lines"), lambda x: x.rlike(r"(…|\.\.\.)\s*$"))) / lines,
    }
    return df, measures


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """True where every rule holds."""
    passes = F.lit(True)
    for r in rules:
        m, ok = measures[r.measure], F.lit(True)
        ok = ok & (m >= r.low) if r.low is not None else ok
        ok = ok & (m <= r.high) if r.high is not None else ok
        passes = passes & (ok | (measures["n_words"] < r.least_words) if r.least_words else ok)
    return passes


def _judged(docs: DataFrame, text_col: str, rules, base) -> tuple[DataFrame, dict[str, Column], Column, Column]:
    prefix = "rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    df, measures = _measures(docs, text_col, prefix)
    # A filter on the verdict must not be pushed below this point: Spark would
    # put the helper columns' expressions into it, one inside the other.  It
    # doesn't push filters below a projection that isn't deterministic.
    df = df.withColumn(prefix + "fence", F.monotonically_increasing_id())
    failed = (F.col(prefix + "fence") < 0) | ~compile_rules(base, measures)
    return df, measures, failed, ~failed & compile_rules(rules, measures)


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, base=BASE_RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept."""
    df, m, failed, kept = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules, base)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("doc_id", *(m[k].alias(k) for k in own), failed.alias("base_failed"), kept.alias("kept"))


def keep_documents(docs: DataFrame, text_col: str = "text", rules=RULES, base=BASE_RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    df, _, _, kept = _judged(docs, text_col, rules, base)
    return df.filter(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
