"""Line-first cleaning: rules per line, then documents that lose too much go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LOOKUP = 32
MIN_WORDS = 10
MAX_REPEATED = 20  # words in repeated windows, per cent
MAX_LOST = 50  # words in failing lines, per cent
SPACES = " \t\n\x0b\x0c\r"

# A line of one or two words, and the marks a sentence may end in.
FRAGMENT = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?[\x20\x09-\x0D]*+$"
END_MARK = r"[.!?:;…。！？\"'”’»)\]][\x20\x09-\x0D]*+$"

# Phrases of page furniture, looked for in short lines only.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies"
    "|enable javascript|javascript is disabled|lorem ipsum|click here|read more|sign up|log in|subscribe now"
)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_passes(line: Column) -> Column:
    """Whether a line that holds a word is kept.

    It fails as navigation (separators between most of its words), as symbol noise,
    if it is all capitals, as a short line of page furniture, or if it is a fragment
    of under three words without a mark at its end.
    """
    words = F.size(F.split(F.btrim(line, F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    bars = _count(line, "|»›•·")
    navigation = line.rlike("[|»›•·]") & (bars >= 2) & (bars * 4 >= words)
    noise = line.rlike(f"[{SYMBOLS}]") & (_count(line, SYMBOLS) * 10 > F.length(F.translate(line, SPACES, "")))
    capitals = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (words >= 3)
    furniture = (F.length(line) <= 200) & line.rlike(f"(?i)(?:{BOILERPLATE})")
    fragment = line.rlike(FRAGMENT) & ~line.rlike(END_MARK)
    return ~(navigation | noise | capitals | furniture | fragment)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in windows of five that occur more than once in ``words``.

    Windows are compared as 64-bit hashes. Few rows have an equal pair; where few
    different windows are repeated their places are looked up, else places are sorted by hash.
    """
    w, h, r, p = "words", "window_hashes", "window_repeats", "window_starts"
    none = F.array().cast("array<bigint>")
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)])
    )
    df = df.withColumn(h, F.when(n >= WINDOW, windows).otherwise(none))
    df = df.withColumn(r, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(none))
    df = df.withColumn(r, F.array_distinct(F.filter(r, lambda x, j: x == F.get(F.col(r), j - 1))))
    places = F.transform(h, lambda x, i: F.when(F.array_contains(F.col(r), x), i))
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(
        "window_order", F.when(F.size(r) > LOOKUP, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    s = F.col("window_order")
    same = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
    df = df.withColumn(
        p,
        F.when(F.size(r) == 0, F.array().cast("array<int>"))
        .when(F.size(r) <= LOOKUP, F.array_compact(places))
        .otherwise(F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))),
    )
    covered = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), x - F.coalesce(F.get(F.col(p), j - 1), x - WINDOW)))
    return df.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda total, x: total + x)
    ).drop(h, r, p, "window_order")


def clean_lines(docs: DataFrame, max_lost: int = MAX_LOST, keep: list[str] | None = None) -> DataFrame:
    """Counts, verdict and cleaned text of every row.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words, kept,
    clean_text)`` and the columns of ``docs`` named in ``keep``. Each row is judged by itself: repeated rows
    get equal verdicts, a null or empty text has no words and fails, other columns play no part. Lines
    without a word are dropped from ``clean_text``.
    """
    kept_columns = [F.struct(*[F.col(c) for c in keep]).alias("kept_row")] if keep else []
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"), *kept_columns)
    df = df.withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.when(F.col("text").rlike(f"[{SYMBOLS}]"), _count(F.col("text"), SYMBOLS))
            .otherwise(0)
            .cast("bigint"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "clean_text": F.array_join(F.filter("lines", line_passes), "\n"),
        }
    ).drop("lines", "text")
    df = _repeated_words(df).drop("words")
    df = df.withColumn("n_kept_words", F.size(words_of(F.col("clean_text"))).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    lost = F.col("n_words") - F.col("n_kept_words")
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * lost <= max_lost * F.col("n_words")))
    # A generator of one row: filters on the verdict must not copy all of the above below it.
    return df.select(F.inline(F.array(F.struct(*df.columns))))
