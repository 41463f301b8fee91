"""Line-first cleaning, in DataFrame functions only.

Every line of a text is held against rules of punctuation, navigation and boilerplate; lines that fail are removed,
and a document that loses too much of its text that way is rejected, as are documents that fail the base rules
(too few words, or too many of them in repeated windows). All is done within the row: no exchange, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Marks that end or join sentences. A line that has none of them is no prose.
SENTENCE = "[.!?…:;。！？؟।]"
SYMBOLS = "[#*$%&|<>]"
#: Separators of menus and paths, standing between spaces.
SEPARATOR = " [|>»›·•/] "
#: Whole lines of menus, lower case.
MENU = ["home", "login", "log in", "sign in", "sign up", "register", "menu", "search", "next", "previous", "back", "back to top", "skip to content", "read more", "share", "contact", "contact us", "about", "about us", "sitemap"]
#: Phrases of notices, lower case.
NOTICES = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "we use cookies", "enable javascript", "lorem ipsum", "licensed under", "released under the", "click here", "subscribe to our newsletter"]
#: Words of a window whose repeats count, the share of words (percent) in repeated windows that fails a text, and its least words.
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20

RULES = ("punctuation", "navigation", "boilerplate")
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", *(f"n_{r}" for r in RULES), "chars_lost", "kept", "cleaned_text"]


def line_rule(line: Column) -> Column:
    """The first rule that a line fails, or null. Lines without a word fail none."""
    words = F.regexp_count(line, F.lit(WORD))
    symbols, shouts = F.regexp_count(line, F.lit(SYMBOLS)), F.regexp_count(line, F.lit(r"[!?]{2,}"))
    low = F.lower(line)
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        F.when(words == 0, None)
        .when(((separators >= 2) & (separators * 5 >= words)) | F.trim(low).isin(MENU), "navigation")
        .when((symbols * 2 > words) | (shouts * 3 > words) | ~line.rlike(SENTENCE), "punctuation")
        .when(low.rlike("|".join(NOTICES)), "boilerplate")
    )


def placed_windows(hashes: Column) -> Column:
    """The windows' hashes with their places, sorted; null where no two are equal."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def repeated_words(placed: Column) -> Column:
    """How many words lie in windows found twice or more, from placed_windows().

    Windows with an equal neighbour are the repeated ones. In order of place, each covers WINDOW words, or as many as there
    are up to the next. (No lambda names placed: were it there and put in its place by the optimizer, each window would sort all.)
    """
    next_same = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same")))
    twice = F.filter(F.zip_with(next_same, F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(False).alias("same"))), next_same), lambda x, y: F.when(x["same"] | y["same"], x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(F.sort_array(twice), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def _failing(rule: str) -> Column:
    return F.size(F.filter("_failed", lambda x: x["rule"] == rule))


def clean(docs: DataFrame, max_lost: int = 50) -> DataFrame:
    """docs with COLUMNS: counts of every whole text, its lines by failed rule, the text that is left, and the verdict.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier line),
    n_repeat_words (words in windows of WINDOW words found twice or more); base_failed; n_lines (with a word) and how many
    fail each rule; chars_lost (code points in words of removed lines); kept: not base_failed, and at most max_lost percent
    of the word_chars are lost; cleaned_text: the lines left (empty ones, too), joined by line feeds.

    A null text has no words (so fails the base rules) and stays null when cleaned; empty likewise, and stays empty. Equal
    rows have equal verdicts. A text is held whole by its task, its windows as 64-bit hashes (two different windows of one text
    of 1e5 words are taken for equal with a probability of 3e-10). Other columns pass through; those named like results
    are replaced. An empty table stays empty.
    """
    keep = docs.drop(*COLUMNS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keep.select(F.struct(*[F.col(f"`{c}`") for c in keep.columns]).alias("_row"), F.array_remove(F.split(text, SPACES), "").alias("_words"), F.split(text, "\n").alias("_lines"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    worded = F.filter("_lines", lambda x: x.rlike(WORD))
    rows = rows.select(
        "_row", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), windows.alias("_windows"),
        F.transform("_lines", lambda x: F.struct(x.alias("line"), line_rule(x).alias("rule"))).alias("_lines"), worded.alias("_worded"),
    )
    failed = F.filter("_lines", lambda x: x["rule"].isNotNull())
    rows = rows.select(
        "_row", "n_symbols", "n_words", "word_chars", F.size("_worded").cast("long").alias("n_lines"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        placed_windows(F.col("_windows")).alias("_placed"), failed.alias("_failed"), "_lines",
    )
    lost = F.aggregate("_failed", F.lit(0).cast("long"), lambda s, x: s + F.length(F.regexp_replace(x["line"], SPACES, "")))
    rows = rows.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.coalesce(repeated_words(F.col("_placed")), F.lit(0).cast("long")).alias("n_repeat_words"),
        *[_failing(r).cast("long").alias(f"n_{r}") for r in RULES], lost.alias("chars_lost"),
        F.when(F.size("_failed") == 0, F.col("_row.text").cast("string")).otherwise(F.array_join(F.transform(F.filter("_lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")).alias("cleaned_text"),
    )
    # A row's results come out of one array: else a filter on them would be moved below all steps above, and with it the
    # expressions that they name, which lambdas would then evaluate for each word.
    rows = rows.select(F.inline(F.array(F.struct("_row", *[F.col(c) for c in COLUMNS if c not in ("base_failed", "kept")]))))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = rows.withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("chars_lost") <= max_lost * F.col("word_chars")))
    return out.select("_row.*", *COLUMNS)
