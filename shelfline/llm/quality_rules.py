"""Line-first quality rules, in built-in functions only."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5                  # words of a repeated window
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20       # per cent of words in repeated windows
MIN_KEPT_SHARE = 50         # per cent of word characters that must outlive the line rules

# Characters and phrases that the rules look for.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
TERMINALS = r"[.!?:;…\"'”’)\]]$"
BOILERPLATE = (r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept cookies"
               r"|enable javascript|click here|sign (in|up)\b|subscribe to|log ?in|share this|back to top|skip to content)")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _only(text: Column, inside: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def _facts(x: Column) -> Column:
    """What the rules ask of a line, worked out once."""
    line, words = x["line"], x["words"]
    return F.struct(line.alias("line"), F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"),
                    F.size(F.array_distinct(words)).alias("distinct"), _only(line, SYMBOLS).alias("symbols"))


def line_fails(x: Column) -> Column:
    """The rules of one line that holds a word: punctuation, navigation, boilerplate, shouting, symbols, echo."""
    line, n = x["line"], x["n"]
    separators = _only(line, SEPARATORS)
    rules = [
        (n < 4) & ~F.rtrim(line, F.lit(BLANKS)).rlike(TERMINALS),                    # a loose label
        x["symbols"] * 4 > n,                                                        # strewn with symbols
        (n >= 10) & (x["distinct"] * 3 < n),                                         # one word over and over
        (n < 40) & line.rlike(BOILERPLATE),
        (separators >= 3) & (separators * 5 >= n),                                   # a menu
        (n >= 3) & (F.length(F.regexp_replace(line, r"\P{Lu}+", "")) * 2 > x["chars"]),   # in capitals
        (n >= 3) & (F.regexp_count(line, F.lit(r"[!?]{2}")) * 2 > n),                 # exclamations
    ]
    return reduce(lambda a, b: a | b, rules)


def repeat_words(words: Column, window: int = WINDOW) -> tuple[dict[str, Column], Column]:
    """Steps (name: column, in order) and the number of words inside windows that occur twice or more.

    Windows are 64-bit hashes of word hashes. Only a text whose windows are not all distinct has them
    sorted with their places; neighbours with equal hashes are repeats, and each repeat adds the words that
    the one before it did not cover.
    """
    n = F.size("_win")
    steps = {
        "_hash": F.transform(words, lambda w: F.xxhash64(w)),
        "_win": F.when(F.size("_hash") >= window,
                       F.transform(F.sequence(F.lit(0), F.size("_hash") - window),
                                   lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(window)])))
                 .otherwise(F.array().cast("array<bigint>")),
        "_order": F.when(F.size(F.array_distinct("_win")) < n,
                         F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "_again": F.when(F.col("_order").isNotNull(), F.array_sort(F.transform(
            F.filter(F.transform("_order", lambda x, k: F.struct(
                x["i"].alias("i"), ((x["h"] == F.get("_order", k - 1)["h"]) | (x["h"] == F.get("_order", k + 1)["h"])).alias("twice"))),
                lambda x: F.coalesce(x["twice"], F.lit(False))), lambda x: x["i"]))),
    }
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_again", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")),
                          lambda a: a["n"])
    return steps, F.coalesce(covered, F.lit(0)).cast("long")


def clean_lines(documents: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
    cleaned (the text of the lines kept) and kept to every row; other columns stay.

    A null text is an empty one: no words, base_failed, not kept, cleaned empty. A document is kept unless
    its base fails or its kept lines hold less than MIN_KEPT_SHARE per cent of its word characters. Lines
    without a word count nowhere. Every row is judged on its own, so nothing is shuffled and repeated rows
    get the same verdict. Columns with the names of the results are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed",
            "cleaned", "kept")
    base = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in made])
    names = base.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    df = base.withColumn("_split", F.filter(
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("words"))), lambda x: F.size(x["words"]) > 0))
    df = df.withColumn("_words", F.flatten(F.col("_split.words")))
    steps, repeated = repeat_words(F.col("_words"))
    for name, column in steps.items():
        df = df.withColumn(name, column)
    df = df.withColumn("_facts", F.transform("_split", _facts))
    df = df.withColumn("_kept", F.filter("_facts", lambda x: ~line_fails(x)))
    chars, left = (F.aggregate(c, F.lit(0), lambda a, x: a + x["chars"]).cast("long") for c in ("_facts", "_kept"))
    df = (df.select("*", F.size("_words").cast("long").alias("n_words"), repeated.alias("n_repeat_words"), chars.alias("word_chars"),
                    left.alias("_left"))
          .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_SHARE)))
    return df.select(
        *[F.col(f"`{c}`") for c in names], "n_words", "word_chars",
        F.aggregate("_facts", F.lit(0), lambda a, x: a + x["symbols"]).cast("long").alias("n_symbols"),
        (F.size("_split") - F.size(F.array_distinct(F.col("_split.line")))).cast("long").alias("n_dup_lines"), "n_repeat_words", "base_failed",
        F.size("_split").cast("long").alias("n_lines"), (F.size("_split") - F.size("_kept")).cast("long").alias("n_lines_removed"),
        F.array_join(F.col("_kept.line"), "\n").alias("cleaned"),
        (~F.col("base_failed") & (F.col("_left") * 100 >= F.col("word_chars") * MIN_KEPT_SHARE)).alias("kept"))


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "kept")

SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
marked AS (
  SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, list_filter(lines, lambda x: NOT (
      (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 4 AND NOT regexp_matches(rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[.!?:;…"''”’)\]]$'))
   OR (len(regexp_extract_all(x, '[|»›•·]')) >= 3 AND len(regexp_extract_all(x, '[|»›•·]')) * 5 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
   OR (regexp_matches(x, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept cookies|enable javascript|click here|sign (in|up)\b|subscribe to|log ?in|share this|back to top|skip to content)')
       AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 40)
   OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 4 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
   OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 3 AND len(regexp_extract_all(x, '\p{Lu}')) * 2 > length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))
   OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 3 AND len(regexp_extract_all(x, '[!?]{2}')) * 2 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
   OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10 AND len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) * 3 < len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
  )) AS keep
  FROM base b LEFT JOIN rep USING (r)),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_repeat_words::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * n_repeat_words > 20 * len(w) AS base_failed,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(keep))::BIGINT AS n_lines_removed,
         length(regexp_replace(array_to_string(keep, ''), '[\x20\x09-\x0D]', '', 'g')) AS kept_chars
  FROM marked)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
       NOT base_failed AND 100 * kept_chars >= 50 * word_chars AS kept
FROM counted
"""
