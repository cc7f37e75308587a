"""Quality rules on lines first, then on documents, as DataFrame expressions only.

Each line of a text is tested alone; a line without words passes. It fails if

* symbols ``#*$%&|<>`` or exclamation marks are at least a third as many as its words
  (menus with separators, decorated or shouted text);
* it has few words and no punctuation at its end (navigation, buttons, headings);
* it is short and holds a notice's phrase in whole words (rights, licences, cookies), or is a prompt
  such as ``Read more`` with at most three more words; sentences that hold such words stay.

Failing lines are removed, and a document that loses over two thirds of its characters by this
is rejected. So is one that fails a base rule: under ``MIN_WORDS`` words, or over ``MAX_REPEAT``
percent of its words in repeated windows of ``WINDOW`` words. Windows are compared by 64-bit
hashes of their words' hashes.

A null or empty text has no words and is rejected. Repeated rows, ties and null ids pass row
by row; nothing is shuffled. A text's work grows with its length (sorting its windows only
where some repeat). The input's columns are kept in a struct meanwhile, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SHORT_LINE, NOTICE_WORDS = 5, 40
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"
SYMBOL = r"[#*$%&|<>]"
ENDED = r"""[.!?:;,…。"'”»)\]][ \t\x0B\f\r]*$"""
# Whole phrases that notices have anywhere, and prompts that are a line by themselves or nearly so.
NOTICE = (
    r"(?i)(^|[^a-z0-9])(all rights reserved|(cookies?|privacy) (policy|settings|notice|preferences)|(we|site) uses? cookies"
    r"|accept (all )?cookies|terms of (use|service)|licensed under|under the [a-z0-9 ]+ license|enable javascript)([^a-z0-9]|$)"
    r"|^[^a-z0-9]*(subscribe|sign up|log in|click here|read more|share (on|this))([^a-z0-9]+[a-z0-9]+){0,3}[^a-z0-9]*$|©"
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_passes(line: Column) -> Column:
    """The rules of one line."""
    words = F.regexp_count(line, F.lit(WORD))
    decorated = F.greatest(F.regexp_count(line, F.lit(SYMBOL)), F.regexp_count(line, F.lit("!"))) * 3 >= words
    bare = (words < SHORT_LINE) & ~F.regexp_like(line, F.lit(ENDED))
    notice = (F.char_length(line) <= NOTICE_WORDS * 10) & (words <= NOTICE_WORDS) & F.regexp_like(line, F.lit(NOTICE))
    return (words == 0) | ~(decorated | bare | notice)


def _repeated_words(at: Column) -> Column:
    """Words covered by windows that start at the given ascending positions."""
    gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, q) per row: the input's columns, and a struct of features, verdicts and the cleaned text.

    Each step is a projection of its own: what a lambda refers to must be a column by then,
    or it would be computed again for each element.
    """
    start = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    cut = start.withColumn("words", F.coalesce(_words(F.col("text")), F.array().cast("array<string>"))).withColumn(
        "lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    )
    hashed = cut.withColumn("n", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.col("n") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.col("n") - WINDOW),
                lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    # Sorted windows with their positions, where a window repeats at all.
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = ordered.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, k: F.coalesce(x["h"] == F.when(k > 0, F.get("ordered", k - 1)["h"]), F.lit(False))
                    | F.coalesce(x["h"] == F.get("ordered", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    spoken = F.filter("lines", lambda x: F.regexp_like(x, F.lit(WORD)))
    measured = (
        twice.withColumn("spoken", spoken)
        .withColumn("cleaned", F.array_join(F.filter("lines", line_passes), "\n"))
        .select(
            "row",
            "text",
            "cleaned",
            F.col("n").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).cast("long").alias("n_symbols"),
            (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
            F.coalesce(_repeated_words(F.col("at")), F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    enough = 3 * F.char_length("cleaned") >= F.char_length("text")
    judged = measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(enough, F.lit(False))
    )
    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    return judged.select("row", F.struct(*features).alias("q"))


def keep_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their failing lines removed; other columns stay as they are."""
    # A filter is not pushed below a column that is not deterministic. Pushed down, it would
    # repeat every step's expression inside the lambdas of the next.
    judged = assess(df, text_col).withColumn("at", F.monotonically_increasing_id())
    kept = judged.filter(F.col("q.kept") & (F.col("at") >= 0))
    return kept.select(
        *[(F.col("q.cleaned") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns]
    )


_SQL_WORD = WORD.replace(r"\f", r"\x0C")
_SQL_ENDED = ENDED.replace(r"\f", r"\x0C").replace(r"\u", r"\x").replace("'", "''")
for _code in ("2026", "3002", "201D", "00BB"):
    _SQL_ENDED = _SQL_ENDED.replace(rf"\x{_code}", rf"\x{{{_code}}}")
_SQL_NOTICE = NOTICE.replace(r"©", r"\x{00A9}")


def _sql_count(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


#: The query's rows in DuckDB, windows compared as text.
ORACLE_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS words,
         CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') AS w
  FROM (SELECT r, words, unnest(range(0, len(words) - {WINDOW - 1})) AS i FROM cut)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
repeated AS (
  SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST({_sql_count(SYMBOL, 'text')} AS BIGINT) AS n_symbols,
         CAST(len(list_filter(lines, lambda l: regexp_matches(l, '{_SQL_WORD}')))
              - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '{_SQL_WORD}')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         array_to_string(list_filter(lines, lambda l: {_sql_count(_SQL_WORD, 'l')} = 0 OR NOT (
           greatest({_sql_count(SYMBOL, 'l')}, {_sql_count('!', 'l')}) * 3 >= {_sql_count(_SQL_WORD, 'l')}
           OR {_sql_count(_SQL_WORD, 'l')} < {SHORT_LINE} AND NOT regexp_matches(l, '{_SQL_ENDED}')
           OR length(l) <= {NOTICE_WORDS * 10} AND {_sql_count(_SQL_WORD, 'l')} <= {NOTICE_WORDS}
              AND regexp_matches(l, '{_SQL_NOTICE}'))), chr(10)) AS cleaned
  FROM cut LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
         AND 3 * length(coalesce(cleaned, '')) >= length(text) AS kept
FROM measured"""
