"""Line-first cleaning, in DataFrame functions alone.

Every line is judged by itself: a line without a closing punctuation mark, a navigation line (many separators, or a short line of menu
words) and a boilerplate line (cookies, rights, scripts, sharing) fails and is removed. A document that loses more than `most_lost` of
the characters of its lines is rejected.

Nulls: a null text has no words and no lines, fails the base checks and is cleaned to the empty text. Empty texts likewise. Repeated rows
are judged one by one. Texts of any length are judged whole. Ties: a text that loses `most_lost` exactly is kept. An empty table gives no row. Columns of the
input that clash with the operator's own are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import SPACE, SPACES_RE

# The contract's base limits.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: A line passes the punctuation rule if it ends so.
CLOSED = r"[.!?:;…。！？][\"'”’»)\]]*$"
#: Three separators or more make a line navigation.
SEPARATORS = "|»›•·>"
MOST_SEPARATORS = 2
MENU = r"(?i)^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back|top|contact|contact us|about|about us|sitemap|share|subscribe)[.!:]?$"
BOILERPLATE = r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|(uses|use of) cookies|enable javascript|powered by|click here|read more|lorem ipsum|copyright \(c\))"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words of a text, maximal runs of characters other than the six spaces."""
    bare = stripped(text)
    return F.when(F.length(bare) > 0, F.split(bare, SPACES_RE)).otherwise(F.array().cast("array<string>"))


def line_passes(line: Column) -> Column:
    """True for lines to keep; lines without a word always pass."""
    bare = stripped(line)
    separators = F.length(bare) - F.length(F.translate(bare, SEPARATORS, ""))
    return (bare == "") | (bare.rlike(CLOSED) & (separators <= MOST_SEPARATORS) & ~bare.rlike(MENU) & ~bare.rlike(BOILERPLATE))


def repeated_words(frame: DataFrame, words: str, to: str) -> DataFrame:
    """Adds `to`: how many words stand in three-word windows that the text holds twice or more.

    Windows are sorted with their places; those equal to a neighbour are repeated, and the places so found, sorted again, cover three
    words each, less where they overlap. All of it stays in the row, so no shuffle is needed and no group can be hot.
    """
    n = F.size(words)
    windows = F.transform(F.slice(F.col(words), F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)).alias("w"), i.alias("i")))
    out = frame.withColumn("_windows", windows)
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows.w")) < F.size("_windows"), F.sort_array("_windows")).otherwise(F.array().cast("array<struct<w:string,i:int>>"))).drop("_windows")
    m = F.size("_sorted")
    same = F.zip_with(F.slice(F.col("_sorted"), F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice(F.col("_sorted"), F.lit(2), F.greatest(m - 1, F.lit(0))), lambda a, b: a["w"] == b["w"])
    out = out.withColumn("_same", same)
    # A window is repeated if it equals the one before it or the one after it.
    marks = F.zip_with(F.concat(F.array(F.lit(False)), "_same"), F.concat("_same", F.array(F.lit(False))), lambda p, q: p | q)
    places = F.sort_array(F.filter(F.zip_with(F.col("_sorted.i"), marks, lambda i, hit: F.when(hit, i)), lambda i: i.isNotNull()))
    out = out.withColumn("_places", F.when(m > 0, places).otherwise(F.array().cast("array<int>"))).drop("_sorted", "_same")
    k = F.size("_places")
    steps = F.zip_with(F.slice(F.col("_places"), F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(F.col("_places"), F.lit(2), F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x) + F.lit(3)
    return out.withColumn(to, F.when(k > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_places")


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "lost_chars", "n_lines_removed"]


def line_first(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """The input's columns with the base counts, the cleaned text and the verdict `kept`."""
    held = docs.drop(*[c for c in OWN if c in docs.columns])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = held.withColumn("_text", t).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.split("_text", "\n", -1))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = repeated_words(out, "_words", "n_repeat_words").drop("_words")
    told = F.filter("_lines", lambda x: stripped(x) != "")
    out = out.withColumn("_told", told).withColumn("_failed", F.filter("_told", lambda x: ~line_passes(x)))
    chars = lambda lines: F.length(F.array_join(lines, ""))
    out = out.withColumn("word_chars", F.length(F.translate("_text", SPACE, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_told") - F.size(F.array_distinct("_told"))).cast("long"))
    out = out.withColumn("n_lines_removed", F.size("_failed").cast("long")).withColumn("lost_chars", chars(F.col("_failed")).cast("long"))
    out = out.withColumn("clean_text", F.array_join(F.filter("_lines", line_passes), "\n"))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(most_lost) * chars(F.col("_told"))))
    return out.drop("_text", "_lines", "_told", "_failed")


def op6_line_first(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    digest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars"]
    return line_first(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*digest)


ORACLE_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS told
  FROM base),
tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM hit, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
line AS (
  SELECT doc_id, x, regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS b
  FROM (SELECT doc_id, unnest(told) AS x FROM w)),
lost AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines_removed, sum(length(x))::BIGINT AS lost_chars FROM line
  WHERE NOT (regexp_matches(b, '[.!?:;…。！？]["''”’»)\]]*$') AND length(regexp_replace(b, '[^|»›•·>]', '', 'g')) <= 2
    AND NOT regexp_matches(b, '(?i)^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back|top|contact|contact us|about|about us|sitemap|share|subscribe)[.!:]?$')
    AND NOT regexp_matches(b, '(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|(uses|use of) cookies|enable javascript|powered by|click here|read more|lorem ipsum|copyright \(c\))'))
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(told) - len(list_distinct(told)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(lost_chars, 0) AS lost_chars,
         coalesce(list_sum(list_transform(told, lambda x: length(x))), 0) AS all_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * all_chars) AS kept,
       n_lines_removed, lost_chars
FROM m
"""
