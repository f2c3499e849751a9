"""Line-first quality rules, in built-in functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed, and a document
that loses too much of its text this way, or that fails the base rules, is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import project

#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Words of a window, and the shares in percent.
WINDOW, REPEAT_SHARE, LEAST_WORDS = 8, 30, 20
#: A document that keeps less of its words' lines (in percent of its characters in lines with a word) is rejected.
LEAST_KEPT = 60
#: Wording of notices and of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
    "sign up for", "subscribe to our", "click here", "share this", "powered by", "alle rechte vorbehalten", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken",
    "tous droits", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "todos los derechos", "aceptar cookies", "haga clic",
)
#: A line with this many bars or arrows and more is navigation.
BARS, MOST_BARS = "[|»›>•·]", 3
#: Fixed value: how a finished line ends.
ENDING = """[.!?…:;"'”’»)\\]][\\x20\\x09-\\x0D]*\\z"""
#: A line of fewer characters other than blanks that doesn't end so is a heading, a menu's item or a scrap.
SHORT = 60
#: Percent of a line's characters other than blanks that symbols, and exclamation and question marks, may make up.
SYMBOL_SHARE, MARK_SHARE = 10, 10
#: Symbols that a line may not be full of.
_SYMBOLS, _MARKS = r"[#*$%&|<>{}\[\]~^_=+\\]+", "[!?]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a plain column that is used once, inside a lambda, would be put there and computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _holds_boilerplate(text: Column) -> Column:
    """Whether a phrase is in the text."""
    phrases = F.array(*map(F.lit, BOILERPLATE))
    return once(F.lower(text), lambda low: F.exists(phrases, lambda phrase: F.contains(low, phrase)))


def line_fails(line: Column, furniture: Column | None = None) -> Column:
    """Whether a line that has a word fails: short and unfinished (no punctuation at its end), shouting or symbols, navigation, boilerplate.

    ``furniture``: whether boilerplate is in the text at all, if that is known; lines of a text without it aren't searched.
    """
    count = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    dense = F.length(F.replace(line, F.lit(" "), F.lit("")))
    boilerplate = _holds_boilerplate(line)
    return (
        ((dense < SHORT) & ~line.rlike(ENDING))
        | (count(_SYMBOLS) * 100 > dense * SYMBOL_SHARE)
        | (count(_MARKS) * 100 > dense * MARK_SHARE)
        | (count(BARS + "+") >= MOST_BARS)
        | (boilerplate if furniture is None else furniture & boilerplate)
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, kept_percent, base_failed, kept, and ``clean_text`` (its lines that pass).

    Each line is judged once, and the flag kept beside it.  A null text counts as empty: no words, base_failed.  A text
    whose lines all lack words has kept_percent 0.  Repeated rows are judged each, null ids are carried, other columns
    are ignored, an empty table gives no rows.  No shuffle, no Python; time is n log n in a text's words.  Words are
    hashed once, and windows compared by a 64-bit hash of their words' hashes within one text.
    """
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    step = project(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    fails = once(_holds_boilerplate(F.col("text")), lambda furniture: F.transform("lines", lambda x: line_fails(x, furniture)))
    places = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.when(
        F.size("words") > WINDOW,
        once(F.transform("words", lambda w: F.xxhash64(w)), lambda hashes: F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select("doc_id", "text", "words", "lines", fails.alias("fails"), windows.alias("windows"))
    # the places of windows that occur twice or more, rising: neighbours in the order of (window, place) are equal
    ranked = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    step = step.withColumn("ranked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ranked).otherwise(F.array().cast("array<struct<w:bigint,i:int>>")))
    equal = lambda k, w: F.coalesce(F.get("ranked", k)["w"] == w, F.lit(False))
    places = F.sort_array(F.transform(F.filter("ranked", lambda x, k: equal(k - 1, x["w"]) | equal(k + 1, x["w"])), lambda x: x["i"]))
    step = step.withColumn("places", places)
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    total = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda a, n: a + n)
    failed_lines = F.zip_with("lines", "fails", lambda x, bad: F.when(bad, F.length(x)).otherwise(0))
    step = step.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        total(F.transform("words", F.length)).alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("fails", lambda bad: bad)).cast("bigint").alias("n_bad_lines"),
        total(F.transform("lines", F.length)).alias("line_chars"),
        total(failed_lines).alias("bad_chars"),
        F.array_join(F.transform(F.filter(F.arrays_zip("lines", "fails"), lambda x: ~x["fails"]), lambda x: x["lines"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    share = F.when(F.col("line_chars") > 0, F.floor(100 * (F.col("line_chars") - F.col("bad_chars")) / F.col("line_chars"))).otherwise(0).cast("bigint")
    step = step.withColumn("kept_percent", share).withColumn("base_failed", failed)
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("kept_percent") >= LEAST_KEPT)).drop("line_chars", "bad_chars")


DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "kept_percent", "base_failed", "kept", "clean_chars", "clean_sha256")


def digest(rules: DataFrame) -> DataFrame:
    """DIGEST: the verdicts, and the cleaned text's length and SHA-256."""
    return rules.withColumn("clean_chars", F.length("clean_text").cast("bigint")).withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).select(*DIGEST)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)),
wc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
win AS (SELECT r, i, string_agg(w, chr(1)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM words),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win WHERE n = 8),
rp AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM rep WHERE c > 1),
rw AS (SELECT r, sum(least(8, coalesce(j - i, 8))) AS n_repeat_words FROM rp GROUP BY r),
lines AS (SELECT r, p, l, length(l) AS chars, length(replace(l, ' ', '')) AS n,
  length(l) - length(regexp_replace(l, '[#*$%&|<>{}\[\]~^_=+\\]', '', 'g')) AS sy, length(l) - length(regexp_replace(l, '[!?]', '', 'g')) AS ma, length(l) - length(regexp_replace(l, '[|»›>•·]', '', 'g')) AS bars
  FROM (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (SELECT *, (sy * 100 > n * 10 OR ma * 100 > n * 10 OR bars >= 3 OR n < 60 AND NOT regexp_matches(l, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*\z')
  OR len(list_filter([PHRASES], lambda p: contains(lower(l), p))) > 0) AS bad FROM lines),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_bad_lines, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE bad), 0) AS bad_chars, string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT bad) AS clean FROM judged GROUP BY r),
j AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines,
  CASE WHEN chars > 0 THEN floor(100 * (chars - bad_chars) / chars) ELSE 0 END AS kept_percent, coalesce(clean, '') AS clean
  FROM d LEFT JOIN wc USING (r) LEFT JOIN rw USING (r) LEFT JOIN lc USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, kept_percent::BIGINT AS kept_percent,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_percent >= 60) AS kept, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256
FROM j
""".replace("PHRASES", ", ".join("'" + p.replace("'", "''") + "'" for p in BOILERPLATE))
