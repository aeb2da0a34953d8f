"""Quality rules (8): line-first cleaning. Punctuation, navigation and boilerplate rules judge each line; failing
lines go; then a document that lost too much of its text is rejected.

Everything is one projection and one filter over array columns: no shuffle, no Python.

Defined cases: a null or blank text has no text to keep, so the document is rejected. Blank lines are dropped and are no loss.
A long document is judged like any other, line by line. Equal lines are judged alike (repetition is line dedup's task). Null in any
other column passes through. Rows that repeat stay as often as they come. Of an empty table comes an empty one. Extra columns
stay; columns named like the ones added here are overwritten by them.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line passes the punctuation rule if it ends in punctuation (any number of closing quotes and brackets may follow)...
ENDS, CLOSERS = tuple(".!?:;,\u2026\u3002"), "\"')]\u00bb\u201d\u2019"
#: ...or holds the end of a sentence, as a line does that is cut off in its last sentence...
STOPS = (". ", "! ", "? ", "\u3002", "\u2026 ")
#: ...and if at most this share of its characters are symbols or pairs of exclamation or question marks.
MAX_SYMBOLS = 0.10
SYMBOLS = "[#$%&*<>={}\\x{5B}\\x{5D}\\^~|+@]"
PAIRS = ("!!", "??")
#: Navigation: so many separators in a line, or nothing but a link label.
SEPARATORS = (("|", 2), ("\u00bb", 2), ("\u2022", 3))
LABEL, LABEL_CHARS = "^\\s*(home|menu|login|log in|sign in|sign up|next|previous|back to top|read more|share|search)\\s*[.!:]?\\s*$", 30
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright (c)", "powered by", "subscribe to our", "click here", "accept cookies")
#: Least share of a document's characters (in lines that aren't blank) that must be left.
MIN_KEPT = 0.5


def line_ok(line: Column) -> Column:
    """Plain string functions wherever they do: regular expressions cost ten times as much a character."""
    without = lambda part: F.length(line) - F.length(F.replace(line, F.lit(part), F.lit("")))
    contains = lambda text, parts: reduce(or_, (F.contains(text, F.lit(x)) for x in parts))
    symbols = reduce(add, map(without, PAIRS), F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, "")))
    navigation = reduce(or_, (without(mark) >= n for mark, n in SEPARATORS))
    phrases = F.exists(F.array(F.lower(line)), lambda low: contains(low, BOILERPLATE) | ((F.length(line) <= LABEL_CHARS) & low.rlike(LABEL)))
    return ~navigation & (F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1)).isin(*ENDS) | contains(line, STOPS)) & (symbols <= MAX_SYMBOLS * F.length(line)) & ~phrases


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, through which no filter is pushed: else the optimizer would copy these costly expressions to each of their uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def clean_lines(docs: DataFrame, text: str = "text", min_kept: float = MIN_KEPT) -> DataFrame:
    """docs with the text's failing lines removed, n_lines, n_lines_kept and kept_ratio added, and rejected documents gone."""
    added = ("n_lines", "n_lines_kept", "kept_ratio", "_q_lines", "_q_good")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.rtrim(x, F.lit(" \t\r"))), lambda x: x != "")
    total = lambda c: F.aggregate(F.col(c), F.lit(0), lambda a, x: a + F.length(x)).cast("double")
    judged = _once(_once(docs.drop(*added), _q_lines=lines), _q_good=F.filter("_q_lines", line_ok))
    judged = _once(judged, kept_ratio=F.when(F.size("_q_lines") > 0, total("_q_good") / total("_q_lines")))
    columns = {"n_lines": F.size("_q_lines").cast("bigint"), "n_lines_kept": F.size("_q_good").cast("bigint"), text: F.array_join("_q_good", "\n")}
    return judged.filter(F.col("kept_ratio") >= min_kept).withColumns(columns).drop("_q_lines", "_q_good")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean_lines(docs).select("doc_id", "lang", "source", "n_lines", "n_lines_kept", F.round("kept_ratio", 6).alias("kept_ratio"), "text")


_Q = lambda s: "'" + s.replace("'", "''") + "'"

_ANY = lambda x, parts: "(" + " OR ".join(f"contains({x}, {_Q(p)})" for p in parts) + ")"
_N = lambda p: f"(length(x) - length(replace(x, {_Q(p)}, '')))"
_OK = f"""NOT ({' OR '.join(f'{_N(m)} >= {n}' for m, n in SEPARATORS)}) AND (right(rtrim(x, {_Q(CLOSERS)}), 1) IN ({', '.join(map(_Q, ENDS))}) OR {_ANY('x', STOPS)})
 AND length(x) - length(regexp_replace(x, {_Q(SYMBOLS)}, '', 'g')) + {' + '.join(map(_N, PAIRS))} <= {MAX_SYMBOLS} * length(x)
 AND NOT ({_ANY('lower(x)', BOILERPLATE)} OR length(x) <= {LABEL_CHARS} AND regexp_matches(lower(x), {_Q(LABEL)}))"""

#: The rules in DuckDB's SQL, over a table with doc_id, text, lang, source.
CLEANED_SQL = f"""
SELECT doc_id, lang, source, n_lines, n_lines_kept, good_len::DOUBLE / all_len AS kept_ratio, array_to_string(good, chr(10)) AS text
FROM (SELECT *, len(lines)::BIGINT AS n_lines, len(good)::BIGINT AS n_lines_kept,
        list_sum(list_transform(lines, lambda x: length(x))) AS all_len,
        coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS good_len
      FROM (SELECT *, list_filter(lines, lambda x: {_OK}) AS good
            FROM (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))),
                    lambda x: x <> '') AS lines FROM {{docs}})))
WHERE len(lines) > 0 AND good_len::DOUBLE / all_len >= {MIN_KEPT}
"""
ORACLE = f"SELECT doc_id, lang, source, n_lines, n_lines_kept, round(kept_ratio, 6) AS kept_ratio, text FROM ({CLEANED_SQL.replace('{docs}', 'documents')})"
