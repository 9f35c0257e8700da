"""Quality rules, line first: rules judge each line, failing lines go, then documents that lost too much go."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
#: Phrases of page furniture, looked for in short lines.
BOILERPLATE = (
    "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "sign in", "log in", "sign up",
    "subscribe", "newsletter", "javascript", "click here", "read more", "share this", "skip to content", "back to top",
    "powered by", "lorem ipsum",
)
#: What may end a sentence, and what may close after it.
ENDS, CLOSERS = ".!?…。！？:;", "\"'”’»)]"
LETTER, CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")


@dataclass(frozen=True)
class Rules:
    """Parameters of the line rules and of the verdict on a document."""

    symbol_per_word: float = 0.3  #: a line with more symbol characters a word fails
    bars_per_word: float = 0.2  #: a line with more of its words being separators is navigation
    shout: float = 0.8  #: a line of three or more words with more of its words ending in !! fails
    short_words: int = 12  #: boilerplate phrases and missing punctuation count only in lines of fewer words
    max_loss: float = 0.5  #: a document that loses more of its words to failed lines goes
    least_words: int = 50
    most_repeat_pct: int = 50


def n_words(line: str) -> int:
    return len(line.encode("utf-8", "replace").split())  # bytes split at \x20 and \x09-\x0D alone


def line_fails(line: str, rules: Rules = Rules(), last: bool = False) -> str | None:
    """The first rule that a line fails, or None.  A line without a word passes (it holds no text)."""
    n = n_words(line)
    if not n:
        return None
    marks = sum(map(line.count, SYMBOLS))
    if marks > rules.symbol_per_word * n and marks >= 3:
        bars = line.count("|")
        return "navigation" if bars > rules.bars_per_word * n else "symbols"
    if n >= 3 and line.count("!!") > rules.shout * n:
        return "punctuation"
    if n < rules.short_words:
        if not LETTER.search(line):
            return "no letters"
        low = line.lower()
        if any(x in low for x in BOILERPLATE):
            return "boilerplate"
        if n >= 3 and not last and line.rstrip(WHITE).rstrip(CLOSERS)[-1:] not in ENDS and not CAPITAL.match(line):
            return "no sentence"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, back, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[back] >= 2
    if not hit.any():
        return 0
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def judge(doc_id: int, text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split at \x20 and \x09-\x0D alone
    n, lines = len(words), text.split("\n")
    full = [x for x in lines if x.strip(WHITE)]
    repeats = repeat_words(words)
    failed_base = n < rules.least_words or 100 * repeats > rules.most_repeat_pct * n
    kept, lost, failed = [], 0, 0
    for k, line in enumerate(lines):
        if line_fails(line, rules, k == len(lines) - 1):
            failed += 1
            lost += n_words(line)
        else:
            kept.append(line)
    keep = not failed_base and lost <= rules.max_loss * n
    chars = len(text) - sum(map(text.count, WHITE))
    return doc_id, n, chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeats, failed_base, keep, failed, lost, "\n".join(kept)


FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_failed_lines", pa.int64()), ("n_lost_words", pa.int64()), ("clean_text", pa.string()),
]


def clean_lines(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per document with its counts, verdict and (``with_text``) the text of its passing lines.

    No shuffle: a document is judged alone.  Null text counts as empty: no words, base_failed, not kept.
    Repeated rows each get a row; other columns are left out; an empty table gives an empty result.
    """
    fields = FIELDS if with_text else FIELDS[:-1]
    run = common.arrow_rows(fields, lambda doc_id, text: judge(doc_id, text, rules)[: len(fields)])
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return common.texts(docs).mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same counts and verdicts in SQL, by the default rules.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')))) AS i FROM d),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS g FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k, len(string_split(t, chr(10))) AS n_lines FROM d),
marked AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS marks, (length(line) - length(replace(line, '!!', ''))) / 2 AS shouts FROM split),
judged AS (SELECT *, n > 0 AND (marks > 0.3 * n AND marks >= 3 OR n >= 3 AND shouts > 0.8 * n OR n < 12 AND (NOT regexp_matches(line, '\p{{L}}')
  OR len(list_filter({_sql_list(BOILERPLATE)}, lambda b: contains(lower(line), b))) > 0
  OR n >= 3 AND k < n_lines - 1 AND NOT regexp_matches(line, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '^\p{{Lu}}'))) AS fails FROM marked),
l AS (SELECT doc_id, count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words FROM judged GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, l.n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words, l.n_failed_lines, l.n_lost_words
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.5 * n_words AS kept,
  CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(n_lost_words AS BIGINT) AS n_lost_words
FROM a
"""
