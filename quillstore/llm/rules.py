"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Base signals are computed for every whole text. Texts that pass the base rules meet further rules one after another. A
bounded, seeded sample of rows gives, in one job, the share that each rule rejects and its cost, and the rules run by
falling rejection per cost. Cost is counted in steps and not in seconds, so that equal tables give equal orders: a rule
says in SQL how many steps a row takes it (such as the characters its patterns read), and the sample has the rows. A CASE
expression stops at the first rule that rejects, so costly rules see only what cheap ones leave. The order changes how
much work is done, never the verdict.

Null or empty text: no words, all signals 0, base_failed true. Very long texts are judged whole. Repeated rows are judged
alike; of rules that tie, the first by name runs first. Columns of the input that have a signal's name are replaced, all
others are kept, whatever their names. Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import WORD

#: Rows of the sample on which cost and selectivity are estimated, those with the least seeded hashes.
SAMPLE_ROWS, SEED = 500, 7

#: name: (SQL that is true where a text is rejected, SQL of the steps that takes). Both may use the signals, _text,
#: _words and _lines. A step is about one comparison of numbers; a pattern takes some 4 steps a character.
RULES = {
    "mean_word_length": ("word_chars < 2 * n_words or word_chars > 20 * n_words", "2"),
    "symbols": ("10 * n_symbols > 3 * n_words", "1"),
    "duplicate_lines": ("2 * n_dup_lines > size(_lines)", "1"),
    "letterless_words": ("10 * size(filter(_words, w -> not w rlike '\\\\p{L}')) > 4 * n_words", "10 * n_words + 4 * word_chars"),
    "overlong_words": ("exists(_words, w -> length(w) > 200)", "n_words + word_chars"),
}

#: What `signals` and `judge` add.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once (the optimizer may copy a column into its uses)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str, w: int) -> str:
    """SQL: words that lie in windows of w words that occur twice or more."""
    window = ", ".join(f"get(h, i + {k})" for k in range(w))  # slice() would copy the whole array each time
    places = "filter(s, (x, k) -> (k > 0 and get(s, k - 1).h = x.h) or (k + 1 < size(s) and get(s, k + 1).h = x.h))"
    count = f"aggregate(p, named_struct('last', -{w}, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least({w}, x - a.last)), a -> a.n)"
    count = _let("p", f"sort_array(transform({places}, x -> x.i))", count)
    count = _let("s", "sort_array(transform(v, (x, i) -> named_struct('h', x, 'i', i)))", count)
    count = _let("v", f"transform(sequence(0, size(h) - {w}), i -> xxhash64({window}))", f"if(size(array_distinct(v)) = size(v), 0L, {count})")
    return f"if(size({words}) < {w}, 0L, {_let('h', f'transform({words}, x -> xxhash64(x))', count)})"


def signals(docs: DataFrame, text: str = "text", windows: int = 5) -> DataFrame:
    """_in (a row of docs) with _text, _words, _lines, and the signals.

    Words in repeated windows are counted without comparing windows pairwise: window hashes are sorted with their
    places, equal neighbours mark places, and the marked stretches are joined. That is n log n, and most texts stop at
    the check that all hashes differ.
    """
    return (
        docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_in"), F.coalesce(docs[text], F.lit("")).alias("_text"))
        .withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        .withColumn("_lines", F.expr(rf"filter(split(_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.expr(_repeat_words("_words", windows)))
        .withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    )


def rule_order(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> list[str]:
    """Rule names by rejection per cost, measured on at most sample_rows rows that pass the base rules or not."""
    plain = [docs[f.name] for f in docs.schema if isinstance(f.dataType, (T.StringType, T.NumericType, T.DateType, T.TimestampType))]
    drawn = docs.select(docs[text].alias("text"), F.xxhash64(F.lit(seed), *plain).alias("h")).orderBy("h").limit(sample_rows)
    found = signals(drawn).where("not base_failed").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(f"cast({sql} as int)")).alias(f"r_{k}") for k, (sql, _) in rules.items()],
        *[F.sum(F.expr(f"cast({steps} as double)")).alias(f"c_{k}") for k, (_, steps) in rules.items()],
    ).first().asDict()  # one row
    if not found["n"]:
        return sorted(rules)
    gain = {k: (found[f"r_{k}"] + 1) / max(found[f"c_{k}"], 1.0) for k in rules}  # one more: rules that rejected none differ in cost
    return sorted(rules, key=lambda k: (-gain[k], k))


def judge(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, str]] = RULES, order: list[str] | None = None) -> DataFrame:
    """docs with the signals, base_failed and kept."""
    order = order or rule_order(docs, text, rules)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        verdict = verdict.when(F.expr(rules[name][0]), F.lit(False))
    own = [F.col("_in")[c].alias(c) for c in docs.columns if c not in (*SIGNALS, "kept")]
    return signals(docs, text).select(*own, *SIGNALS, verdict.otherwise(F.lit(True)).alias("kept"))


#: The base signals and the verdict in DuckDB SQL, for documents with distinct doc_id.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram FROM w),
twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
s AS (SELECT doc_id, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > len(lines)
  OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 4 * n_words OR len(list_filter(words, lambda x: length(x) > 200)) > 0) AS kept
FROM b
"""
