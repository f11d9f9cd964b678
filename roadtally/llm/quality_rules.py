"""Quality rules as a ledger of failure bits.

Every rule is measured once a document; the ledger keeps the measurements and one bit for each
failed rule. A policy is a named, versioned mask: a document is kept if no bit of the mask is set.
``store_ledger`` writes the ledger without the texts; policies, their comparison and ablations are bit arithmetic over what is stored,
without reading a text again.

Defined results: a null text has no words; an empty one fails min_words; repeated rows each get
their row; extra columns stay.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtally.llm.common import words_of, written

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_run_words long, n_short_lines long"
SYMBOLS = "#*$%&|<>"
#: name -> SQL condition under which a document fails; its place is its bit, so names are only ever added at the end.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_words": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length_low": "word_chars < 2 * n_words",
    "word_length_high": "word_chars > 14 * n_words",
    "upper_case": "2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
    "run_words": "10 * n_run_words > 2 * n_words",
}
BASE = ("min_words", "repeat_words")
#: v2 is v1 without the rules on repeated lines and words, for corpora whose lines are deduplicated afterwards.
V1 = (*BASE, "symbol_words", "dup_lines", "word_length_low", "word_length_high", "upper_case", "few_letters", "run_words")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": V1, "v2": tuple(r for r in V1 if r not in ("dup_lines", "run_words"))}


def mask(policy: str | tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


@functools.cache
def letter_kinds() -> np.ndarray:
    """For each code point: 0 no letter, 1 a letter, 2 an upper-case one."""
    chars = [chr(k) for k in range(0x110000)]
    return np.array([c.isalpha() + (c.isalpha() and c.isupper()) for c in chars], np.uint8)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of width words that the text has twice or more."""
    if len(words) <= width:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    n = len(ids) - width + 1
    keys = ids[:n]
    for k in range(1, width):  # numbered anew after each word, so that products never overflow
        keys = np.unique(keys * len(index) + ids[k : k + n], return_inverse=True)[1].astype(np.int64)
    found = np.bincount(keys)[keys] > 1
    if not found.any():
        return 0
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : k + n] |= found
    return int(inside.sum())


def measured(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x and not x.isspace() or x.strip(" \t\n\r\x0b\x0c")]
    kinds = letter_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    run, last, same = 0, None, 0
    for w in words:
        same = same + 1 if w == last else 0
        run += same >= 2
        last = w
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(np.count_nonzero(kinds == 2)),
        int(np.count_nonzero(kinds)),
        run,
        sum(len(x) < 20 for x in lines),
    )


def measure(text: Column) -> Column:
    """A struct of the measurements."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in texts], columns=names, dtype="int64")

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(of, MEASURES).asNondeterministic()(text)  # else a filter on it would run it a second time


def ledger(docs: DataFrame, column: str = "rules") -> DataFrame:
    """docs with a struct column: the measurements and fail_bits."""
    m = f"`__{column}`"
    bits = " + ".join(f"CASE WHEN {_on(rule, m)} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    fields = [x.split()[0] for x in MEASURES.split(", ")]
    struct = f"named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, {m}.{f}' for f in fields)}, 'fail_bits', {bits})"
    return docs.withColumn(f"__{column}", measure(F.col("text").cast("string"))).withColumn(column, F.expr(struct)).drop(f"__{column}")


def store_ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, rules) of every document, written once: texts are measured here and never again."""
    own = [F.col(f"`{k}`") for k in keys]
    return written(ledger(docs.select(*own, "text")).select(*own, "rules"), "ledger")


def _on(rule: str, struct: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", rf"{struct}.\1", rule)


def passes(bits, policy: str | tuple[str, ...] = "v1"):
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(fail_bits: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy without it keeps.

    fail_bits: a DataFrame with that column. Counts are taken over distinct bit patterns, at most 2^rules rows.
    """
    whole = mask(policy)
    patterns = fail_bits.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = fail_bits.sparkSession.createDataFrame([(r, 1 << list(RULES).index(r)) for r in POLICIES[policy]], "rule string, bit long")
    both = rules.join(F.broadcast(patterns), F.expr("bits & bit != 0 OR bits = 0"), "left")
    hit = F.coalesce(F.sum(F.expr("CASE WHEN bits & bit != 0 THEN n END")), F.lit(0))
    only = F.coalesce(F.sum(F.expr("CASE WHEN bits = bit THEN n END")), F.lit(0))
    kept = F.coalesce(F.sum(F.expr("CASE WHEN bits = 0 OR bits = bit THEN n END")), F.lit(0))
    return both.groupBy("rule").agg(hit.alias("failed"), only.alias("failed_alone"), kept.alias("kept_without"))


def compare_policies(fail_bits: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(policy, other, kept, kept_by_other, only_policy, only_other) for each pair of policies, over distinct bit patterns.

    fail_bits: a DataFrame with that column."""
    whole = 0
    for p in policies:
        whole |= mask(p)
    patterns = fail_bits.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(p).alias("policy"), F.lit(q).alias("other"), passes(F.col("bits"), p).alias("a"), passes(F.col("bits"), q).alias("b")) for i, p in enumerate(policies) for q in policies[i + 1 :]]
    rows = patterns.select("n", F.explode(F.array(*pairs)).alias("p")).select("n", "p.*")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("policy", "other").agg(total(a).alias("kept"), total(b).alias("kept_by_other"), total(a & ~b).alias("only_policy"), total(b & ~a).alias("only_other"))


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    own = docs.columns
    name = "__rules"
    return ledger(docs, name).where(passes(F.col(f"{name}.fail_bits"), policy)).select(*[F.col(f"`{c}`") for c in own])


def ledger_sql() -> str:
    """The ledger b in DuckDB SQL: words unnested, windows of three counted."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
word AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM split),
near AS (SELECT rid, i, w, lag(w) OVER t AS w1, lag(w, 2) OVER t AS w2, lead(w) OVER t AS n1, lead(w, 2) OVER t AS n2 FROM word WINDOW t AS (PARTITION BY rid ORDER BY i)),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, n1, n2) AS c FROM near WHERE n2 IS NOT NULL),
inside AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY rid),
runs AS (SELECT rid, count(*) AS n FROM near WHERE w = w1 AND w = w2 GROUP BY rid),
m AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(i.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters, coalesce(r.n, 0) AS n_run_words
  FROM split s LEFT JOIN inside i USING (rid) LEFT JOIN runs r USING (rid)),
b AS (SELECT *, {bits} AS fail_bits FROM m)
"""


def oracle_sql() -> str:
    """The measurements and the current policy."""
    return f"""{ledger_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base")} <> 0 AS base_failed, fail_bits & {mask("v1") | mask("base")} = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""


def ablations_sql(policy: str = "v1") -> str:
    whole = mask(policy)
    rules = ", ".join(f"('{r}', {mask((r,))})" for r in POLICIES[policy])
    return f"""{ledger_sql()}
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & {whole} = bit) AS failed_alone, count(*) FILTER (fail_bits & {whole} IN (0, bit)) AS kept_without
FROM (VALUES {rules}) r(rule, bit) LEFT JOIN b ON true GROUP BY rule
"""


def policies_sql() -> str:
    names = list(POLICIES)
    pairs = ", ".join(f"('{p}', '{q}', {mask(p)}, {mask(q)})" for i, p in enumerate(names) for q in names[i + 1 :])
    return f"""{ledger_sql()}
SELECT policy, other, count(*) FILTER (fail_bits & x = 0) AS kept, count(*) FILTER (fail_bits & y = 0) AS kept_by_other, count(*) FILTER (fail_bits & x = 0 AND fail_bits & y <> 0) AS only_policy,
count(*) FILTER (fail_bits & y = 0 AND fail_bits & x <> 0) AS only_other FROM b, (VALUES {pairs}) p(policy, other, x, y) GROUP BY policy, other
"""
