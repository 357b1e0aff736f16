"""Quality rules as a bitmask ledger.

Every document is measured once and every rule is evaluated once; the ledger row
holds the measurements and ``fail_bits`` (bit i: rule i failed). Policies are
versioned sets of rules, i.e. masks over those bits, so that a new policy or an
ablation reads the ledger and never the texts.

Defined results: a NULL or empty text has no words, measurements 0, and fails
``few_words``; repeated rows get equal ledger rows, one each; an empty table
gives an empty ledger; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textnum as T
from riskloom.llm.common import text_or_empty

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = T.byte_class(b"[#*$%&|<>]"[1:-1])

# name -> condition under which a document fails; the position is the bit
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "dup_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")
# version -> rules that a kept document must pass
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "dup_lines", "long_words"),
}


def repeated_cover(words: np.ndarray, window: int = WINDOW) -> int:
    """Number of words inside windows of ``window`` words that occur twice or more."""
    grams = T.windows(words, window)
    if len(grams) < 2:
        return 0
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.flatnonzero(np.isin(grams, again))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def _measure_text(text: np.ndarray) -> tuple[int, ...]:
    starts, ends = T.word_bounds(text)
    counted = ~T.SPACE[text] & ((text & 0xC0) != 0x80)
    lines, seen, again = 0, set(), 0
    for line in text.tobytes().split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    repeat = repeated_cover(T.word_hashes(text, starts, ends)) if len(starts) > WINDOW else 0
    return len(starts), int(counted.sum()), int(_SYMBOL[text].sum()), lines, again, repeat


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id and the measurements of the whole text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [_measure_text(t) for t in T.byte_rows(batch.column(1))]
            columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    return rows.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{m} long" for m in MEASURES))


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and failure bits of every document."""
    return measure(docs, id_column, text_column).withColumn("fail_bits", fail_bits())


def passes(policy: str) -> Column:
    """Whether a ledger row passes every rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablate(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it.

    The ledger is first reduced to its distinct bit patterns (at most 2**rules);
    everything after that is bitwise aggregation over those few rows.
    """
    whole = mask(POLICIES[policy])
    counts = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    n = F.col("n")
    return each.groupBy("rule").agg(
        F.sum(n).alias("n_docs"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from riskloom.llm.common import load

    rows = ledger(load(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE_RULES)).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        base.alias("base_failed"), (~base & passes("v2")).alias("kept"),
    )


_SPACE_SQL = r"\x20\x09-\x0D"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^{_SPACE_SQL}]+') AS words FROM d),
g AS (
  SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}
),
gram AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM g),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM gram) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM line WHERE regexp_matches(line, '[^{_SPACE_SQL}]') GROUP BY rid
),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)
),
b AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))} AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  fail_bits & {mask(BASE_RULES)} <> 0 AS base_failed, fail_bits & {mask(POLICIES["v2"])} = 0 AS kept
FROM b
"""
