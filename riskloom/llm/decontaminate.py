"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts are cut into words; a window is ``WINDOW`` consecutive words. Of the hashes
of all k-grams inside a window the least is the window's fingerprint, so that
equal windows always have equal fingerprints and neighbouring windows mostly share
one. Documents and benchmark are joined on fingerprints; the windows behind each
hit are then extended to their full words and compared with the benchmark's, which
makes the result exact: every shared span of ``WINDOW`` words is found, and
nothing else.

An item of fewer words than a window (but at least one) is one window of its own
length; such windows are compared by the hash of the whole window, then by words.

Defined results: NULL and empty texts have no words, hence no windows and no hits;
repeated rows get equal results, one each; items that repeat count by distinct id, an
item without id covers words but is not counted;
an empty benchmark leaves every document clean; columns other than the ids and the
texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, load, row_key, saved, text_or_empty

WINDOW = 10
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SEPARATOR), lambda w: w != "")


def _positions(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_fingerprints(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``fps``: per window start the least hash of the window's k-grams. Needs ``words``."""
    step1 = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    step2 = step1.withColumn(
        "_g", F.transform(_positions(F.size("_h") - (gram - 1)), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(gram)]))
    )
    return step2.withColumn(
        "fps",
        F.transform(
            _positions(F.size("words") - (window - 1)), lambda i: F.least(*[F.get("_g", i + j) for j in range(window - gram + 1)])
        ),
    ).drop("_h", "_g")


def _window_rows(df: DataFrame, keys: list[str], chosen, window: int) -> DataFrame:
    """Rows (keys, at, fp, span) for the windows that ``chosen(fp)`` takes; span is the window's words."""
    starts = F.filter(
        F.transform("fps", lambda f, i: F.struct(i.alias("at"), f.alias("fp"))), lambda w: chosen(w["fp"])
    )
    rows = df.select(*keys, "words", F.explode(starts).alias("w"))
    return rows.select(*keys, "w.at", "w.fp", F.array_join(F.slice("words", F.col("w.at") + 1, window), " ").alias("span"))


def _short_rows(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """Rows (keys, at, fp, n) for all windows of the given lengths; fp is the hash of the words."""

    def spans_of(n):
        name = lambda i: F.xxhash64(F.lit(n), *[F.get("_h", i + j) for j in range(n)])
        return F.transform(_positions(F.size("_h") - (n - 1)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), name(i).alias("fp")))

    hashed = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.select(*keys, F.explode(F.concat(*map(spans_of, lengths))).alias("w")).select(*keys, "w.at", "w.n", "w.fp")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(items, hits): items are (span, item_id); hits are (key, at, n, span), exact occurrences."""
    items = benchmark.select(F.col("item_id"), words(text_or_empty()).alias("words"))
    long_items = with_fingerprints(items.filter(F.size("words") >= window), window, gram)
    short = items.filter(F.size("words").between(1, window - 1))
    spans = saved(
        _window_rows(long_items, ["item_id"], lambda fp: F.lit(True), window)
        .select("item_id", "fp", "span", F.lit(window).alias("n"))
        .union(
            short.select(
                "item_id", F.lit(None).cast("long"), F.array_join("words", " "), F.size("words").alias("n")
            )
        )
        .distinct(),
        "benchmark-windows",
    )
    rows = docs.select(row_key().alias("key"), words(text_or_empty()).alias("words"))
    full = spans.filter(F.col("n") == window)
    # 1. documents that share a fingerprint, and which
    fingerprints = saved(full.select(F.col("fp").alias("hit_fp")).distinct(), "benchmark-fingerprints")
    printed = with_fingerprints(rows, window, gram).select("key", F.explode(F.array_distinct("fps")).alias("fp"))
    shared = printed.join(fingerprints, F.col("fp") == F.col("hit_fp"), "left_semi")
    wanted = shared.groupBy("key").agg(F.collect_set("fp").alias("wanted"))
    # 2. the windows behind those fingerprints, compared word by word
    again = docs.select(row_key().alias("key"), F.col("text")).join(wanted, "key")
    again = again.dropDuplicates(["key"]).select("key", "wanted", words(text_or_empty()).alias("words"))
    again = with_fingerprints(again, window, gram)
    extended = _window_rows(again, ["key", "wanted"], lambda fp: F.array_contains("wanted", fp), window)
    known = saved(full.select("span").distinct(), "benchmark-spans")
    hits = extended.join(known, "span", "left_semi").select("key", "at", F.lit(window).alias("n"), "span")
    # 3. items shorter than a window, by the hash of the whole item
    lengths = sorted(r.n for r in spans.filter(F.col("n") < window).select("n").distinct().collect())  # at most window - 1
    if lengths:
        brief = spans.filter(F.col("n") < window)
        hashed = brief.select(
            "span", F.col("n").alias("span_n"),
            F.transform(F.split("span", " "), lambda w: F.xxhash64(w)).alias("h"),
        )
        by_length = None
        for n in lengths:
            part = hashed.filter(F.col("span_n") == n).select("span", "span_n", F.xxhash64(F.lit(n), *[F.get("h", F.lit(j)) for j in range(n)]).alias("hit_fp"))
            by_length = part if by_length is None else by_length.union(part)
        by_length = saved(by_length.distinct(), "benchmark-short")
        found = _short_rows(rows, ["key"], lengths).join(by_length, (F.col("fp") == F.col("hit_fp")) & (F.col("n") == F.col("span_n")))
        found = found.select("key", "at", "n", "span").distinct()
        texts = docs.select(row_key().alias("key"), F.col("text")).join(found.select("key").distinct(), "key", "left_semi")
        texts = texts.dropDuplicates(["key"]).select("key", words(text_or_empty()).alias("words"))
        sure = found.join(texts, "key").filter(
            F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ") == F.col("span")
        )
        hits = hits.union(sure.select("key", "at", "n", "span"))
    return spans.select("span", "item_id").distinct(), hits


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items, hits = find(docs, benchmark, window, gram)
    hits = saved(hits, "benchmark-hits")  # read twice below
    covered = hits.groupBy("key").agg(
        F.size(
            F.array_distinct(
                F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1)))
            )
        ).cast("long").alias("n_hit")
    )
    matched = (
        hits.select("key", "span").distinct().join(items, "span").select("key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = covered.join(matched, "key").select(
        F.col("key").alias("_key"), "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items")
    )
    rows = docs.select("doc_id", row_key().alias("key"), F.size(words(text_or_empty())).cast("long").alias("n_words"))
    out = rows.join(found, F.col("key") == F.col("_key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with any benchmark window go."""
    _, hits = find(docs, load(spark, sf_dir, "benchmark"))
    return drop_rows(docs, hits)


def drop_rows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a hit; columns and repeats unchanged."""
    (name,) = fresh(docs, "_row_key")
    gone = hits.select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(gone, name, "left_anti").drop(name)


_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_RE}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_RE}') AS w FROM benchmark),
bn AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN its USING (rid)
"""
