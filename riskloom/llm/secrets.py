"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a file is content-addressed: its blob is the SHA-256 of its text.
The ledger records which (blob, rule version) pairs have been scanned and what was
found. An update scans only the pairs it has not seen, whatever paths they stand at,
and findings are joined back to all paths. Raising a rule's version rescans that
rule alone.

A rule's matches are leftmost and do not overlap; those whose value is too short are
dropped after matching. Spans are code points, end exclusive. They come from the
lengths of the matches and of the pieces between them, summed per blob and rule.

Defined results: NULL counts as empty text and has no findings; repeated rows get
equal results, one each; an empty table gives an empty result; columns other than
the path and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, load, saved, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must reach ``least``."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# A match of exactly the least length or more is a whole run of its class in ``access``
# and ``hex``, so that the length can stand in the pattern; in ``assign`` a short value
# also uses up text, so that it is matched first and dropped afterwards.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


@dataclass
class Ledger:
    """``seen``: blob, rule; ``findings``: blob, rule, kind, start, stop."""

    seen: DataFrame
    findings: DataFrame


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _matches(rule: Rule, text: Column) -> Column:
    """Per match: rule, index, length of the piece before it, its own length, whether the value is long enough."""
    pattern = F.lit(rule.pattern)
    whole, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else whole
    rows = F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("p"), whole.alias("m"), values.alias("v")),
        lambda r, i: F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.char_length(r["p"]).cast("long").alias("gap"),
            F.char_length(r["m"]).cast("long").alias("own"), (F.char_length(r["v"]) >= rule.least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<rule:string,kind:string,i:int,gap:bigint,own:bigint,ok:boolean>>")
    return F.when(text.rlike(rule.pattern), rows).otherwise(none)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings of distinct blobs (blob, text, todo: rules to apply, or no such column for all)."""
    text = F.col("text")
    each = []
    for rule in rules:
        found = _matches(rule, text)
        if "todo" in blobs.columns:
            found = F.when(F.array_contains("todo", rule.name), found).otherwise(F.slice(found, 1, 0))
        each.append(found)
    rows = blobs.select("blob", F.explode(F.concat(*each)).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("own")).over(upto)).filter("ok")
    return rows.select("blob", "rule", "kind", (F.col("stop") - F.col("own")).alias("start"), "stop")


def empty_ledger(spark) -> Ledger:
    none = lambda **kinds: spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    return Ledger(
        none(blob="binary", rule="string"),
        none(blob="binary", rule="string", kind="string", start="long", stop="long"),
    )


def update(versions: DataFrame, ledger: Ledger | None = None, rules=RULES, text_column: str = "text") -> Ledger:
    """The ledger after scanning what is new in ``versions`` (one row per path and version)."""
    text = text_or_empty(text_column)
    rows = versions.select(blob_of(text).alias("blob"), text.alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    ledger = ledger or empty_ledger(versions.sparkSession)
    pairs = rows.select("blob").distinct().select("blob", F.explode(names).alias("rule"))
    new = saved(pairs.join(ledger.seen.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti"), "ledger-new")
    todo = new.groupBy("blob").agg(F.collect_set("rule").alias("todo"))
    found = scan(rows.dropDuplicates(["blob"]).join(todo, "blob"), rules)
    return Ledger(
        saved(ledger.seen.select("blob", "rule").union(new), "ledger-seen"),
        saved(ledger.findings.union(found.select(*ledger.findings.columns)), "ledger-findings"),
    )


def current(ledger: Ledger, rules=RULES) -> DataFrame:
    """One row per blob with findings of the rules' current versions: blob, found (sorted spans)."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    live = ledger.findings.filter(F.col("rule").isin([r.name for r in rules]))
    item = F.struct("start", order[F.col("kind")].alias("rank"), "kind", "stop")
    return live.groupBy("blob").agg(F.array_sort(F.collect_set(item)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(versions: DataFrame, path_column: str = "doc_id", text_column: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """Findings at every path: doc_id, n_assign, n_access, n_hex, base_sha256, spans; ``ledger``: what is known already."""
    per_blob = current(update(versions, ledger, text_column=text_column))
    rows = versions.select(F.col(path_column).alias("doc_id"), blob_of(text_or_empty(text_column)).alias("blob"))
    out = rows.join(per_blob, "blob", "left")
    none = F.array().cast(per_blob.schema["found"].dataType)
    out = out.withColumn("found", F.coalesce("found", none))
    base_kinds = [r.kind for r in RULES if r.base]
    base = F.filter("found", lambda s: s["kind"].isin(base_kinds))
    count_of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    counts = [count_of(k).alias(f"n_{k}") for k in base_kinds]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"))


def redact(docs: DataFrame, mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; ``n_chars`` follows the text if there is such a column."""
    (blob, found) = fresh(docs, "_blob", "_found")
    per_blob = current(update(docs, ledger)).select(F.col("blob").alias(blob), F.col("found").alias(found))
    both = docs.withColumn(blob, blob_of(text_or_empty())).join(per_blob, blob, "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        clear = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.when(span["start"] >= state["at"], F.concat(state["out"], clear, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["stop"]).alias("at"),
        )

    cleaned = F.aggregate(F.col(found), start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    out = both.withColumn("text", F.when(F.col(found).isNull(), text).otherwise(cleaned))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out.select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in the texts are replaced; every document stays."""
    return redact(docs)


_ANY_CASE = "|".join(
    "".join("_?" if c == "?" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api?key")
)
_SQL_RULES = {
    "assign": (rf"(?:{_ANY_CASE})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),  # runs of the least length and more: shorter ones need no split
    "hex": ("[0-9a-f]{24,}", 0, 24),
    **{r.kind: (r.pattern, 0, 1) for r in RULES if not r.base},
}
ORACLE = "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\n" + ",\n".join(
    f"""m{i} AS (
  SELECT rid, i, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS v
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) AS i FROM d WHERE regexp_matches(text, '{p}'))),
s{i} AS (
  SELECT rid, '{k}' AS kind, {i} AS rank, stop - length(m[i]) AS start, stop FROM (
    SELECT *, length(array_to_string(pieces[1:i], '')) + length(array_to_string(m[1:i], '')) AS stop FROM m{i})
  WHERE length(v[i]) >= {least})"""
    for i, (k, (p, g, least)) in enumerate(_SQL_RULES.items())
) + ",\ns AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(_SQL_RULES))) + """),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
