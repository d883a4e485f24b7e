"""Secret scans over a ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text, its blob. A blob is scanned once for each
version of each rule, however many paths and versions hold it; the ledger keeps what each blob gave, and findings return
to all paths by a join on the blob. A run over an earlier ledger scans only pairs of blob and rule version that it lacks.

Native: DataFrame functions only.

Defined results: a null text counts as the empty text. Texts of any length are scanned whole. Spans that start together are in the
order of their kinds. Rows are never merged: repeated rows, and rows with null or repeated ids, each get their blob's findings. An
empty table gives an empty result. Other columns are kept, whatever their names, but for text and those with the name of a result
column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import matches, table
from cargolens.operators.joins import likely, unlikely


@dataclass(frozen=True)
class Rule:
    """A Java regular expression, and a predicate over a match's text. A new version makes every blob unseen for the rule."""

    name: str
    version: int
    pattern: str
    keep: Callable[[Column], Column] | None = None


# The patterns of the contract. Possessive runs give the same matches without going back over long texts.
KEYWORD = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", 1, rf"(?i){KEYWORD}[A-Za-z0-9+/_.=-]+", lambda m: F.length(F.regexp_replace(m, rf"^(?i){KEYWORD}", "")) >= 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", 1, r"[0-9a-f]{32,}+"),
    # Beyond the base kinds: armoured private keys.
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: One row for each blob and run: the rule versions applied, and all that they found.
SPANS = "array<struct<start:bigint,rule:string,end:bigint,version:int>>"
LEDGER = f"blob string, applied array<struct<rule:string,version:int>>, found {SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def versions_of(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, applied): the rule versions that the ledger lacks, for blobs (blob) that lack some."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("applied"))).alias("seen"))
    todo = blobs.select("blob").distinct().join(seen, "blob", "left")
    none = F.array().cast("array<struct<rule:string,version:int>>")
    return todo.select("blob", F.array_except(versions_of(rules), F.coalesce("seen", none)).alias("applied")).where(F.size("applied") > 0)


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, applied): only the rule versions in applied are run."""

    def found(r: Rule) -> Column:
        hits = matches(F.col("text"), r.pattern)
        kept = F.filter(hits, lambda m: r.keep(m["word"])) if r.keep else hits
        spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(r.name).alias("rule"), m["end"].alias("end"), F.lit(r.version).alias("version")))
        new = F.exists("applied", lambda a: (a["rule"] == r.name) & (a["version"] == r.version))
        return F.when(new, spans).otherwise(F.array().cast(SPANS))

    return todo.select("blob", "applied", F.concat(*map(found, rules)).alias("found"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions with blob and found, new ledger rows) for a table of document versions; text: the column of their texts.

    Only hashes are compared with the ledger; texts of blobs that it has whole stay where they are if the list of the others is small
    enough for Spark to broadcast. One text of each blob is kept before the shuffle, so that a text which a third of all rows share
    travels once from each task. The new ledger rows are a written table: the join that brings findings back reads both sides by
    shuffles which Spark can split. What a version of a rule found counts only while that version is in force."""
    addressed = versions.withColumn("blob", blob_of(F.col(text)))
    new = _new_rows(addressed, ledger, rules, text)
    keep = [c for c in addressed.columns if c.lower() not in ("found", "text")]
    return _with_found(addressed.select(*keep), _known(new, ledger, rules)), new


def _new_rows(addressed: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """The ledger's new rows for versions with their blob, as a written table."""
    each = addressed.select("blob", F.coalesce(text, F.lit("")).alias("text"))
    if ledger is None:
        todo = each.groupBy("blob").agg(F.first("text").alias("text")).withColumn("applied", versions_of(rules))
    else:
        lacking = table(unseen(each, ledger, rules), "unseen-blobs")
        some = each.join(lacking.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        todo = some.join(lacking, "blob")
    return table(scan(todo, rules), "ledger")


def _known(new: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found): what the rule versions in force found, for blobs with findings."""
    runs = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    in_force = F.filter("found", lambda s: F.array_contains(versions_of(rules), F.struct(s["rule"].alias("rule"), s["version"].alias("version"))))
    known = runs.select("blob", in_force.alias("found")).where(F.size("found") > 0)
    if ledger is not None:  # rules of a blob may have been run at different times
        known = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return known


def _with_found(addressed: DataFrame, known: DataFrame) -> DataFrame:
    return addressed.join(known, "blob", "left").withColumn("found", F.sort_array(F.coalesce("found", F.array().cast(SPANS))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def by_start(found: Column, order: tuple[str, ...]) -> Column:
    """Sorted by start, then by the kind's place in order."""
    place = lambda s: F.array_position(F.array(*map(F.lit, order)), s["rule"])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), place(s).alias("at"), s["rule"].alias("rule"), s["end"].alias("end")))
    return F.sort_array(keyed)


def redact(documents: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every found span replaced by mask (spans that overlap give one); n_chars, if there, is counted again."""
    addressed = documents.select(F.struct(*documents.columns).alias("row")).withColumn("blob", blob_of(F.col("row.text")))
    known = _known(_new_rows(addressed, None, RULES, "row.text"), None, RULES)
    # Rows travel only where a bit map says that their blob may have findings.
    found = _with_found(likely(addressed, "blob", known), known)
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    part = lambda at, size: whole.substr(at.cast("int") + 1, size.cast("int"))

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(part(acc["at"], s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), part(acc["at"], F.length(whole)))

    cleaned = found.withColumn("cleaned", F.aggregate("found", begin, cut, finish))
    row = F.col("row").withField("text", F.col("cleaned"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("cleaned").cast(documents.schema["n_chars"].dataType))
    masked = cleaned.select(F.when(F.size("found") > 0, row).otherwise(F.col("row")).alias("row"))
    return unlikely(addressed, "blob", known).select("row").unionByName(masked).select("row.*")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = scan_versions(docs)
    everything = by_start(F.col("found"), (*BASE, *(r.name for r in RULES if r.name not in BASE)))
    base = F.filter("spans_", lambda s: s["rule"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans_", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("spans_", everything).select("doc_id", *map(count, BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans_")).alias("spans"))


def _sql_spans(rule: str, pattern: str, keep: str = "true") -> str:
    """SQL for (rid, start, rule, end) of a pattern's matches: what lies between them and the matches give the places."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, CAST(m.e - length(m.w) AS BIGINT) AS s, '{rule}' AS rule, m.e AS e FROM (
SELECT rid, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(w := ms[i], e := CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS BIGINT)))) AS m
FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}'))) WHERE {keep}"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_sql_spans("assign", "(?i)" + KEYWORD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m.w, '^(?i:{KEYWORD.replace(chr(39), chr(39) * 2)})', '')) >= 8")}
UNION ALL {_sql_spans("access", "AKIA[A-Z0-9]{12,}")} UNION ALL {_sql_spans("hex", "[0-9a-f]{32,}")} UNION ALL {_sql_spans("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")}),
g AS (SELECT rid, count_if(rule = 'assign') AS a, count_if(rule = 'access') AS b, count_if(rule = 'hex') AS c,
  string_agg(rule || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex', 'pem'], rule)) AS spans,
  string_agg(rule || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex'], rule)) FILTER (rule <> 'pem') AS base FROM f GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
