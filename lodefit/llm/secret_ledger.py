"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a text is named by its SHA-256. A blob is scanned
only for the rule versions that the ledger hasn't recorded for it; findings are
joined back to all paths that hold the blob. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.functions.skew import split_join
from lodefit.llm.common import shared_dir, table

_SPANS = "array<struct<start:int,ord:int,end:int,kind:string,rule:string>>"
REDACTED = "[SECRET]"
#: Spans are walked in runs of this many, so that a list is never copied whole at each span.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """A pattern and its version. Matches whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: The order of kinds is the order of spans that start together.
RULES = (
    Rule("assign", _ASSIGN, group=2, least=8),
    # a run is maximal, so the least length can stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    # the whole key where its end is there, else its header; a body has no dash, so no text is read twice
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
        r"(?:(?:[\x20\t\r\n]{0,9}Proc-Type:[^\n]{0,80}\n[\x20\t]{0,9}DEK-Info:[^\n]{0,80}\n)?[A-Za-z0-9+/=\x20\t\r\n\\]*-----END [A-Z ]{0,32}PRIVATE KEY-----)?",
        version=2,
    ),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule, leftmost first, in code points, end exclusive.

    Matches and the pieces between them alternate, so their lengths give the places.
    """
    none = F.array().cast(_SPANS)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches

    def walk(s: Column) -> Column:
        steps = F.transform(s["m"], lambda m, i: F.struct(F.length(s["p"][i]).alias("gap"), F.length(m).alias("n"), F.length(s["g"][i]).alias("g")))
        return let(steps, lambda x: let(runs_of(x), places))

    def places(runs: Column) -> Column:
        sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
        return F.flatten(F.zip_with(runs, before_each(sizes, lambda a, b: a + b), run))

    def run(steps: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["n"]
            span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"))
            more = F.concat(acc["spans"], F.array(span).cast(_SPANS))
            return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, more).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(steps, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    found = let(F.struct(matches.alias("m"), F.split(text, rule.pattern, -1).alias("p"), groups.alias("g")), walk)
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def runs_of(items: Column) -> Column:
    """An array in pieces of RUN elements; at least one piece."""
    return F.transform(F.sequence(F.lit(0), (F.greatest(F.size(items) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, RUN))


def before_each(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one merge to, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(values, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])


def address(text: Column) -> Column:
    """The blob of a text, its SHA-256; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(rows: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows(blob, text) -> blob, text, todo: each blob once, with the rule versions the ledger lacks for it."""
    names = F.array(*[F.lit(r.name) for r in rules])
    # copies meet map-side first, so a blob that many rows hold is sent once by each task
    blobs = rows.groupBy("blob").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    if ledger is None:
        return blobs.withColumn("todo", names)
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).select("blob", "text", "todo")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs(blob, text, todo) -> blob, rules, spans: what the ledger records."""
    every = [F.when(F.array_contains("todo", r.name), spans_of(F.col("text"), r, k)).otherwise(F.array().cast(_SPANS)) for k, r in enumerate(rules)]
    return blobs.select("blob", F.col("todo").alias("rules"), F.flatten(F.array(*every)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger table at path; None where there is none yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found if {"blob", "rules", "spans"} <= set(found.columns) else None


def record(rows: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks of rows(blob, text) and append it; a run that broke off is made good by the next."""
    before = read_ledger(rows.sparkSession, ledger_path)
    scan(unseen(rows, before, rules), rules).write.mode("append").parquet(ledger_path)


def findings(spark: SparkSession, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: the ledger's findings of the current rule versions, for the blobs that have any."""
    names = [r.name for r in rules]
    now = spark.read.parquet(ledger_path).select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin(names))
    return now.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def scan_versions(rows: DataFrame, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None, text: str = "text", path: str | None = None) -> DataFrame:
    """rows -> the same rows with blob and spans; no findings are an empty array.

    The ledger is the table at ledger_path, or one in the shared folder that
    nothing else knows. text and path name the columns of the text and of what tells
    rows of equal text apart; either may be a field of a struct. Null and empty texts
    hold nothing; copies of a text are scanned once. A column named blob or spans in
    rows is replaced, and none may be named _spot or _pieces.
    """
    spark = rows.sparkSession
    ledger_path = ledger_path or f"{shared_dir(spark)}/secret-ledger-{uuid4().hex}"
    rows = rows.drop("blob", "spans").withColumn("blob", address(F.col(text)))
    record(rows.select("blob", F.col(text).alias("text")), ledger_path, rules)
    found = findings(spark, ledger_path, rules)
    apart = [path] if path else [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct", "variant"))] or [text]
    return split_join(rows, found, "blob", apart, "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by REDACTED; spans sorted by start.

    Each run of spans works on its own part of the text, from the end of what the runs before it cover.
    """
    runs = runs_of(spans)
    ends = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, s: F.greatest(n, s["end"])))

    def step(base: Column, part: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            out = F.when(fresh, F.concat(acc["out"], F.substring(part, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit(REDACTED))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        return one

    def run(r: Column, at: Column, end: Column) -> Column:
        part = F.substring(text, at + 1, F.greatest(end - at, F.lit(0)))
        return let(part, lambda p: F.aggregate(r, F.struct(at.alias("at"), F.lit("").alias("out")), step(at, p), lambda acc: acc["out"]))

    def whole(x: Column) -> Column:
        parts = F.transform(x["runs"], lambda r, k: run(r, x["at"][k], F.greatest(x["at"][k], x["ends"][k])))
        last = F.array_max(x["ends"])
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    placed = let(F.struct(runs.alias("runs"), ends.alias("ends")), lambda x: let(F.struct(x["runs"].alias("runs"), x["ends"].alias("ends"), before_each(x["ends"], F.greatest).alias("at")), whole))
    return F.when(F.size(spans) > 0, placed).otherwise(text)


def op3_secret_ledger(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid4().hex}"
    # half of the blobs are there from before, so the scan of all finds them seen
    blobs = docs.select(address(F.col("text")).alias("blob"), "text")
    record(blobs.where(F.col("blob") < "8"), ledger)
    found = scan_versions(docs, ledger_path=ledger, path="doc_id")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[_count(k) for k in BASE_KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _sql(rules: tuple[Rule, ...]) -> str:
    quoted = {r.kind: r.pattern.replace("'", "''") for r in rules}
    lists = ", ".join(f"regexp_extract_all(t, '{quoted[r.kind]}', 0) AS m{k}, regexp_extract_all(t, '{quoted[r.kind]}', {r.group}) AS g{k}, string_split_regex(t, '{quoted[r.kind]}') AS p{k}" for k, r in enumerate(rules))
    each = ", ".join(
        f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'a': length(array_to_string(p{k}[1:i], '')) + length(array_to_string(m{k}[1:i-1], '')), 'o': {k}, 'n': length(m{k}[i]), 'g': length(g{k}[i]), 'k': '{r.kind}'}}), lambda s: s.g >= {r.least}) AS s{k}"
        for k, r in enumerate(rules)
    )
    base = ", ".join(f"s{k}" for k, r in enumerate(rules) if r.kind in BASE_KINDS)
    every = ", ".join(f"s{k}" for k in range(len(rules)))
    text = "array_to_string(list_transform(list_sort(flatten([{}])), lambda s: s.k || ':' || s.a || ':' || (s.a + s.n)), ',')"
    counts = ", ".join(f"CAST(len(s{k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(rules) if r.kind in BASE_KINDS)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {lists} FROM d), s AS (SELECT doc_id, {each} FROM m) "
        f"SELECT doc_id, {counts}, sha256(coalesce({text.format(base)}, '')) AS base_sha256, coalesce({text.format(every)}, '') AS spans FROM s"
    )


OP3_SQL = _sql(RULES)
