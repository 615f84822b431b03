"""Secret scans over a ledger of blobs, in DataFrame operations only.

Every version of every document is addressed by the SHA-256 of its content (a
blob).  The ledger is a table of what was scanned: one row for a blob and scan,
with the rule versions that were applied and the spans they found.  A scan
looks up which (blob, rule version) pairs the ledger lacks, applies just those
rules to just those blobs, each blob once however many paths hold it, and
appends one row a blob.  Findings are then joined back to all paths.  An
append is one atomic write, so a scan that dies is simply run again.

Spans are code points, end exclusive.  Spark has no function that gives the
places of all matches; they follow from the lengths of the matches and of the
text between them.

Edge cases: null content is the empty text, a blob like any other, with no
findings.  Repeated rows and paths each get their blob's findings.  A null
path is kept.  An empty table gives an empty result and leaves the ledger as
it is.  Other columns, of any name, are ignored by :func:`find_secrets` and
passed through by :func:`redact_secrets`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import BROADCAST_IDS, Scratch, fresh


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` is the shortest ``group`` that counts."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their listed order, then the kinds this engine adds.  Where a kind's least length
# applies to the whole match, a quantifier states it: the runs are maximal, so the matches are the same.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])


def _none() -> Column:
    return F.array().cast(T.ArrayType(SPAN))


#: Code points of a text that are cut out together.
BLOCK = 1024
#: Elements of an array that are folded together before the parts' results are.
STRIDE = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often lambdas inside read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, op) -> Column:
    """``op`` of ``start`` and an array's elements so far, for each element.

    Growing an array in a fold copies it every time.  So the array is cut into
    strides, a fold over these tells where each one starts, and an element's
    result takes in what precedes it in its own stride.
    """
    fold = lambda xs, at: F.aggregate(xs, at, op)
    strides = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / STRIDE) - 1, F.lit(0)).cast("int")), lambda k: F.slice(v, k * STRIDE + 1, STRIDE))
    kind = "struct<at:bigint,starts:array<bigint>>"
    begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("starts")).cast(kind)
    starts = lambda cut: F.aggregate(cut, begin, lambda acc, xs: F.struct(fold(xs, acc["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")).cast(kind), lambda acc: acc["starts"])
    each = lambda xs, at: F.transform(xs, lambda _, i: fold(F.slice(xs, 1, i + 1), at))
    return let(values, lambda v: let(strides(v), lambda cut: F.flatten(F.zip_with(cut, starts(cut), each))))


def match_spans(text: Column, rule: Rule) -> Column:
    """All leftmost non-overlapping matches of a rule, as an array of spans; running sums over the lengths of gaps and matches place them."""
    pattern = F.lit(rule.pattern)
    lengths = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))
    sizes = lambda hits: F.zip_with(F.slice(lengths(F.split(text, rule.pattern, -1)), 1, F.size(hits)), hits, lambda g, h: g + h)
    ends = lambda hits: running(sizes(hits), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = lambda hits: F.zip_with(hits, ends(hits), lambda h, end: F.struct((end - h).alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end")).cast(SPAN))
    found = let(lengths(F.regexp_extract_all(text, pattern, F.lit(0))), spans)
    if rule.least:
        parts = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
        found = F.transform(F.filter(F.zip_with(found, parts, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: F.coalesce(x["n"] >= rule.least, F.lit(False))), lambda x: x["s"])
    return F.when(text.rlike(rule.pattern), found).otherwise(_none())


def in_order(spans: Column) -> Column:
    """Spans, each once, by start, then kind: the base kinds as listed, this engine's others, then any by name."""
    rank = lambda kind: F.coalesce(*[F.when(kind == r.kind, F.lit(k)) for k, r in enumerate(RULES)], F.lit(len(RULES)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    once = let(F.array_sort(keyed), lambda all_: F.filter(all_, lambda s, i: (i == 0) | (s != F.get(all_, i - 1))))
    return F.transform(once, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")).cast(SPAN))


class BlobLedger:
    """The ledger at ``path``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path) if self.exists() else self.spark.createDataFrame([], LEDGER)

    def scan(self, contents: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scans what is new among ``contents(blob, text)`` and appends it."""
        blobs = contents.groupBy("blob").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        if self.exists():
            seen = self.read().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
            blobs = blobs.where(F.size("rules") > 0)
            found = [F.when(F.array_contains("rules", r.key), match_spans(F.col("text"), r)).otherwise(_none()) for r in rules]
        else:
            blobs = blobs.withColumn("rules", keys)
            found = [match_spans(F.col("text"), r) for r in rules]
        blobs.select("blob", "rules", F.concat(*found).alias("spans")).write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``(blob, spans)`` in order, of blobs with findings by these rule versions."""
        versions = F.array(*[F.lit(r.key) for r in rules])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        current = F.filter("rules", lambda r: F.array_contains(versions, r))
        kept = F.filter("spans", lambda s: F.exists(current, lambda r: F.substring_index(r, "@", 1) == s["kind"]) & F.array_contains(kinds, s["kind"]))
        own = self.read().select("blob", kept.alias("spans")).where(F.size("spans") > 0)
        return own.groupBy("blob").agg(in_order(F.flatten(F.collect_list("spans"))).alias("spans"))


def address(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob, text)``, null texts read as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.sha2("text", 256).alias("blob"), "text")


def find_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(doc_id, blob, spans)``, one row for each row of ``docs``; spans are sorted by start, then kind."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ledger = ledger or BlobLedger(spark, f"{scratch.root}/ledger")
    paths = address(docs)
    ledger.scan(paths.select("blob", "text"), rules)
    # Written, so that the join reads both sides from exchanges and can split the paths of a common blob.
    findings = scratch.put(ledger.findings(rules), "findings")
    return paths.select("doc_id", "blob").join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("spans", _none()).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def key_end(text: Column, span: Column) -> Column:
    """Where what a span reports ends: a private key's, which is found by its BEGIN line, with its END line.

    Without one before the next dashed line, it ends with the base64
    run, and a word that begins the next line may be taken for its last one.
    """
    rest = text.substr((span["end"] + 1).cast("int"), F.char_length(text))
    dashes = F.instr(rest, "-----")
    last = F.regexp_extract(rest.substr(F.greatest(dashes, F.lit(1)), F.lit(80)), r"^-----END [A-Z ]{0,40}PRIVATE KEY-----", 0)
    run = F.regexp_extract(rest, r"^\s*+(?=[A-Za-z0-9+/=]{16})[A-Za-z0-9+/=\r\n]*+", 0)
    more = F.when((dashes > 0) & (last != ""), dashes - 1 + F.char_length(last)).otherwise(F.char_length(run))
    return F.when(span["kind"] == "pem", span["end"] + more).otherwise(span["end"])


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text cut into blocks of :data:`BLOCK`."""
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    a, b = (start % BLOCK).cast("int"), (end % BLOCK).cast("int")
    several = F.concat(block(first).substr(a + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), block(last).substr(F.lit(1), b))
    return F.when(end <= start, F.lit("")).when(first == last, block(first).substr(a + 1, b - a)).otherwise(several)


def masked(text: Column, starts: Column, ends: Column, mask: str) -> Column:
    """``text`` with a mask in place of each span, or run of overlapping ones; time follows the text's length."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = running(ends, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    part = lambda cut: lambda s, at: F.when(s < at, F.lit("")).otherwise(F.concat(between(cut, at, s), F.lit(mask)))
    before = lambda far: F.concat(F.array(F.lit(0).cast("long")), F.slice(far, 1, F.size(far) - 1))
    put = lambda cut, far: F.concat(F.array_join(F.zip_with(starts, before(far), part(cut)), ""), between(cut, F.element_at(far, -1), F.char_length(text).cast("long")))
    return let(blocks, lambda cut: let(reach, lambda far: put(cut, far)))


def _bits(blob: str) -> Column:
    """The first 64 bits of an address."""
    return F.conv(F.substring(blob, 1, 16), 16, -10).cast("long")


def redact_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span, and whole private keys, replaced by ``mask``; ``n_chars``, if there, follows the new text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ledger = ledger or BlobLedger(spark, f"{scratch.root}/ledger")
    ledger.scan(address(docs).select("blob", "text"), rules)
    blob, spans, part = fresh(docs, "_blob"), fresh(docs, "_spans"), fresh(docs, "_part")
    findings = scratch.put(ledger.findings(rules), "findings").toDF(blob, spans)
    addressed = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256))
    if findings.count() > BROADCAST_IDS:
        joined = addressed.join(findings, blob, "left")
    else:
        # Few blobs have findings: 64 bits of their addresses are broadcast, and only texts that may hold one are shuffled.
        some = F.broadcast(findings.select(_bits(blob).alias(part)).distinct())
        keyed = addressed.withColumn(part, _bits(blob))
        hit, clean = keyed.join(some, part, "left_semi").drop(part), keyed.join(some, part, "left_anti").drop(part)
        joined = hit.join(findings, blob, "left").select(*docs.columns, spans).union(clean.select(*docs.columns, F.lit(None).cast(T.ArrayType(SPAN)).alias(spans)))
    starts = F.transform(spans, lambda s: s["start"])
    masked_text = masked(F.col("text"), starts, F.transform(spans, lambda s: key_end(F.col("text"), s)), mask)
    out = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked_text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def oracle() -> str:
    """The query in SQL, for documents whose contents come once or more."""
    spell = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(spell(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]{16,}",
        "hex": r"[0-9a-f]{24,}",
        "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
        "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    }
    parts = []
    for rank, (kind, p) in enumerate(patterns.items()):
        group, least = (2, 6) if kind == "assign" else (0, 0)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, "
            f"unnest(regexp_split_to_array(t, '{p}')[:-2]) AS gap, unnest(regexp_extract_all(t, '{p}', 0)) AS hit, "
            f"length(unnest(regexp_extract_all(t, '{p}', {group}))) >= {least} AS counts, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS i FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, rank, kind, counts,
        CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS "end", length(hit) AS n FROM m),
f AS (SELECT doc_id, rank, kind, "end" - n AS start, kind || ':' || CAST("end" - n AS VARCHAR) || ':' || CAST("end" AS VARCHAR) AS span FROM s WHERE counts),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""
