"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are key assignments, access keys, long hex strings, and bare strings of letters and digits. Their values go
on as SHA-256 hashes. For each hash the distinct repositories and owners that hold it are counted, in levels so that a
value that everybody has is combined before each shuffle. A value of WIDE_OWNERS owners or more is a copied example; one
of fewer owners that looks live (enough different characters, letters and digits, no placeholder words) is a live
credential of its owner. A bare string becomes a span (kind "owned") where the same value stands as a credential
somewhere in the corpus and is live.

Positions are code points, end exclusive: a text is split by the pattern, and the lengths of what lies between and of
the matches add up. Defined results: null text is empty and has no spans; null owners are one owner; rows that repeat an
id are scanned each. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm.arrays import running
from sparktap.llm.keep import join_named
from sparktap.session import materialise

#: The base kinds in order, with pattern, the group that is the value, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|test|x{4}|0{6}|123456|abcdef"
WIDE_OWNERS = 3
LEAST_DISTINCT = 8
#: Documents with live credentials, and spans of these, that are broadcast at most; beyond that texts are joined by shuffle.
BROADCAST_HITS = 100_000
BROADCAST_SPANS = 1_000_000
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,key:string,live:boolean>>"


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (distinct >= LEAST_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def may_match(text: Column, kind: str) -> Column:
    """False only where the kind's pattern has no match: an assignment has one of two marks, which are cheap to look for."""
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) if kind == "assign" else F.lit(True)


def find(text: Column, kind: str, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one pattern's matches whose value has the least length."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    lengths = F.transform(matches, lambda x: F.char_length(x))
    before = running(F.zip_with(F.slice(between, 1, F.size(matches)), lengths, lambda a, b: a + b))
    ends = F.zip_with(before, F.zip_with(F.slice(between, 1, F.size(matches)), lengths, lambda a, b: a + b), lambda a, b: a + b)
    raw = F.zip_with(F.zip_with(ends, lengths, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))), values, lambda s, v: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
    good = F.filter(raw, lambda s: F.char_length(s["value"]) >= least)
    shown = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("key"), looks_live(s["value"]).alias("live")))
    return F.when(may_match(text, kind) & text.rlike(pattern), shown.cast(SPAN)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_cols: list[str], repo_cols: list[str]) -> DataFrame:
    """One row per document: row, id, owner, repo, print (of the text), base and bare spans; no text and no value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda cols: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    base = F.array_sort(F.concat(*[find(F.col("t"), k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)]))
    bare = F.filter(find(F.col("t"), "owned", len(BASE), BARE, 0, 20), lambda s: s["live"])
    found = docs.select(F.col(id_col).alias("id"), named(owner_cols).alias("owner"), named(repo_cols).alias("repo"), text.alias("t"))
    found = found.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", F.xxhash64("t").alias("print"), base.alias("base"), bare.alias("bare"))
    return found.withColumn("bare", F.filter("bare", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def ownership(found: DataFrame) -> DataFrame:
    """Rows (key, repos, owners, uses, credential) of all candidate values."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).select("owner", "repo", F.col("s.key").alias("key"), (F.col("s.kind") != "owned").alias("credential"))
    by_repo = each.groupBy("key", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"), F.max("credential").alias("credential"))
    by_owner = by_repo.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"), F.max("credential").alias("credential"))
    return by_owner.groupBy("key").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("uses"), F.max("credential").alias("credential"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols=("source",), repo_cols=("source", "lang")) -> DataFrame:
    """One row per document: id, print, base (spans), spans (start, kind, end, class, owners, repos).

    class: example, live or weak. Added spans are always live.
    """
    found = materialise(candidates(docs, id_col, text_col, list(owner_cols), list(repo_cols)), "candidates")
    some = found.where("size(base) + size(bare) > 0")
    each = some.select("row", F.explode(F.concat("base", "bare")).alias("s")).select("row", "s.*")
    owned = materialise(ownership(some).where("credential").drop("credential"), "owned")
    total = owned.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    each = join_named(each, owned, "key", "uses", total).withColumn("class", F.when(F.col("owners") >= WIDE_OWNERS, "example").when(F.col("live"), "live").otherwise("weak"))
    each = each.where((F.col("kind") != "owned") | (F.col("class") == "live"))
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "class", "owners", "repos"))).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    out = some.join(spans, "row", "left").select("id", "print", "base", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    none = found.where("size(base) + size(bare) = 0").select("id", "print", "base", F.array().cast(kind).alias("spans"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def show(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda c, v, what: F.size(F.filter(c, lambda s: s[what] == v)).cast("long")
    return scanned.select(
        id_col, count("base", "assign", "kind").alias("n_assign"), count("base", "access", "kind").alias("n_access"), count("base", "hex", "kind").alias("n_hex"), F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"),
        count("spans", "live", "class").alias("n_live"), count("spans", "example", "class").alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols=("source",), repo_cols=("source", "lang"), mark: str = "[SECRET]") -> DataFrame:
    """The documents, with each live credential's span replaced by the mark; other texts and columns stay as they are."""
    cuts = F.transform(F.filter("spans", lambda s: s["class"] == "live"), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    found = scan(docs, id_col, text_col, owner_cols, repo_cols).select(F.col(id_col).alias("__id"), F.col("print").alias("__print"), cuts.alias("__cuts"))
    hits = materialise(found.where("size(__cuts) > 0").distinct(), "hits")
    size = hits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("__cuts")), F.lit(0)).alias("spans")).first()
    few = size["n"] <= BROADCAST_HITS and size["spans"] <= BROADCAST_SPANS
    text, cuts = F.coalesce(docs[text_col], F.lit("")), hits["__cuts"]
    joined = docs.join(F.broadcast(hits) if few else hits, docs[id_col].eqNullSafe(hits["__id"]) & (F.xxhash64(text) == hits["__print"]), "left")

    def step(a: Column, s: Column) -> Column:
        """Spans come by their start; one that begins inside what is cut already only moves its end."""
        new = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(cuts, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    new = F.when(cuts.isNotNull(), cut).otherwise(docs[text_col])
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql_kind(kind: str, no: int, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT r, '{kind}' AS kind, {no} AS k, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gaps FROM d"


#: The same spans by DuckDB: matches, and the lengths of what lies between them. RE2 needs no look behind: a run's match
#: starts where the run does.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents
), m AS (
  {" UNION ALL ".join(_sql_kind(k, i, p, g) for i, (k, p, g, _) in enumerate((*BASE, ("owned", "[A-Za-z0-9+/_=-]{20,}", 0, 20))))}
), e AS (
  SELECT r, kind, k, vs[i] AS v, length(ms[i]) AS n, (list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0))::BIGINT AS a
  FROM m, unnest(range(1, len(ms) + 1)) AS u(i)
), f AS (
  SELECT *, a + n AS z, len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{PLACEHOLDER}') AS live
  FROM e WHERE length(v) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 20 END
), base AS (SELECT * FROM f WHERE kind <> 'owned'
), bare AS (SELECT * FROM f WHERE kind = 'owned' AND live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.a < f.z AND f.a < b.z)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM bare
), owned AS (SELECT v, count(DISTINCT owner) AS owners, bool_or(kind <> 'owned') AS credential FROM every JOIN d USING (r) GROUP BY v
), s AS (
  SELECT r, kind, k, a, z, CASE WHEN owners >= {WIDE_OWNERS} THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS class FROM every JOIN owned USING (v)
  WHERE credential AND (kind <> 'owned' OR owners < {WIDE_OWNERS})
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (kind <> 'owned'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k), '') AS spans, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
"""
