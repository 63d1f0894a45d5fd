"""Scan for secrets by DataFrame functions alone, told apart by how many owners a candidate occurs with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

# What each kind of candidate looks like, and the least length of what counts.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # shorter runs hold no longer one
}
#: Tokens of mixed letters and digits that no keyword announces; only owner-specific ones are reported.
ADDED = {"owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20)}
KINDS = [*BASE, *ADDED]
#: A value with more owners than this is an example that people copy.
MAX_OWNERS = 2
#: What stands for a secret in a redacted text.
MASK = "[SECRET]"


def mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def candidates(docs: DataFrame, text: str, doc_id: str, owner: str, repo: str) -> DataFrame:
    """(doc_id, h, kind, start, end, value_hash, owner, repo) of each candidate that is long enough; h is a hash of the text.

    Leftmost, non-overlapping matches of a kind come with the texts between them, so that running sums of their lengths give each
    one's place in code points. Matches only are shuffled, by document; equal rows give equal matches, which count once.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), F.col(text).alias("body"))
    matches = []
    for kind, (pattern, group, _) in (BASE | ADDED).items():
        rows = F.arrays_zip(
            F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
            F.transform(F.split("body", pattern, -1), lambda p: F.length(p)).alias("gap"),
            F.regexp_extract_all("body", F.lit(pattern), F.lit(group)).alias("value"),
        )
        one = found.where(F.col("body").rlike(pattern)).select("doc_id", "h", "owner", "repo", F.posexplode(rows).alias("at", "m"))
        matches.append(one.where("m.size is not null").select("doc_id", "h", "owner", "repo", F.lit(kind).alias("kind"), "at", "m.*"))
    rows = reduce(DataFrame.unionByName, matches)
    rows = rows.repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "owner", "repo", "kind", "at"])
    so_far = Window.partitionBy("doc_id", "h", "owner", "repo", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("size") + F.col("gap")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    enough = F.lit(False)
    for kind, (_, group, least) in (BASE | ADDED).items():
        long = F.length("value") >= least if group else F.col("size") >= least
        enough |= (F.col("kind") == kind) & (long & mixed(F.col("value")) if kind in ADDED else long)
    return rows.where(enough).select("doc_id", "h", "kind", "start", "end", F.sha2("value", 256).alias("value_hash"), "owner", "repo")


def owners(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos) over the whole corpus. Copies within an owner meet before the shuffle."""
    return found.groupBy("value_hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, h, found) of each text with secrets: an array of (start, place, kind, end, live), by start, then kind.

    live: the value occurs with max_owners distinct owners and repositories or fewer; others are widely copied examples.
    Base kinds stay whether live or not; a span of an added kind stays if it is live and lies in no base span.
    Null owners count as none, so a value that only they have is live. Of a value that a third of all rows share,
    Spark splits the rows in the join with its count.
    """
    rows = common.written(candidates(docs, text, doc_id, owner, repo), "secrets")
    counts = common.written(owners(rows), "secret-owners")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_owners)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    rows = rows.join(counts, "value_hash").select("doc_id", "h", F.struct("start", place.alias("place"), "kind", "end", live.alias("live")).alias("span"))
    rows = rows.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("span")).alias("found"))
    base = F.filter("found", lambda x: x["place"] <= len(BASE))
    keep = lambda x: (x["place"] <= len(BASE)) | (x["live"] & ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.withColumn("base", base).withColumn("found", F.filter("found", keep)).select("doc_id", "h", "found")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def with_spans(docs: DataFrame, name: str = "found", **options) -> DataFrame:
    """docs with the spans of each row's text as column `name`: an empty array where there are none, also in a null text."""
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    doc, h, own = (common.fresh(x, docs.columns) for x in ("span_doc", "span_text", "spans"))
    rows = spans(docs, **options).select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("found").alias(own))
    same = docs[doc_id].eqNullSafe(rows[doc]) & (F.xxhash64(docs[text]) == rows[h])
    empty = F.array().cast(rows.schema[own].dataType)
    return docs.join(rows, same, "left").withColumn(name, F.coalesce(own, empty)).drop(doc, h, own)


def redact(text: Column, found: Column) -> Column:
    """The text with MASK for each stretch that spans cover. Its pieces are joined once."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(so_far: Column, x: Column) -> Column:
        fresh = x["start"] >= so_far["at"]
        gap = F.substring(text, (so_far["at"] + 1).cast("int"), F.greatest(x["start"] - so_far["at"], F.lit(0)).cast("int"))
        out = F.when(fresh, F.array_append(so_far["out"], F.concat(gap, F.lit(MASK)))).otherwise(so_far["out"])
        return F.struct(out.alias("out"), F.greatest(x["end"], so_far["at"]).alias("at"))

    rest = lambda s: F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
    return F.aggregate(found, start, step, lambda s: F.array_join(F.array_append(s["out"], rest(s)), ""))


def redacted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, source, n_chars, and any others) with MASK for each live secret in the text; n_chars follows. A null text stays null."""
    found, new = (common.fresh(x, docs.columns) for x in ("found", "redacted"))
    live = F.filter(found, lambda x: x["live"])
    # a column of its own: within lambda functions, "text" would be taken for the new one beside it
    rows = with_spans(docs, found).withColumn(new, F.when(F.size(live) > 0, redact(F.col("text"), live)))
    length = F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return rows.select(*({"text": F.coalesce(new, "text").alias("text"), "n_chars": length.alias("n_chars")}.get(c, F.col(f"`{c}`")) for c in docs.columns))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents; source is both owner and repository there."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = F.filter("found", lambda x: x["place"] <= len(BASE))
    return with_spans(docs).select(
        "doc_id",
        *(F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        *(F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in ADDED),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def _matches(kind: str) -> str:
    pattern, group, least = (BASE | ADDED)[kind]
    pattern = pattern.replace("'", "''")
    test = f"length(value) >= {least}"
    if kind in ADDED:
        test += " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {KINDS.index(kind) + 1} AS place, value, ends - size AS s, ends AS e FROM (
    SELECT *, sum(size + gap) OVER (PARTITION BY doc_id ORDER BY nth) AS ends FROM (
      SELECT doc_id, source, unnest(range(1, len(m) + 1)) AS nth, unnest(list_transform(m, lambda x: length(x))) AS size,
        unnest(v) AS value, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap
      FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS g FROM documents)
    )
  ) WHERE {test}"""


OP3_SQL = f"""
WITH c AS ({" UNION ALL ".join(map(_matches, KINDS))}),
o AS (SELECT value, count(DISTINCT source) <= {MAX_OWNERS} AS live FROM c GROUP BY value),
f AS (SELECT c.*, o.live FROM c JOIN o USING (value)),
k AS (SELECT * FROM f WHERE place <= {len(BASE)} OR live AND NOT EXISTS (
  SELECT 1 FROM c b WHERE b.doc_id = f.doc_id AND b.place <= {len(BASE)} AND b.s < f.e AND f.s < b.e)),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in KINDS)}, count(*) FILTER (live) AS n_live,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place <= {len(BASE)}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in KINDS)}, coalesce(n_live, 0)::BIGINT AS n_live,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""
