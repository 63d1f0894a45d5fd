"""Language of pages and documents: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from . import common

#: Labelled documents of each language that the likelihoods are fitted on, those whose ids have the least hashes, and the longest taken.
SAMPLE, SAMPLE_CHARS = 1500, 50_000
#: Languages whose numbers of rows are given to all tasks, so that texts needn't move to meet them.
FEW_LANGUAGES = 10_000
#: Slots of hashed byte trigrams; weight of a trigram's evidence, as neighbours overlap; weight of the parent in a smoothed prior.
SLOTS, TEMPER, PARENT = 1 << 16, 0.2, 5.0
#: The class of texts in no known language: every trigram is as likely as any other.
OTHER = "und"
SCRIPT = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*+(?:>|\Z)", re.DOTALL | re.IGNORECASE)


#: Bytes that words of a language don't have.
FOREIGN = np.isin(np.arange(256), np.frombuffer(b"0123456789@_/=\\", np.uint8))


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of the words, white space as one space, A-Z lowered.

    Numbers, addresses and keys are in no language: words with a FOREIGN byte are left out. Texts without a letter have none.
    """
    if not any(map(str.isalpha, text[:200])) and not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(text.encode().lower().split()) + b" ", np.uint8)
    if (foreign := FOREIGN[b]).any():
        word = np.cumsum(b == 32)
        out = np.zeros(word[-1] + 1, bool)
        out[word[foreign]] = True
        b = b[~out[word]]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    b = b.astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def labelled_sample(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """At most n rows (doc_id, text, lang) of each language, those of the least hashes.

    How many rows a language has tells below which hash about four times n of them lie: a filter, so that no task ranks a language's rows.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows")).withColumnRenamed("lang", "of_lang")
    sizes = common.written(sizes, "language-sizes")
    if sizes.count() <= FEW_LANGUAGES:  # else Spark joins as it sees fit
        sizes = F.broadcast(sizes)
    share = F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5
    few = labelled.withColumn("share", share).join(sizes, F.col("lang") == F.col("of_lang")).where(F.col("share") * F.col("rows") <= 4 * n)
    order = Window.partitionBy("lang").orderBy("share", "doc_id")
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("doc_id", "text", "lang")


class Likelihoods:
    """Log-probabilities of trigrams in each language, and in OTHER, the last."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = [*sorted(counts), OTHER]
        rows = [np.log((counts[x] + 0.05) / (counts[x].sum() + 0.05 * SLOTS)) for x in self.languages[:-1]]
        self.table = np.stack([*rows, np.full(SLOTS, -np.log(SLOTS))], axis=1).astype(np.float32)

    def of(self, text: str) -> list[float]:
        """Tempered log-likelihoods, the best of them 0: long texts leave little to the other evidence, short ones much."""
        found = trigrams(text)
        if not len(found):
            return [0.0] * len(self.languages)
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            total += self.table[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return np.round((total - total.max()) * TEMPER, 6).tolist()


def fitted(docs: DataFrame, n: int = SAMPLE) -> Likelihoods:
    """From a bounded sample of labelled documents; a batch of texts gives a row of counts for each language."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text.as_py() or ""), minlength=SLOTS)
        for lang, counts in sums.items():
            yield lang, counts.astype("<u4").tobytes()

    total: dict[str, np.ndarray] = {}
    for row in common.map_rows(labelled_sample(docs, n).select("text", "lang"), schema, rows).toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], "<u4").astype(float)
    return Likelihoods(total)


def markup_language(html: Column) -> Column:
    """The primary subtag that the html element declares, or null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-zA-Z]{2,3})""", 1), F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def identify(rows: DataFrame, model: Likelihoods, markup: bool = False, top: str | None = None) -> DataFrame:
    """rows (text, declared, host, and any others; text goes) with language, confidence and text_language, whose names get an underscore where rows have them.

    By Bayes: the posterior of a language is its prior on the host, times the likelihoods of text, declared
    language and address suffix. The text alone gives each row a first language; how often languages meet declared ones
    and suffixes, and each host's share of them, are counts of these over all rows. A host's shares lean on its domain's, those
    on the suffix's, those on all rows', by PARENT rows each; a row's own count is taken off its host. Where there is no text,
    declared language, suffix or host, the others decide; without any it is the commonest language. Ties go to the first by name.

    `top`: a column to use in place of the suffix. `markup`: text is HTML, and its tags, scripts and styles don't count.
    """
    n, names = len(model.languages), model.languages
    given_names = [c for c in rows.columns if c != "text"]
    kept = [f"kept_{i}" for i in range(len(given_names))]  # none of the names below
    own_name = dict(zip(given_names, kept, strict=True))
    rows = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in own_name.items()), "text")
    declared_as, host_as = own_name["declared"], own_name["host"]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(f"ll_{i}", T.DoubleType()) for i in range(n))])

    def score(batch: pa.RecordBatch) -> Iterator[tuple]:
        *others, texts = batch.columns
        for *known, text in zip(*(c.to_pylist() for c in others), texts, strict=True):
            text = text.as_py() or ""
            if markup:
                text = SCRIPT.sub(" ", text)
            yield *known, *model.of(text)

    found = common.map_rows(rows.select(*kept, "text"), schema, score, lambda r: 300)
    best = F.greatest(*(F.col(f"ll_{i}") for i in range(n)))
    none = reduce(lambda a, b: a & b, (F.col(f"ll_{i}") == 0 for i in range(n)))
    first = F.when(none, F.lit(None)).otherwise(F.coalesce(*(F.when(F.col(f"ll_{i}") == best, F.lit(i)) for i in range(n))))
    suffix = F.col(own_name[top]) if top else suffix_of(F.col(host_as))
    found = found.withColumns({"first": first, "host": F.col(host_as), "declared": F.col(declared_as), "own_domain": domain_of(F.col(host_as)), "own_suffix": suffix})
    found = common.written(found, "language-evidence")
    counts = lambda prefix: [F.count_if(F.col("first") == i).alias(f"{prefix}_{i}") for i in range(n)]
    total = found.agg(*counts("n")).first()
    smooth = sum(total[f"n_{i}"] for i in range(n)) + n
    overall = [(total[f"n_{i}"] + 1) / smooth for i in range(n)]

    def prior(own: str, parent: list[Column]) -> list[Column]:
        return [(F.col(f"{own}_{i}") + PARENT * parent[i]) / (F.col(f"{own}_size") + PARENT) for i in range(n)]

    sums = [*range(n), "size"]  # the size is the sum of the others, summed once: plans are to grow with n, not with its square
    hosts = found.where("host is not null").groupBy("host", "own_domain", "own_suffix").agg(*counts("h"), F.count("first").alias("h_size"))
    domains = hosts.groupBy("own_domain", "own_suffix").agg(*(F.sum(f"h_{i}").alias(f"d_{i}") for i in sums))
    suffixes = domains.groupBy("own_suffix").agg(*(F.sum(f"d_{i}").alias(f"s_{i}") for i in sums))
    by_suffix = prior("s", [F.lit(x) for x in overall])
    domains = domains.alias("d").join(suffixes.alias("s"), F.col("d.own_suffix").eqNullSafe(F.col("s.own_suffix"))).select("d.*", *(c.alias(f"sp_{i}") for i, c in enumerate(by_suffix)))
    by_domain = prior("d", [F.col(f"sp_{i}") for i in range(n)])
    domains = domains.select(F.col("own_domain").alias("domain"), F.col("own_suffix").alias("suffix"), *(c.alias(f"dp_{i}") for i, c in enumerate(by_domain)))
    hosts = hosts.join(domains, (F.col("own_domain") == F.col("domain")) & F.col("own_suffix").eqNullSafe(F.col("suffix")))
    hosts = common.written(hosts.select(F.col("host").alias("of_host"), F.col("own_suffix").alias("of_suffix"), *(f"h_{i}" for i in sums), *(f"dp_{i}" for i in range(n))), "host-priors")

    def given(key: str, label: str) -> DataFrame:
        """How likely each value of key is in each language, over all rows; a value's share in all of them smooths it."""
        each = found.groupBy(key).agg(*counts("n"), F.count("*").alias("n"))
        rate = [(F.col(f"n_{i}") + PARENT * F.col("n") / F.lit(max(1, rows_total))) / F.lit(total[f"n_{i}"] + PARENT) for i in range(n)]
        return common.written(each.select(F.col(key).alias(f"of_{label}"), *(r.alias(f"{label}_{i}") for i, r in enumerate(rate))), f"given-{label}")

    rows_total = found.count()
    declared, endings = given("declared", "declared"), given("own_suffix", "ending")
    joined = found.join(hosts, (F.col("host") == F.col("of_host")) & F.col("own_suffix").eqNullSafe(F.col("of_suffix")), "left")
    joined = joined.join(declared, F.col("declared").eqNullSafe(F.col("of_declared")), "left").join(endings, F.col("own_suffix").eqNullSafe(F.col("of_ending")), "left")
    own = [F.when(F.col("first") == i, 1).otherwise(0) for i in range(n)]
    known = F.col("of_host").isNotNull()
    size = F.col("h_size") - F.when(F.col("first").isNotNull(), 1).otherwise(0)
    evidence = []
    for i in range(n):
        at_host = F.when(known, (F.col(f"h_{i}") - own[i] + PARENT * F.col(f"dp_{i}")) / (size + PARENT)).otherwise(F.lit(overall[i]))
        declares = F.when(F.col("declared").isNotNull(), F.log(F.col(f"declared_{i}"))).otherwise(0.0)
        ends = F.when(F.col("own_suffix").isNotNull(), F.log(F.col(f"ending_{i}"))).otherwise(0.0)
        evidence.append((F.col(f"ll_{i}") + F.log(at_host) + declares + ends).alias(f"e_{i}"))
    fused = joined.select(*kept, "first", *evidence)
    top_of = F.greatest(*(F.col(f"e_{i}") for i in range(n)))
    mass = reduce(lambda a, b: a + b, (F.exp(F.col(f"e_{i}") - F.col("best")) for i in range(n)))
    choice = F.coalesce(*(F.when(F.col(f"e_{i}") == F.col("best"), F.lit(names[i])) for i in range(n)))
    text_lang = F.coalesce(*(F.when(F.col("first") == i, F.lit(names[i])) for i in range(n)))
    new = {x: common.fresh(x, given_names) for x in ("language", "confidence", "text_language")}
    out = fused.withColumn("best", top_of).select(*kept, choice.alias("new_language"), F.round(1 / mass, 6).alias("new_confidence"), text_lang.alias("new_text_language"))
    return out.select(*(F.col(k).alias(c) for c, k in own_name.items()), *(F.col(f"new_{x}").alias(name) for x, name in new.items()))


def in_known_language(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, lang, source, and any others) but those whose text is in no language that labels name; lang is the language found.

    lang is the declared language and source the host. A text without a letter says nothing against its row, which keeps its lang, or its want of one. Rows
    of one doc_id and text go together. An empty table, and one without labels, stays as it is.
    """
    model = fitted(docs)
    if len(model.languages) == 1:
        return docs
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", F.lower("lang").alias("declared"), F.lower("source").alias("host"))
    # written, as a filter is put into the plan of what it reads, evidence of all languages and all, once for each use of it
    found = common.written(identify(rows, model).select("doc_id", "h", "declared", "language", "text_language"), "languages")
    gone = (F.col("language") == OTHER) & (F.col("text_language") == OTHER)
    other = F.col("text_language").isNotNull() & (F.col("language") != OTHER) & ~F.col("language").eqNullSafe(F.col("declared"))
    verdicts = found.where(gone | other).groupBy("doc_id", "h").agg(F.max(gone).alias("gone"), F.min(F.when(other, F.col("language"))).alias("language"))
    doc, h, out, lang = (common.fresh(x, docs.columns) for x in ("found_doc", "found_text", "found_gone", "found_lang"))
    verdicts = common.written(verdicts.select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("gone").alias(out), F.col("language").alias(lang)), "verdicts")
    both = docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts[doc]) & (F.xxhash64(docs["text"]) == verdicts[h]), "left").where(~F.coalesce(out, F.lit(False)))
    return both.select(*(F.coalesce(lang, "lang").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pages: page_id, url, declared, language, confidence and text_language, the language by the text alone."""
    model = fitted(common.table(spark, sf_dir, "documents"))
    pages = common.table(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", F.col("html").alias("text"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, model, markup=True).drop("host")
