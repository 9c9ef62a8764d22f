"""Language of web pages by Bayesian evidence fusion.

The likelihood of a page's text under each language is combined with what its markup declares, its address's suffix,
and a prior for its host. The evidence tables and the priors are counted from all pages by grouped aggregation of the
text posteriors; host priors are smoothed towards their site's, sites towards their suffix, and suffixes towards all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, let

BINS = 1 << 16
MARK = re.compile(r"<(?:(!--)|(script|style)\b)?", re.IGNORECASE)
RAW_ENDS = {"!--": re.compile("-->"), "script": re.compile(r"</script\s*>", re.IGNORECASE), "style": re.compile(r"</style\s*>", re.IGNORECASE)}
NAMED = re.compile(r"\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)
META = re.compile(r"(?=.*\shttp-equiv\s*=\s*[\"']?content-language).*?\scontent\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.IGNORECASE | re.DOTALL)
ELEMENTS = [(re.compile(r"<html\b", re.IGNORECASE), NAMED.search), (re.compile(r"<meta\b", re.IGNORECASE), META.match)]


def visible_text(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags; null gives an empty one.

    One walk from mark to mark. What is opened but never closed is text, but for its first character; whether a closing
    mark follows is looked up once for each kind, so a page of unclosed marks takes no longer than others.
    """
    page, at, out, missing = page or "", 0, [], set()
    while m := MARK.search(page, at):
        out.append(page[at : m.start()])
        kind = (m[1] or m[2] or "").lower()
        end = RAW_ENDS[kind].search(page, m.end()) if kind and kind not in missing else None
        if kind and not end:
            missing.add(kind)
        stop = end.end() if end else page.find(">", m.end()) + 1 if "" not in missing else 0
        if not stop:
            missing.add("")
        at = stop or m.start() + 1
    out.append(page[at:])
    return html.unescape(" ".join(out))


def declared_language(page: str | None) -> str | None:
    """What a page declares, lower-cased: the ``lang`` or ``xml:lang`` of the html element, else a content-language meta element.

    A tag ends at the next ``>``, however far; one without declares nothing. Each walk goes from tag to tag, so no part is read twice.
    """
    page = page or ""
    for element, look in ELEMENTS:
        at = 0
        while (m := element.search(page, at)) and (end := page.find(">", m.end())) >= 0:
            if found := look(page, m.end(), end):
                return found[1].lower()
            at = end
    return None


def grams(text: str) -> np.ndarray:
    """Hashed character trigrams of the letters of a text, each word set off by spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes
    if len(codes) < 3:
        return np.empty(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


@dataclass
class LanguageModel:
    """Log probabilities of trigram bins, a column for each language; ``temper`` allows for their dependence."""

    languages: list[str]
    table: np.ndarray
    temper: float = 0.25

    def evidence(self, text: str) -> np.ndarray:
        return self.temper * self.table[grams(text)].sum(axis=0)


def fit_language(docs: DataFrame, sample_rows: int = 300, sample_chars: int = 20_000) -> LanguageModel:
    """Counts trigrams of a bounded sample: ``sample_rows`` documents of each ``lang`` at most,
    those with the smallest id hashes, but for texts over ``sample_chars``.

    docs: ``doc_id``, ``text``, ``lang``; rows with a null are not sampled. All languages of the table are kept. An
    empty table gives a model without languages.
    """
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    named = sorted(counts)
    table = np.full((BINS, len(named)), 0.02)
    if named:
        # Of each language about twice the rows wanted, by a bound on the hash, then those of the smallest hashes.
        draw, rank = F.xxhash64("doc_id"), F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
        sizes = docs.sparkSession.createDataFrame([(x, min(2**63 - 1, int(-(2**63) + 2 * (sample_rows + 50) / n * 2**64))) for x, n in counts.items()], "lang string, bound long")
        picked = known.join(F.broadcast(sizes), "lang").where(draw <= F.col("bound")).withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("doc_id", "lang").distinct()
        texts = docs.select("doc_id", "lang", "text").where(F.length("text") <= sample_chars)
        for row in texts.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text").toLocalIterator():
            np.add.at(table[:, named.index(row["lang"])], grams(row["text"]), 1)
    return LanguageModel(named, np.log(table / table.sum(axis=0)) if named else table)


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, site (its last two labels) and suffix (its last label), lower-cased; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)


def identify_languages(pages: DataFrame, model: LanguageModel, strength: float = 4.0) -> DataFrame:
    """A row per row of ``pages`` (``page_id``, ``url``, ``html``) with its language and the evidence.

    Returns ``page_id``, ``lang`` (the likeliest, ties by name), ``probability``, ``text_lang`` (by text alone),
    ``declared`` (see ``declared_language``), ``suffix`` and ``host``. ``strength`` is the weight,
    in pages, of what a prior is smoothed towards. A page's own posterior is taken out of the priors it meets. Hosts,
    however many pages they have, are summed with partial aggregation, and the sums are joined back by host, which
    adaptive execution splits. Null or empty html leaves the prior alone; a null url has an empty host, all such pages
    sharing one; repeated rows stay. Without languages ``lang`` is null and ``probability`` 0. No rows give no rows.
    """
    n = len(model.languages)

    @F.arrow_udf("struct<declared: string, ll: array<double>>")
    def reader(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found, declared = [], []
            for page in column.to_pylist():
                declared.append(declared_language(page))
                found.append(model.evidence(visible_text(page)).tolist())
            yield pa.StructArray.from_arrays([pa.array(declared, pa.string()), pa.array(found, pa.list_(pa.float64()))], names=["declared", "ll"])

    host, site, suffix = host_parts(F.col("url"))
    rows = cut(pages.select("page_id", host.alias("host"), site.alias("site"), suffix.alias("suffix"), reader(F.col("html")).alias("r")).select("page_id", "host", "site", "suffix", "r.declared", "r.ll"))
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    spread = lambda f: F.array(*[f(k) for k in range(n)])

    def softmax(values: Column) -> Column:
        powers = let(values, lambda vs: let(F.array_max(vs), lambda most: F.transform(vs, lambda v: F.exp(v - most))))
        return let(powers, lambda ps: let(F.aggregate(ps, F.lit(0.0), lambda a, v: a + v), lambda n: F.transform(ps, lambda p: p / n)))

    rows = rows.withColumn("post", softmax(F.col("ll")))
    sums = [F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]
    total = rows.agg(*sums, F.count("*").alias("n")).first()
    base = spread(lambda k: F.lit(((total[f"s{k}"] or 0.0) + 1) / (total["n"] + n)))
    by_suffix = rows.groupBy("suffix").agg(*sums).select("suffix", spread(lambda k: F.col(f"s{k}")).alias("suffix_sum"))
    by_site = rows.groupBy("suffix", "site").agg(*sums).select("suffix", "site", spread(lambda k: F.col(f"s{k}")).alias("site_sum"))
    by_host = rows.groupBy("host").agg(*sums).select("host", spread(lambda k: F.col(f"s{k}")).alias("host_sum"))
    by_mark = rows.groupBy("declared").agg(*sums).select(F.col("declared").alias("mark"), spread(lambda k: F.col(f"s{k}")).alias("mark_sum"))
    met = rows.join(by_host, "host").join(by_site, ["suffix", "site"]).join(by_suffix, "suffix").join(by_mark, rows["declared"].eqNullSafe(F.col("mark")))

    def smoothed(sums_: str, towards: Column) -> Column:
        """The shares of a group without the row itself, smoothed towards a wider group's."""
        others = F.zip_with(F.col(sums_), F.col("post"), lambda s, p: F.greatest(s - p, F.lit(0.0)))
        size = lambda o: F.aggregate(o, F.lit(0.0), lambda a, v: a + v)
        return let(others, lambda o: let(size(o), lambda n: F.zip_with(o, towards, lambda s, t: (s + F.lit(strength) * t) / (n + F.lit(strength)))))

    met = met.withColumn("prior", smoothed("suffix_sum", base)).withColumn("prior", smoothed("site_sum", F.col("prior"))).withColumn("prior", smoothed("host_sum", F.col("prior")))
    # How much likelier the declaration makes a language: its share among such pages to its share among all.
    met = met.withColumn("marked", F.zip_with(smoothed("mark_sum", base), base, lambda m, t: F.log(m) - F.log(t)))
    met = met.withColumn("fused", softmax(F.zip_with(F.zip_with(F.col("ll"), F.col("prior"), lambda v, p: v + F.log(p)), F.col("marked"), lambda v, m: v + m)))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(F.col(c))) - 1).cast("int"))
    return met.select("page_id", best("fused").alias("lang"), F.array_max("fused").alias("probability"), best("post").alias("text_lang"), "declared", "suffix", "host")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """The language of all pages, with text likelihoods learnt from the documents' languages."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    return identify_languages(pages, fit_language(docs))
