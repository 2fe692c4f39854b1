"""Operator 8: language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, checkpointed, text_slices
from tidemark.session import table

#: Labelled rows that the text model is fitted on, the least by a hash of their id; a bound on what the driver reads.
MODEL_ROWS = 3000
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 14
#: Neighbouring trigrams repeat what each other says, so a text's log-likelihood is scaled by this.
TEMPER = 0.1
#: Documents' worth of a host's domain in the host's prior, of all hosts in a domain's, and of even counts in the tables of evidence.
HOST_STRENGTH, DOMAIN_STRENGTH, EVEN = 10.0, 20.0, 1.0

_ELEMENT = re.compile(r"<(html|body|meta)\b", re.IGNORECASE)
_TAG_END = re.compile(r"[<>]")
_LANG = re.compile(r"\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)
_CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)
_TAG = re.compile(r"<[^<>]*>")
_HIDDEN = re.compile(r"<(script|style)\b|<!--", re.IGNORECASE)


def declared_language(markup: str) -> str | None:
    """The primary subtag, lower-cased, that a page's first html or body element with one declares, else its first content-language meta element. A tag runs up to the next angle bracket, however far that is; each is read once."""
    meta = None
    for element in _ELEMENT.finditer(markup):
        end = _TAG_END.search(markup, element.end())
        tag = markup[element.end() : end.start() if end else len(markup)]
        if element.group(1).lower() != "meta":
            if match := _LANG.search(tag):
                return match.group(1).lower()
        elif meta is None and "content-language" in tag.lower() and (match := _CONTENT.search(tag.lower().replace("content-language", "", 1))):
            meta = match.group(1).lower()
    return meta


def visible_text(markup: str) -> str:
    """A page's text without scripts, styles, comments and tags; an unclosed one hides the rest."""
    low, out, at = markup.lower(), [], 0
    while match := _HIDDEN.search(low, at):
        out.append(markup[at : match.start()])
        comment = match.group(1) is None
        at = low.find("-->" if comment else f"</{match.group(1)}", match.end())
        at = at if comment or at < 0 else low.find(">", at)
        if at < 0:
            at = len(low)
            break
        at += 3 if comment else 1
    out.append(markup[at:])
    return html.unescape(_TAG.sub(" ", " ".join(out)))


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket of byte trigrams is met; A-Z lower-cased, digits left out."""
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8).astype(np.uint32)
    data = data[(data < 48) | (data > 57)]
    if len(data) < 3:
        return np.zeros(BUCKETS)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(18)
    return np.bincount(codes, minlength=BUCKETS).astype(np.float64)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities (languages, buckets) of trigrams."""

    languages: tuple[str, ...]
    logs: np.ndarray

    @classmethod
    def fit(cls, rows: Iterator[tuple[str, str]]) -> TextModel:
        counts: dict[str, np.ndarray] = {}
        for language, text in rows:
            own = trigram_counts(text)
            counts[language] = counts.get(language, 0.0) + own
        languages = tuple(sorted(counts))
        found = np.array([counts[x] for x in languages]).reshape(len(languages), BUCKETS) + 0.5
        return cls(languages, np.log(found / found.sum(axis=1, keepdims=True)))

    def score(self, text: str) -> np.ndarray:
        """Log-likelihood of a text in each language, above that of the best."""
        scores = self.logs @ trigram_counts(text)
        return scores - scores.max()


def fit_text_model(docs: DataFrame, rows: int = MODEL_ROWS) -> TextModel:
    """The text model from the rows labelled rows (doc_id, text, lang) with the least hash of their id; of rows that share the last of them, twice as many in all at most."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("place"))
    last = labelled.select("place").orderBy("place").limit(rows).agg(F.max("place")).first()[0]  # so that only hashes are sorted, not texts
    if last is None:
        return TextModel.fit(iter(()))
    return TextModel.fit((r.lang, r.text) for r in labelled.where(F.col("place") <= last).limit(2 * rows).toLocalIterator())


def host_of(url: Column) -> Column:
    """The host that a URL names, lower-cased; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages(page_id, url, html)."""
    host = host_of(F.col("url").cast("string"))
    labels = F.split(host, r"\.")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"), F.lit(True).alias("markup"),
        host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    """Records of documents(doc_id, text, source): plain text, with the source as the host."""
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("markup"),
        source.alias("host"), source.alias("domain"), F.lit(None).cast("string").alias("suffix"),
    )


def identify(records: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, page_id, host, declared, text_lang, lang, probability) of each record.

    The text alone gives each record its weights over languages. Their sums by
    declared language, address suffix, host, domain and overall are the tables of
    evidence; a record's own weights are taken out of its host's and domain's sums.
    A host's prior is its sums shrunk towards its domain's, and those towards the
    overall ones. Weights of a record multiply; evidence that it lacks says nothing.

    Null or empty text: the priors decide. Null hosts share one prior. Ties go to
    the first language by name. A very long text or tag is read whole. Repeated
    records, and those without ids, each get a row; an empty table gives an empty
    table, and so does a model without languages. Other columns are ignored.
    """
    names = ("doc_id", "page_id", "host", "domain", "suffix")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                markup = part.column("markup").to_pylist()
                declared = [declared_language(t) if m else None for t, m in zip(texts, markup)]
                scores = [model.score(visible_text(t) if m else t).tolist() for t, m in zip(texts, markup)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=[*names, "declared", "scores"])

    schema = "doc_id long, page_id long, host string, domain string, suffix string, declared string, scores array<double>"
    output = "doc_id long, page_id long, host string, declared string, text_lang string, lang string, probability double"
    if not model.languages:
        return records.sparkSession.createDataFrame([], output)
    n = range(len(model.languages))
    scored = checkpointed(arrow_map(records, score, schema))
    raw = [F.exp(F.lit(TEMPER) * F.get("scores", F.lit(i))) for i in n]
    weighted = scored.select(*names, "declared", *[r.alias(f"e{i}") for i, r in zip(n, raw)])
    whole = sum((F.col(f"e{i}") for i in n), F.lit(0.0))
    weighted = weighted.select(*names, "declared", *[(F.col(f"e{i}") / whole).alias(f"r{i}") for i in n])

    def sums(key: str, prefix: str) -> DataFrame:
        return weighted.groupBy(F.col(key).alias(f"__{key}")).agg(*[F.sum(f"r{i}").alias(f"{prefix}{i}") for i in n])

    overall = weighted.agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0.0)).alias(f"t{i}") for i in n])
    joined = weighted
    for key, prefix in (("host", "h"), ("domain", "d"), ("declared", "m"), ("suffix", "x")):
        joined = joined.join(checkpointed(sums(key, prefix)), F.col(key).eqNullSafe(F.col(f"__{key}")), "left")  # a plain table, so that Spark may split a hot key's side
    joined = joined.crossJoin(F.broadcast(overall))  # one row

    total = sum((F.col(f"t{i}") for i in n), F.lit(0.0))
    top = [(F.col(f"t{i}") + EVEN) / (total + EVEN * len(n)) for i in n]
    without = {p: [F.greatest(F.col(f"{p}{i}") - F.col(f"r{i}"), F.lit(0.0)) for i in n] for p in "hd"}
    in_domain = sum(without["d"], F.lit(0.0))
    domain = [(without["d"][i] + F.lit(DOMAIN_STRENGTH) * top[i]) / (in_domain + DOMAIN_STRENGTH) for i in n]
    joined = joined.select("*", *[d.alias(f"p{i}") for i, d in zip(n, domain)])
    in_host = sum(without["h"], F.lit(0.0))
    prior = [(without["h"][i] + F.lit(HOST_STRENGTH) * F.col(f"p{i}")) / (in_host + HOST_STRENGTH) for i in n]
    # how often a language's records say what this one says, against how often all do
    said = [F.when(F.col("declared").isNotNull(), (F.col(f"m{i}") + EVEN * top[i]) / (F.col(f"t{i}") + EVEN)).otherwise(1.0) for i in n]
    under = [F.when(F.col("suffix").isNotNull(), (F.col(f"x{i}") + EVEN * top[i]) / (F.col(f"t{i}") + EVEN)).otherwise(1.0) for i in n]
    fused = joined.select("doc_id", "page_id", "host", "declared", *[f"r{i}" for i in n], *[(F.col(f"r{i}") * prior[i] * said[i] * under[i]).alias(f"w{i}") for i in n])

    def best(prefix: str) -> Column:
        top_value = F.greatest(*[F.col(f"{prefix}{i}") for i in n]) if len(n) > 1 else F.col(f"{prefix}0")
        return F.coalesce(*[F.when(F.col(f"{prefix}{i}") >= top_value, F.lit(model.languages[i])) for i in n])

    peak = F.greatest(*[F.col(f"w{i}") for i in n]) if len(n) > 1 else F.col("w0")
    return fused.select("doc_id", "page_id", "host", "declared", best("r").alias("text_lang"), best("w").alias("lang"), F.round(F.try_divide(peak, sum((F.col(f"w{i}") for i in n), F.lit(0.0))), 6).alias("probability"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of documents and of pages: doc_id or page_id, declared, text_lang, lang, probability."""
    docs = table(spark, sf_dir, "documents")
    records = document_records(docs).unionByName(page_records(table(spark, sf_dir, "pages")))
    return identify(records, fit_text_model(docs)).select("doc_id", "page_id", "declared", "text_lang", "lang", "probability")
