"""Language ID of web pages: Bayesian fusion of text, declared language, address and host.

1. Text: byte trigrams (hashed to ``BUCKETS``) of the visible text against one
   trigram distribution for each language, learnt from at most ``MAX_TRAIN`` labelled
   documents of each. Trigrams are not independent, so a text counts as
   ``EFFECTIVE`` of them at most.
2. Declared language (``<html lang>``, sought in the whole page outside comments, scripts and styles) and address suffix (the host's last
   label): P(value | language) from counts over all pages, each page counted
   by its text posterior, smoothed by ``ALPHA``.
3. Host priors, smoothed hierarchically: a host's expected counts over the
   registered domain's, over the whole corpus'. A page's own share
   is taken out of its host's counts.

The fused posterior is proportional to prior x text x declared x suffix. Counts are grouped
aggregations over all pages; pages meet their host's prior in a salted join, so a
host with a third of all pages is dealt over ``SALTS`` tasks.

Defined cases: null or empty html has no text and no declaration (its priors
decide); null or unparsable addresses share the empty host; ties go to the language first in
``languages``; without labelled documents all languages have the same text likelihood;
repeated rows are pages of their own; further columns are passed over.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.joins import bounded_broadcast
from touchline.llm.common import binary_texts, cut, map_arrow, text_slices
from touchline.llm.textops import LOWER

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 14
MAX_TRAIN = 400
EFFECTIVE = 60
ALPHA = 1.0
STRENGTH = 5.0
SALTS = 16

_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
# what a tag cannot open in (an end that is missing is the page's end), or an html tag with its attributes
_OPENING = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<html\b((?:\"[^\"]*\"|'[^']*'|[^>])*)", re.S | re.I)
_DECLARED = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: bytes) -> bytes:
    text = _TAG.sub(b" ", _HIDDEN.sub(b" ", page))
    return html.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def declared(page: bytes) -> str | None:
    """Language of the first html tag that names one, wherever it stands outside comments, scripts and styles."""
    for tag in _OPENING.finditer(page):
        if tag[2] and (found := _DECLARED.search(tag[2])):
            return found[1].decode().lower()
    return None


def trigrams(text: bytes) -> np.ndarray:
    b = LOWER[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS) if len(text) else np.zeros(0, np.uint32)


def train(docs: DataFrame, languages=LANGUAGES, max_train: int = MAX_TRAIN) -> np.ndarray:
    """(languages x BUCKETS) log probabilities, from the documents of smallest id hash in each language."""
    # first within salted parts of a language, then among their first ones: no task gets a language whole
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (docs.where(F.col("lang").isin(*languages) & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
              .withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SALTS * SALTS)))
              .withColumn("_n", least("lang", "_salt")).where(F.col("_n") <= max_train)
              .withColumn("_n", least("lang")).where(F.col("_n") <= max_train).drop("_n", "_salt"))
    # max_train rows for each language at most
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def count(batch):
        for lang, t in zip(batch.column("lang").to_pylist(), binary_texts(batch)):
            b, n = np.unique(trigrams(t), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    counts = np.full((len(languages), BUCKETS), 0.5)
    summed = map_arrow(texts, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    for lang, b, n in summed.toLocalIterator():       # languages x BUCKETS rows at most
        counts[languages.index(lang), b] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _evidence(pages: DataFrame, model: np.ndarray, languages) -> DataFrame:
    """page_id, url, declared, t_<lang>: posterior of the text alone under a flat prior."""
    table = model.T.copy()

    def run(batch):
        pages_, urls = binary_texts(batch, "html"), batch.column("url")
        for part in text_slices(pages_):
            rows = []
            for p in pages_[part]:
                g = trigrams(visible(p).strip())
                ll = table[g].sum(axis=0) * min(1.0, EFFECTIVE / max(1, len(g))) if len(g) else np.zeros(len(languages))
                e = np.exp(ll - ll.max())
                rows.append(e / e.sum())
            n = len(rows)
            known = [declared(p) for p in pages_[part]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(part.start, n), urls.slice(part.start, n), pa.array(known, pa.string()),
                                              *(pa.array(np.array(rows)[:, j]) for j in range(len(languages)))],
                                             names=["page_id", "url", "declared", *(f"t_{x}" for x in languages)])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, declared string, " + ", ".join(f"t_{x} double" for x in languages))


def _given(rows: DataFrame, value: str, languages, prefix: str) -> DataFrame:
    """value, <prefix><lang>: P(value | language) with additive smoothing over the values that occur."""
    counts = rows.groupBy(value).agg(*(F.sum(f"t_{x}").alias(f"_{x}") for x in languages))
    totals = counts.agg(*(F.sum(f"_{x}").alias(f"_s{x}") for x in languages), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(value, *(((F.col(f"_{x}") + ALPHA) / (F.col(f"_s{x}") + ALPHA * F.col("_k"))).alias(f"{prefix}{x}") for x in languages))


def _argmax(columns: list[Column], names) -> Column:
    best = F.greatest(*columns)
    out = F.lit(names[-1])
    for c, n in reversed(list(zip(columns, names))):
        out = F.when(c == best, F.lit(n)).otherwise(out)
    return out


def identify(pages: DataFrame, docs: DataFrame, languages=LANGUAGES) -> DataFrame:
    """page_id, lang, confidence, text_lang, text_confidence, declared, suffix, host: one row for each page."""
    model = train(docs, languages)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))
    known = F.col("declared").isin(*languages)
    rows = cut(_evidence(pages, model, languages)
               .withColumns({"host": host, "said": F.when(F.col("declared").isNull(), "none").when(known, F.col("declared")).otherwise("other")})
               .withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2)).drop("url"))
    mass = [F.sum(f"t_{x}") for x in languages]
    hosts = rows.groupBy("host", "domain").agg(*(m.alias(f"h_{x}") for m, x in zip(mass, languages)), F.count("*").alias("h_n"))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h_{x}").alias(f"d_{x}") for x in languages), F.sum("h_n").alias("d_n"))
    overall = rows.agg(*(m.alias(f"a_{x}") for m, x in zip(mass, languages)), F.count("*").alias("a_n"))
    share = lambda x: (F.col(f"a_{x}") + ALPHA) / (F.col("a_n") + ALPHA * len(languages))
    domains = domains.crossJoin(F.broadcast(overall)).select("domain", *(((F.col(f"d_{x}") + STRENGTH * share(x)) / (F.col("d_n") + STRENGTH)).alias(f"d_{x}") for x in languages))
    priors = hosts.join(domains, "domain").drop("domain").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    said, suffix = _given(rows, "said", languages, "s_"), _given(rows, "suffix", languages, "x_")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    fused = salted.join(priors, ["host", "salt"]).join(F.broadcast(said), "said").join(bounded_broadcast(suffix), "suffix")   # said: a value for each language and two more
    prior = lambda x: (F.greatest(F.col(f"h_{x}") - F.col(f"t_{x}"), F.lit(0.0)) + STRENGTH * F.col(f"d_{x}")) / (F.col("h_n") - 1 + STRENGTH)
    # sums of logarithms, so that a product of small numbers does not vanish
    fused = fused.withColumns({f"p_{x}": F.log(prior(x)) + F.log(F.greatest(F.col(f"t_{x}"), F.lit(1e-300))) + F.log(f"s_{x}") + F.log(f"x_{x}") for x in languages})
    best = F.greatest(*(F.col(f"p_{x}") for x in languages))
    total = sum((F.exp(F.col(f"p_{x}") - best) for x in languages[1:]), F.exp(F.col(f"p_{languages[0]}") - best))
    texts = [F.col(f"t_{x}") for x in languages]
    return fused.select("page_id", _argmax([F.col(f"p_{x}") for x in languages], languages).alias("lang"), (1 / total).alias("confidence"),
                        _argmax(texts, languages).alias("text_lang"), F.greatest(*texts).alias("text_confidence"), "declared", "suffix", "host")
