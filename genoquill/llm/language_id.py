"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the likelihood of the page's text under byte trigram models, the language
that the markup declares, the language that a segment of the address's path names, and a prior of the host. How far the
declared languages can be trusted is estimated from all pages, by counting them against the language of the text alone.
Host priors are smoothed by hierarchy: all pages, the address suffix, the registered domain, the host, each level adding
its counts to those expected from the one above; they come from grouped aggregations, and a page's own text is taken out
of the counts that it is judged by. The trigram models are counted over every labelled document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BUCKETS, MOST_LANGUAGES = 1 << 14, 128
#: Trigrams overlap, so that a text of n counts as at most FULL independent trigrams of weight WEIGHT.
FULL, WEIGHT = 400, 0.25
#: Pseudo-counts: of a level's parent, and of declared languages.
KAPPA, CLAIM = 5.0, 1.0
_CODE = re.compile(r"[a-z]{2}(?:[-_][a-z0-9]{2,8})?$")
_HTML = re.compile(r"<html\b([^>]*)", re.I | re.A)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?\s*([a-z]+)", re.I | re.A)
_ENDS = {"<script": re.compile("</script", re.I | re.A), "<style": re.compile("</style", re.I | re.A)}
#: Labels that with a country's suffix stand for one, so that a domain is registered below them.
SECOND = frozenset("ac co com edu gob gov mil ne net nom or org".split())


def declared_language(html: str) -> str:
    """The code in lower case, without its region, that the first html tag with a language declares; empty if none does."""
    for tag in _HTML.finditer(html):
        if found := _LANG.search(tag[1]):
            return found[1].lower()
    return ""


def visible_text(html: str) -> str:
    """html without tags, comments, scripts and styles; one pass from left to right, entities are left."""
    out, at = [], 0
    while True:
        tag = html.find("<", at)
        if tag < 0:
            out.append(html[at:])
            return " ".join(out)
        out.append(html[at:tag])
        if html.startswith("<!--", tag):
            end, skip = html.find("-->", tag + 4), 3
        else:
            name = next((n for n in _ENDS if html[tag : tag + len(n)].lower() == n), None)
            if name:
                close = _ENDS[name].search(html, tag + len(name))
                end, skip = close.start() if close else -1, 0
            else:
                end, skip = html.find(">", tag), 1
        if end < 0:
            return " ".join(out)
        at = end + skip


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-case text, letters only, other characters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    raw = np.where(((raw >= 97) & (raw <= 122)) | (raw >= 128), raw, 32).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    key = raw[:-2] * np.uint32(65599) + raw[1:-1] * np.uint32(257) + raw[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    """Languages and the log-probabilities of their trigrams."""

    languages: list[str]
    log_p: np.ndarray

    def likelihoods(self, text: str) -> np.ndarray:
        got = trigrams(text)
        if not len(got):
            return np.zeros(len(self.languages))
        return self.log_p @ np.bincount(got, minlength=BUCKETS) * (WEIGHT * min(1.0, FULL / len(got)))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Trigram models from every document with a language; at most MOST_LANGUAGES languages, or ValueError."""
    schema = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                n = got.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                if len(got) > MOST_LANGUAGES:
                    raise ValueError("too many languages")
                n += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in got.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = usable.select(F.lower(lang_col), F.col(text_col)).mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # MOST_LANGUAGES * BUCKETS rows at the utmost
    languages = sorted(set(sums["lang"].to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    n = np.full((len(languages), BUCKETS), 0.5)
    if languages:
        n[np.searchsorted(languages, sums["lang"].to_pylist()), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)))


def address(url: str | None) -> tuple[str, str, str, str]:
    """(host, registered domain, suffix, language code in the path or '') of an address; empty strings if it has none."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", "", "", ""
    labels = host.split(".")
    code = next((s[:2] for s in parts.path.lower().split("/")[1:3] if _CODE.match(s)), "")
    below = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND
    return host, ".".join(labels[-3 if below else -2 :]), ".".join(labels[-2:]) if below else labels[-1], code


def evidence(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, host, domain, suffix, path and declared codes ('' if none), ll (log-likelihoods)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "domain", "suffix", "path", "declared")], T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            where = [address(u.as_py()) for u in b.column(1)]
            said, ll = [], []
            for h in b.column(2):
                html = h.as_py() or ""
                said.append(declared_language(html))
                ll.append(m.likelihoods(visible_text(html)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in zip(*where, strict=True)], pa.array(said, pa.string()), pa.array(ll, pa.list_(pa.float64()))], names=schema.names)

    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, schema)


def _softmax(x: Column) -> Column:
    """x less its largest element, exponentiated and divided by the sum."""
    top = F.transform(F.array(x), lambda v: F.transform(v, lambda e: F.exp(e - F.array_max(v))))[0]
    return F.transform(F.array(top), lambda v: F.transform(v, lambda e: e / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]


def _claims(own: DataFrame, column: str, languages: list[str]) -> Column:
    """Array expression: log P(the code in column | language), estimated over all pages against the text's own language.

    Codes that aren't a known language count as 'other'; no code is no evidence, and says nothing.
    """
    k = len(languages)
    seen = own.where(F.col(column) != "").select(F.when(F.col(column).isin(languages), F.col(column)).otherwise("other").alias("code"), *[F.col("post")[i].alias(f"p{i}") for i in range(k)])
    rows = {r[0]: list(r[1:]) for r in seen.groupBy("code").agg(*[F.sum(f"p{i}") for i in range(k)]).collect()}  # a row per language and one
    codes = [*languages, "other"]
    table = {c: [rows.get(c, [0.0] * k)[i] + CLAIM * (4.0 if c == languages[i] else 1.0 / (k + 1)) for i in range(k)] for c in codes}
    total = [sum(table[c][i] for c in codes) for i in range(k)]
    out = F.array(*[F.lit(0.0)] * k)
    for c in codes:
        logs = F.array(*[F.lit(math.log(table[c][i] / total[i])) for i in range(k)])
        out = F.when((F.col(column) == c) if c != "other" else ((F.col(column) != "") & ~F.col(column).isin(languages)), logs).otherwise(out)
    return out


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of pages: id_col, lang, confidence, text_lang (by the text alone), declared, path_lang, host.

    Null pages have no text and null addresses no host: what evidence there is decides, with none the most frequent language.
    Equal posteriors are settled by the order of the language codes. Without labelled documents lang is null. Null or
    repeated ids, other columns and empty tables don't matter.
    """
    model = train(docs, lang_col, text_col)
    languages, k = model.languages, len(model.languages)
    own = evidence(pages, model, id_col, url_col, html_col)
    if not k:
        return own.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", F.col("path").alias("path_lang"), "host")
    own = materialize(own.withColumn("post", _softmax(F.col("ll"))), "evidence")
    total = lambda frame, keys, c: frame.groupBy(*keys).agg(*[F.sum(c(i)).alias(f"n{i}") for i in range(k)]).select(*keys, F.array(*[f"n{i}" for i in range(k)]).alias("n"))
    hosts = materialize(total(own, ["host", "domain", "suffix"], lambda i: F.col("post")[i]), "hosts")
    domains = total(hosts, ["domain", "suffix"], lambda i: F.col("n")[i])
    suffixes = total(hosts, ["suffix"], lambda i: F.col("n")[i])
    everything = total(hosts, [], lambda i: F.col("n")[i]).first()[0]
    everything = [x or 0.0 for x in everything]
    levels = hosts.withColumnRenamed("n", "n3").join(domains.withColumnRenamed("n", "n2"), ["domain", "suffix"]).join(suffixes.withColumnRenamed("n", "n1"), "suffix").select("host", "n1", "n2", "n3")
    joined = own.join(levels, "host")
    without = lambda n: F.zip_with(n, "post", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def level(n: Column, above: Column) -> Column:
        return F.transform(F.array(F.struct(n.alias("n"), above.alias("p"))), lambda s: F.transform(F.zip_with(s["n"], s["p"], lambda a, b: a + KAPPA * b), lambda v: v / (F.aggregate(s["n"], F.lit(0.0), lambda a, b: a + b) + KAPPA)))[0]

    p0 = F.array(*[F.lit((x + 1.0) / (sum(everything) + k)) for x in everything])
    joined = joined.withColumn("p1", level(without(F.col("n1")), p0)).withColumn("p2", level(without(F.col("n2")), F.col("p1"))).withColumn("p3", level(without(F.col("n3")), F.col("p2")))
    prior = F.transform("p3", lambda v: F.ln(v + 1e-9))
    fused = add(add(F.col("ll"), prior), add(_claims(own, "declared", languages), _claims(own, "path", languages)))
    joined = joined.withColumn("fused", _softmax(fused))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select(F.col("id").alias(id_col), best(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("confidence"), best(F.col("post")).alias("text_lang"), "declared", F.col("path").alias("path_lang"), "host")
