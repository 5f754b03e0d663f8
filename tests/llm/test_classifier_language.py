import re
import zlib

import numpy as np

from genoquill.llm import language_id as L
from genoquill.llm import quality_classifier as Q

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = Q.score(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    good, bad = (np.array([r.score for r in held if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.99


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    texts = [b" ".join(rng.choice([b"aa", b"bb!", b"Cc", b"9"], 20)) for _ in range(60)]
    m = Q.fit([(*Q.counts(t), i % 2) for i, t in enumerate(texts)], dims=8)
    got = m.score(texts[:20], block=7)
    for t, s in zip(texts[:20], got, strict=True):
        near = m.vectors @ m.embed(t)
        top = np.argsort(near)[-Q.NEIGHBOURS :]
        w = np.maximum(near[top], 1e-3) ** Q.SHARPNESS
        assert abs(s - (w * m.labels[top]).sum() / w.sum()) < 1e-5


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(2, "good words here", 9), (3, "!! $$ ##", 9), (3, "!! $$ ##", 9), (None, None, 9), (5, "", 9), (6, "x " * 40_000, 9)], "doc_id long, text string, quality int")
    out = Q.score(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert [r.score for r in out if r.doc_id in (None, 5)] == [0.0, 0.0]
    assert [r.score for r in Q.score(docs, labels.limit(0)).collect() if r.doc_id == 2] == [0.5]
    assert Q.score(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns


def test_text_and_address():
    assert L.visible_text("<p>a<b>b</b><!-- <p>no --> c<script>x<p></script>d<style>e").split() == ["a", "b", "c", "d"]
    assert L.address("https://m.x.example.co/fr/12?q") == ("m.x.example.co", "example.co", "co", "fr")
    assert L.address(None) == ("", "", "", "") and L.address("http://[bad") == ("", "", "", "")


def test_language_against_plain_computation(spark):
    docs, pages = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = L.train(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = {r.page_id: r for r in L.identify(pages, docs).collect()}
    src = pages.collect()
    assert len(rows) == len(src)
    ll = {p.page_id: model.likelihoods(L.visible_text(p.html or "")) for p in src}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    post, where = {i: soft(x) for i, x in ll.items()}, {p.page_id: L.address(p.url) for p in src}
    k = 4
    everything = sum(post.values())
    p0 = (everything + 1) / (everything.sum() + k)
    tag = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
    said = {p.page_id: (m[1].lower() if (m := tag.search(p.html or "")) else "") for p in src}

    def claims(codes):
        names = [*model.languages, "other"]
        n = {c: np.full(k, L.CLAIM / (k + 1)) for c in names}
        for i, c in enumerate(model.languages):
            n[c][i] = 4.0 * L.CLAIM
        for i, c in codes.items():
            if c:
                n[c if c in model.languages else "other"] += post[i]
        total = sum(n.values())
        return lambda c: np.zeros(k) if not c else np.log(n[c if c in model.languages else "other"] / total)

    declared, path = claims(said), claims({i: w[3] for i, w in where.items()})
    for i, r in rows.items():
        p = p0
        for keys in (lambda w: (w[2],), lambda w: (w[1], w[2]), lambda w: (w[0], w[1], w[2])):
            n = np.maximum(sum(post[j] for j in post if keys(where[j]) == keys(where[i])) - post[i], 0)
            p = (n + L.KAPPA * p) / (n.sum() + L.KAPPA)
        f = soft(ll[i] + np.log(p + 1e-9) + declared(said[i]) + path(where[i][3]))
        assert r.lang == model.languages[int(f.argmax())] and abs(r.confidence - f.max()) < 1e-5


def test_language_edges(spark):
    docs = spark.createDataFrame([("en", "the of and to in"), ("fr", "le la les des une"), (None, "x"), ("en", None)], "lang string, text string")
    pages = spark.createDataFrame([(1, None, None, "z"), (1, "http://a.fr/fr/1", "<html lang=fr><p>les des une la", "z"), (None, "x", "", "z")], "page_id long, url string, html string, host string")
    out = L.identify(pages, docs).collect()
    assert len(out) == 3 and all(r.lang in ("en", "fr") for r in out)
    assert [r.lang for r in out if r.host == "a.fr"] == ["fr"]
    assert L.identify(pages.limit(0), docs).count() == 0
    assert [r.lang for r in L.identify(pages, docs.limit(0)).collect()] == [None] * 3
