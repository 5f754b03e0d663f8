"""Nulls, repeated ids, empty tables, clashing columns and very long texts; brute-force versions of rules and mixing."""

import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from genoquill.llm import chat_format, language_id, mixing, quality_classifier, quality_rules, simhash, warc

D = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, row int, n int, pos int, score double, keep boolean"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    """Clean documents of their own beside nulls, empty and very long texts, repeated rows and ids, ties."""
    rng = random.Random(1)
    own = [words(rng, 60) for _ in range(8)]
    long = words(rng, 30_000)
    texts = [(1, own[0]), (2, own[1]), (2, own[2]), (None, own[3]), (None, own[4]), (None, own[4]), (3, None), (4, ""), (5, " \n "), (6, long), (7, own[5]), (7, own[5]), (8, own[5]), (9, f"{own[6]}\n{own[7]}")]
    return [(i, t, "en", ("a", "b", None)[k % 3], len(t or ""), "x", 1, 2, 3, 4, 0.5, True) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    """A folder of tables with the rows above and labels for some of them."""
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), COLUMNS).coalesce(1).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (6, 1, 0), (7, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_a_stage_takes_any_table(spark, table_dir, k):
    name, stage = P.STAGES[k]
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    got = stage(spark, docs, table_dir)
    if stage is not P.pieces:
        assert got.columns == docs.columns
    assert stage(spark, docs.limit(0), table_dir).count() == 0
    out, texts = got.collect(), Counter((r[0], r[1]) for r in rows())
    if stage is P.pieces:
        assert len(out) == len(rows()) and all(r.lossless for r in out)
        return
    left = Counter((r.doc_id, r.text) for r in out)
    clean = {t for t in texts if t[1] and t[1].strip()}
    if stage is P.quality:
        assert set(left) <= set(texts) and clean <= set(left)
    if stage in (P.lines, P.near_duplicates):  # every wording stays, and no group of copies loses all of its rows
        assert {t for _, t in clean} <= {t for _, t in left}
    if stage is P.near_duplicates:
        assert left[(7, clean and [t for i, t in clean if i == 7][0])] == 1 and (8, [t for i, t in clean if i == 8][0]) not in left
        assert sum(1 for i, t in left if not (t or "").strip()) == 1
    if stage is P.mixture:
        assert all(left[t] >= texts[t] for t in texts)


def test_the_pipeline_takes_any_table(spark, table_dir):
    out = P.run(spark, table_dir).collect()
    assert all(r.lossless for r in out) and {1, 2, 6, 9} <= {r.doc_id for r in out}


def test_different_texts_without_id_stay(spark):
    rng = random.Random(4)
    texts = [words(rng, n) for n in (20, 25, 30, 35)]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (7, texts[0]), (7, texts[3])], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert got == Counter({(7, texts[0]): 1, (None, texts[1]): 1, (5, texts[2]): 1, (7, texts[3]): 1})


def test_shingle_hashes_by_hand():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "AB", "cd", "x" * 70, "yY"]) for _ in range(rng.randint(0, 12))).encode() for _ in range(200)]
    plain = lambda raw: [tuple(w[i : i + 5]) for w in [raw.lower().split()] for i in range(max(1, len(w) - 4)) if w]
    got, want = simhash.shingle_hashes(texts, 5), [plain(x) for x in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    of = defaultdict(set)
    for h, s in zip(np.concatenate(got).tolist(), [x for w in want for x in w]):
        of[h].add(s)
    assert all(len(s) == 1 for s in of.values()) and len(of) == len({x for w in want for x in w})


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_archives_in_any_pieces(chunk):
    bodies = [b"", b"a", b"\r\n\r\n", b"x" * 100_000, bytes(range(256)) * 50]
    data = b"".join(warc.record_bytes("response", str(i), "u", x, warc.digest_of(x), None) for i, x in enumerate(bodies))
    assert [p for _, _, p in warc.read_records(io.BytesIO(data), chunk)] == bodies
    for bad in (data[:-1], data + b"x", data[: len(data) // 2]):
        with pytest.raises((ValueError, Exception)):
            list(warc.read_records(io.BytesIO(bad), chunk))


def test_chunks_of_long_turns(monkeypatch, spark):
    texts = ["a" * 5_000_000, "", "<|im_end|>" * 1000, "é" * 70_000, None]
    want = [b"<|im_start|>user\n" + chat_format.escape(pa.array([t], pa.string()))[0].as_py().encode() + b"<|im_end|>\n" for t in texts]
    for scatter in (1, 100, 1 << 20):
        monkeypatch.setattr(chat_format, "SCATTER", scatter)
        chunks, lo, hi = chat_format.assemble(pa.array(["user"] * len(texts)), pa.array(texts))
        assert chunks.to_pylist() == want
    turns = spark.createDataFrame([(1, k, "assistant", "é" * 300) for k in range(50)], "conv_id long, turn int, role string, text string")
    whole = chat_format.read_back(chat_format.format_turns(turns)).collect()
    monkeypatch.setattr(chat_format, "BUFFER", 1000)
    assert chat_format.read_back(chat_format.format_turns(turns)).collect() == whole


def test_languages_of_odd_pages():
    assert language_id.visible_text("İİİİİİİİ<p>eins zwei<!-- weg --> drei").split() == ["İİİİİİİİ", "eins", "zwei", "drei"]
    assert language_id.visible_text("İ<SCRIPT>x</ScRiPt>y<Style>z</style>ſ").split() == ["İ", "y", "ſ"]
    assert language_id.declared_language("<!-- <html> -->" + " " * 19_980 + "<html class='x' lang='fr-CA'>") == "fr"
    assert language_id.declared_language(f"<html data-lang='xx' {'a=1 ' * 5000} lang=FIL>") == "fil"
    assert language_id.declared_language("<html>") == "" and language_id.declared_language("") == ""
    assert language_id.address("https://a.b.example.co.uk/x")[:3] == ("a.b.example.co.uk", "example.co.uk", "co.uk")
    assert language_id.address("https://www.example.org/")[1] == "example.org"


def test_posterior_and_kept_by_hand(spark):
    got = quality_rules.score(spark.read.parquet(f"{D}/documents.parquet")).collect()
    names = [c for c in got[0].__fields__ if c.startswith("v_")]
    votes = np.array([[r[c] for c in names] for r in got])
    two_sided = (votes > 0).any(axis=0)
    few = max(1.0, quality_rules.BELIEF * len(got))
    flag = np.full(len(names), quality_rules.FLAG)
    says = np.tile([quality_rules.SAYS[0], quality_rules.SAYS[1]], (len(names), 1))
    start = math.log(quality_rules.GOOD / (1 - quality_rules.GOOD))

    def odds():
        out = np.full(len(votes), start)
        for j in range(len(names)):
            if two_sided[j]:
                out += np.where(votes[:, j] > 0, max(0.0, math.log(says[j, 1] / says[j, 0])), np.where(votes[:, j] < 0, min(0.0, math.log((1 - says[j, 1]) / (1 - says[j, 0]))), 0.0))
            else:
                out -= np.where(votes[:, j] < 0, max(0.0, math.log(flag[j] / (1 - flag[j])) + start), 0.0)
        return out

    for _ in range(quality_rules.ROUNDS):
        p = 1 / (1 + np.exp(-odds()))
        for j in range(len(names)):
            cast, up = votes[:, j] != 0, votes[:, j] > 0
            bad, good = (1 - p)[cast].sum(), p[cast].sum()
            flag[j] = (bad + few * quality_rules.FLAG) / (bad + good + few)
            says[j] = [((1 - p)[up].sum() + few * quality_rules.SAYS[0]) / (bad + few), (p[up].sum() + few * quality_rules.SAYS[1]) / (good + few)]
    p = 1 / (1 + np.exp(-odds()))
    assert max(abs(r.posterior - x) for r, x in zip(got, p)) < 2e-6
    for r, x in zip(got, p):
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (abs(x - 0.5) < 1e-5 or r.kept == (not failed and x >= 0.5))


def test_rules_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (5, None, 3), (5, "", 4)], "doc_id long, text string, n_words int")
    got = quality_rules.score(docs).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.base_failed, r.kept) for r in got) == [(0, 2, True, False), (0, 2, True, False), (5, 0, True, False), (5, 0, True, False)]


def test_mixing_by_hand(spark):
    """The rows that whole epochs, whole blocks and the block on the edge give, recomputed from the hashes that order them."""
    rng = random.Random(9)
    data = [(i, ("big", "mid", "tiny")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], words(rng, rng.randint(0, 40))) for i in range(400)]
    data += [(400, "mid", None), (400, "mid", "x y"), (None, "tiny", "some words here"), (401, "tiny", words(rng, 5000))]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").coalesce(1)
    seed, size = 42, 30
    got = mixing.plan(docs, repeats=2.0, block_docs=size, seed=seed).collect()
    assert len(got) == len(data)
    marks = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "source", "row", F.xxhash64(F.lit(seed), "doc_id", "row").alias("deal"), F.xxhash64(F.lit(seed + 2), "doc_id").alias("inner")).collect()
    numbers = spark.range(100).select("id", F.xxhash64(F.lit(seed + 1), "id").alias("o")).collect()
    outer = {r.id: r.o for r in numbers}
    n_words = {r.row: len((data[r.row][2] or "").split()) for r in marks}
    epochs = {r.source: r.epochs for r in got}
    want = Counter()
    for source in epochs:
        mine = [r for r in marks if r.source == source]
        total = sum(n_words[r.row] for r in mine)
        whole = math.floor(epochs[source] + 1e-6)
        rest = max(0, round((epochs[source] - whole) * total))
        blocks = defaultdict(list)
        for r in mine:
            blocks[r.deal % math.ceil(len(mine) / size)].append(r)
        before = 0
        for b in sorted(blocks, key=lambda b: (outer[b], b)):
            held = sum(n_words[r.row] for r in blocks[b])
            if before < rest < before + held:
                till = before
                for r in sorted(blocks[b], key=lambda r: (r.inner, r.row)):
                    till += n_words[r.row]
                    want[(source, r.doc_id, n_words[r.row], whole + (till - n_words[r.row] / 2 <= rest))] += 1
            else:
                for r in blocks[b]:
                    want[(source, r.doc_id, n_words[r.row], whole + (rest > 0 and before + held <= rest))] += 1
            before += held
    have = Counter((r.source, r.doc_id, r.n_tokens, r.copies) for r in got)
    assert sum((have - want).values()) <= 2  # epochs are rounded to six places


def test_classifier_of_repeated_ids(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = [(2, "good words in a row here"), (2, "other good words of that id"), (3, "!! $$ ##")]
    a, b = (sorted((r.doc_id, r.score) for r in quality_classifier.score(spark.createDataFrame(x, "doc_id long, text string"), labels).collect()) for x in (docs, docs[::-1]))
    assert a == b
