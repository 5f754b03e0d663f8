import hashlib
import io
import math
import random
import re
from collections import Counter

import pytest

from genoquill.llm import chat_format, exact_dedup, mixing, quality_rules, warc

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "a  b", " a\tb", "a\nb", "", None, "é\xa0x", "c" * 100_000, f"u{i}"])) for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), radix=3).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(4, "x", 1), (4, "x", 2), (None, "x", 3), (None, "y", 3), (None, "y", 3)], "doc_id long, text string, row long")
    out = exact_dedup.exact_duplicates(df).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in out) == [("4", 3, False), ("4", 3, False), ("4", 3, True), ("None", 2, False), ("None", 2, True)]


def brute_rules(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 5000, "l\nl\nl \n\n", "# $ | é\xa0é <b>\n# $ |", "日本 語 " * 30]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 200))) + rng.choice(["", "\n"]) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.score(df).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_label_model_finds_accuracies():
    rng, seen, truth = random.Random(0), Counter(), []
    for _ in range(20_000):
        y = 1 if rng.random() < 0.8 else -1
        votes = tuple(y * (1 if rng.random() < a else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.85, 0.6))
        seen[votes] += 1
        truth.append((y, votes))
    prior, w = quality_rules.fit_label_model(sorted(seen.items()))
    gain = [x[1] - x[-1] for x in w]
    assert min(gain) == gain[3] > 0
    said = [1 if prior + sum(w[j][v] for j, v in enumerate(votes)) > 0 else -1 for _, votes in truth]
    assert sum(a == y for a, (y, _) in zip(said, truth, strict=True)) > 0.94 * len(truth)
    assert quality_rules.fit_label_model([]) == (0.0, [])


def test_rules_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_rules.score(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.75


HARD = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<\\|", "<\\\\|x<||", "", None, "\n", "é<|日本|>", "a" * 50_000, "\x00n"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "a\nb\x00c<|x"][(c + t) % 5], HARD[(3 * c + t) % len(HARD)]) for c in range(8) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat_format.format_turns(df)
    whole = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.conv, r.turn)):
        role, text = chat_format.parse_chunk(bytes(r.chunk))
        want = next(x for x in rows if x[:2] == (r.conv, r.turn))
        assert (role, text) == (want[2] or "", want[3] or "")
        assert bytes(r.chunk).count(b"<|") == 2
        whole.setdefault(r.conv, []).append(bytes(r.chunk))
    for r in chat_format.read_back(formatted).collect():
        own = sorted(x for x in rows if x[0] == r.conv)
        assert r.n_turns == 6
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(b"".join(whole[r.conv]).decode())


def test_chat_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(empty)).count() == 0
    rows = [(None, None, None, None, 1), (None, 1, "user", "x", 1), (2, 1, "user", "same", 1), (2, 1, "user", "same", 1)]
    out = chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk long"))).collect()
    assert sorted((str(r.conv), r.n_turns) for r in out) == [("2", 2), ("None", 2)]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\n", ""), (5, "x", "\r\n\r\nWARC/1.1 é"), (6, "y", "z" * 300_000), (2, "http://b/", "same"), (None, "n", "same")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(pages)
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got)
    assert kinds == sorted([("1", "response", "None"), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "response", "None"), ("4", "revisit", "3"), ("5", "response", "None"), ("6", "response", "None"), ("None", "response", "None")])
    for r in got:
        body = next((p[2] or "") for p in pages if p[0] == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest_of(body))
        assert r.record_type == "revisit" or bytes(r.payload) == body
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_finds_faults():
    good = warc.record_bytes("response", "1", "u", b"hello", warc.digest_of(b"hello"), None)
    assert [p for _, _, p in warc.read_records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.record_bytes("response", "1", "u", b"hello", warc.digest_of(b"other"), None))))
    with pytest.raises((ValueError, Exception)):
        list(warc.read_records(io.BytesIO(good[:-5])))


def _sources(spark):
    rng = random.Random(8)
    rows = [(i, s, " ".join(["w"] * rng.randint(1, 60))) for i, s in enumerate(rng.choices(["big", "mid", "small", None], [70, 20, 8, 2], k=3000))]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mixing_exponent_and_weights(spark):
    rows, df = _sources(spark)
    tokens = mixing.source_tokens(df)
    n = {r.source: r.tokens for r in tokens.collect()}
    total = sum(n.values())
    entropy = lambda t: (lambda q: -sum(x / sum(q) * math.log(x / sum(q)) for x in q) / math.log(len(q)))([(v / total) ** t for v in n.values()])
    t = mixing.find_exponent(tokens, entropy=0.9)
    assert abs(entropy(t) - 0.9) < 1e-5
    t = mixing.find_exponent(tokens, repeats=3.0)
    p = [(v / total) ** (t - 1) for v in n.values()]
    assert abs(max(p) / min(p) - 3.0) < 1e-4


def test_mixing_fills_budgets(spark):
    rows, df = _sources(spark)
    for options in ({"repeats": 3.0}, {"entropy": 0.9}, {"entropy": 0.9, "budget": 40_000.0}):
        out = mixing.plan(df, block_docs=100, **options).collect()
        assert len(out) == len(rows)
        by = {}
        for r in out:
            by.setdefault(r.source, []).append(r)
        for rs in by.values():
            want = rs[0].epochs * sum(r.n_tokens for r in rs)
            assert abs(sum(r.copies * r.n_tokens for r in rs) - want) <= 61
            assert len({r.copies for r in rs}) <= 2
        if "budget" not in options:
            assert min(r.copies for r in out) == 1
    mixed = mixing.mix(df, repeats=3.0)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in mixing.plan(df, repeats=3.0).collect())


def test_mixing_edges(spark):
    assert mixing.plan(spark.createDataFrame([], "doc_id long, source string, text string"), repeats=2.0).count() == 0
    df = spark.createDataFrame([(1, None, None, 1.0), (1, None, "", 1.0), (None, "a", "x y", 1.0), (None, "a", "x y", 1.0)], "doc_id long, source string, text string, weight double")
    out = mixing.plan(df, repeats=2.0).collect()
    assert len(out) == 4 and all(r.copies == 1 for r in out)
