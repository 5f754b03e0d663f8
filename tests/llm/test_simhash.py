import random

import pytest
import xxhash

from genoquill.llm import simhash as S
from genoquill.llm.components import connected_components


def brute_fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: min(j for j in ids if find(j) == find(i)) for i in ids}


def texts():
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 5) + rng.choice("xyz") for _ in range(200)]
    out = {}
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        out[len(out) + 1] = " ".join(base)
        for _ in range(i % 4):
            base = list(base)
            base[rng.randrange(len(base))] = "edited"
            out[len(out) + 1] = "  ".join(base) + "\n"
    return out | {9001: None, 9002: "", 9003: " \t\n", 9004: "One", 9005: "ONE", 9006: "one two three", 9007: "w " * 20_000, 9008: "É é \xa0x y z"}


def test_against_brute_force(spark):
    t = texts()
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(list(t.items()), "doc_id long, text string")).collect()}
    fps = {i: brute_fingerprint(x) for i, x in t.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_large_bucket_is_tiled(spark):
    """More fingerprints that share blocks than a tile holds: a chain of small steps and strangers."""
    rng, fps = random.Random(3), set()
    x = rng.getrandbits(64)
    while len(fps) < 2500:
        fps.add(x)
        x ^= 1 << rng.randrange(37)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = connected_components(S.links(df, 4, 7), "a", "b")
    assert roots.count() == len(fps) and roots.select("root").distinct().count() == 1


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
    rows = [(5, "a b c d e", "x"), (5, "a b c d e", "y"), (None, "a b c d e", "z"), (7, "other words here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(str(r.component_id) for r in S.near_duplicates(df).collect()) == ["5", "5", "5", "7"]
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == [5, 7]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        assert got[n] == min(seen)


def test_keep_one_at_similarity(spark):
    rng = random.Random(9)
    docs, groups = [], []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        members = []
        for k in range(3):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
            members.append(len(docs) - 1)
        groups.append(members)
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {m[0] for m in groups}


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_kept(docs):
    """Ids that stay by all pairs of whole shingle sets; docs: (id, text) with distinct ids."""
    docs = sorted(docs)
    sets, root = [shingle_set(t) for _, t in docs], list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if root[i] != root[j] and (5 * len(a & b) >= 4 * len(a | b)):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {docs[i][0] for i in range(len(docs)) if root[i] == i}


def test_keep_one_finds_every_pair_at_the_threshold(spark):
    """Pairs of 0.80 to 0.85: bands of fingerprints missed a share of them."""
    rng = random.Random(3)
    docs = []
    for g in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(80 + g)]
        words = list(base)
        words[: len(base) // 13] = [f"z{rng.randrange(10**6)}" for _ in range(len(base) // 13)]
        words[-1 - len(base) // 60 :] = [f"z{rng.randrange(10**6)}" for _ in range(1 + len(base) // 60)]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(words))]
    near = [len(a & b) / len(a | b) for a, b in ((shingle_set(docs[2 * g][1]), shingle_set(docs[2 * g + 1][1])) for g in range(150))]
    assert sum(0.8 <= x < 0.85 for x in near) > 80
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == brute_kept(docs)


@pytest.mark.parametrize(("share", "most"), [(0.0, 10), (1 / 16, 1_000_000), (1.0, 10), (1.0, 0)])
def test_the_sample_orders_shingles_only(spark, monkeypatch, share, most):
    """What stays is the same whichever shingles a sample holds, none included."""
    for name, value in (("SAMPLE", share), ("LEAST_SAMPLE", 0), ("MOST_OFTEN", most), ("OFTEN", 1)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(6)
    docs = []
    for g in range(60):
        base = "a passage that many of the texts hold word by word".split() * (g % 2) + [f"w{rng.randrange(400)}" for _ in range(60 + g)]
        words = list(base)
        words[-1 - rng.randrange(8) :] = ["end"]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(words))]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == brute_kept(docs) and 60 <= len(kept) < 120


def test_keep_one_with_a_hot_group(spark, monkeypatch):
    """Near copies in a chain, others that share a passage, on tiles of a few."""
    monkeypatch.setattr(S, "TILE", 8)
    rng = random.Random(4)
    passage, words = [f"p{i}" for i in range(40)], [f"w{i}" for i in range(100)]
    docs = []
    for i in range(60):
        words[rng.randrange(100)] = f"z{i}"
        docs.append((i, " ".join(words)))
        docs.append((100 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(4 + i % 13)])))
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == brute_kept(docs)


def test_keep_one_on_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows) and len(kept) < len(rows)


def test_short_texts_and_rows_without_ids_stay(spark):
    """Ten-word texts that differ in an end word (0.71) are no near-duplicates; null ids don't make rows one."""
    rng = random.Random(5)
    docs = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(10)]
        docs += [" ".join(words), " ".join([*words[:9], "other"])]
    df = spark.createDataFrame([(None if i < 20 else i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    assert sorted(r.text for r in S.keep_one(df).collect()) == sorted(docs)
