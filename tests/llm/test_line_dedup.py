import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from genoquill.llm import line_dedup

VARIABLE = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*[0-9@]|https?://|www\.)[^\x20\x09-\x0D]*")


def masked(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", VARIABLE.sub("<*>", line)))


def brute(docs, least_words=5):
    """What drop_copies says, line by line. docs: (id, text); rows equal in both are one document."""
    none_last = lambda d: (d[0] is None, d[0] or 0)
    own = sorted({d for d in docs if d[1] is not None}, key=none_last)
    first, holders = {}, defaultdict(set)
    for d in own:
        for w in map(masked, d[1].split("\n")):
            if len(w) >= least_words:
                holders[w].add(d)
                first.setdefault(w, d)
    halves = lambda w: ((0, len(w), w[: 3 + -(-(len(w) - 3) // 2)]), (1, len(w), w[:3], w[3 + -(-(len(w) - 3) // 2) :]))
    groups = defaultdict(list)
    for w in first:
        if len(w) >= 8:
            for k in halves(w):
                groups[k].append(w)
    close = defaultdict(list)
    for ws in groups.values():
        best = min(none_last(first[w]) for w in ws)
        to = [w for w in ws if none_last(first[w]) == best]
        assert len(ws) == 1 or len(to) == 1, "fixtures have no ties"
        for w in ws:
            if w != to[0] and sum(x != y for x, y in zip(w, to[0])) <= min(3, max(1, len(w) // 10)):
                close[w].append(to[0])
    kept = {w: first[w] for w in first if len(holders[w]) > 1}
    for w, to in close.items():
        if rest := [first[t] for t in to if t not in close]:
            kept[w] = min(rest, key=none_last)
    out = []
    for d in docs:
        if d[1] is None:
            out.append((*d, 0, 0))
            continue
        lines = d[1].split("\n")
        stay = [x for x in lines if kept.get(masked(x), d) == d]
        out.append((d[0], "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nunique words stand in this first line here"),
    (2, "alpha beta gamma delta epsilon zeta OTHER theta iota kappa\nposted 12 times by user 77 today"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa\n\nposted 13 times by user 5 today"),
    (4, "posted 9 times by user x1 today\nshort one\n alpha\tbeta  gamma delta epsilon zeta THIRD theta iota kappa "),
    (5, None),
    (6, ""),
    (7, "short one\nshort one"),
    (8, "short one\nmail me@here.org or see https://a.b now please"),
    (9, "x " * 3000 + "end"),
    (10, "alpha beta gamma DELTA epsilon zeta eta theta iota KAPPA"),
]


def run(spark, rows):
    got = line_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force(spark):
    got = run(spark, DOCS)
    assert got == brute(DOCS)
    assert sum(r[3] for r in got) > 3


def test_null_and_repeated_ids_of_different_texts(spark):
    shared, other = "a line that two of the rows do hold", "another one that more rows of them have"
    rows = [
        (9, f"{shared}\nsomething that only the first says"), (9, f"a wholly unique line that nobody else has at all\n{shared}"), (9, f"{shared}\nsomething that only the first says"),
        (None, f"{other}\nwhat the first row without an id says"), (None, f"what the second row without an id says\n{other}"), (None, None), (None, ""),
    ]
    got = run(spark, rows)
    left = Counter(x for r in got for x in (r[1] or "").split("\n"))
    unique = ("a wholly unique line that nobody else has at all", "what the first row without an id says", "what the second row without an id says")
    assert all(left[x] == 1 for x in unique) and left["something that only the first says"] == 2
    assert left[shared] in (1, 2) and left[other] == 1 and len(got) == len(rows)


def test_on_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    want = brute(rows)
    assert got == want and sum(r[3] for r in got) > 0


def test_edges(spark):
    assert line_dedup.drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "x", 1), (None, "a b c d e f", "y", 2), (3, "a b c d e f", "z", 3), (4, "a b c d e f", "z", 3)], "doc_id long, text string, id string, n_lines int")
    got = line_dedup.drop_copies(df.withColumn("h", F.lit(1)).withColumn("pos", F.lit(2)))
    assert got.columns == ["doc_id", "text", "id", "h", "pos", "n_lines", "n_dropped"]
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got.collect()) == [(0, 1), (0, 1), (3, 0), (4, 1)]
    long = " ".join(f"w{i}x" for i in range(60_000))
    rows = [(1, f"{long}\n{long} end"), (2, f"{long}\n{long} end")]
    assert [r[3] for r in run(spark, rows)] == [0, 2]


def test_copies_in_two_documents_go(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"{passage}\nfirst of the two documents here"), (2, f"second of the two documents there\n{passage}")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("second of the two documents there", 1)}


def test_wording_of_its_own_stays(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(203)]
    far = [" ".join(words[:60] + [f"{c}{w}" for w in words[60:100]] + words[100:]) for c in "pqr"]
    near = [" ".join(words[:60] + [f"{c}x", f"{c}y"] + words[62:]) for c in "st"]
    rows = list(enumerate([" ".join(words), *far, *near, far[1]]))
    got = [r.n_dropped for r in line_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1]
    assert line_dedup.drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_is_dropped_is_kept_elsewhere(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    left = {r.doc_id: r.text for r in line_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept, holders = defaultdict(list), defaultdict(set)
    for i, t in left.items():
        for x in (t or "").split("\n"):
            w = masked(x)
            kept[len(w)].append(w)
            if len(w) >= 5:
                holders[tuple(w)].add(i)
    assert all(len(ids) == 1 for ids in holders.values())
    for _, t in rows:
        for w in map(masked, (t or "").split("\n")):
            assert len(w) < 5 or min(sum(x != y for x, y in zip(w, k)) for k in kept[len(w)]) <= min(3, max(1, len(w) // 10))


def greedy(docs):
    """By document the number of lines that go: copies, and lines close to an earlier line of a template that stays."""
    first, holders = {}, defaultdict(set)
    for d in sorted(docs):
        for w in map(masked, d[1].split("\n")):
            if len(w) >= 5:
                first.setdefault(w, d[0])
                holders[w].add(d[0])
    kept, stay = {}, []
    for w, d in first.items():
        half = 3 + -(-(len(w) - 3) // 2)
        share = lambda o: len(o) == len(w) >= 8 and (o[:half] == w[:half] or o[:3] + o[half:] == w[:3] + w[half:])  # noqa: B023, E731
        to = [first[o] for o in stay if share(o) and sum(x != y for x, y in zip(w, o)) <= min(3, max(1, len(w) // 10))]
        kept[w] = to[0] if to else d
        if not to:
            stay.append(w)
    return {i: sum(kept.get(masked(x), i) != i for x in t.split("\n")) for i, t in docs}


def test_variants_of_any_line_of_a_template_go(spark, monkeypatch):
    base = "alpha beta gamma delta epsilon zeta eta"
    rows = list(enumerate([f"{base} one two three", f"{base} five six seven", f"{base} five six OTHER", f"{base} five THIRD seven", f"{base} five SO OTHER", f"{base} far six away"]))
    assert {r[0]: r[3] for r in run(spark, rows)} == greedy(rows) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    rng = random.Random(5)
    word = lambda: rng.choice(["ka", "lo", "mi", "nu", "pe"])
    many = [" ".join(["alpha", "beta", word(), *[w if rng.random() < 0.85 else word() for w in ["so", "ti", "va", "we"] * rng.choice([2, 2, 5, 9])]]) for _ in range(400)]
    rows = list(enumerate(many))
    want = greedy(rows)
    assert sum(want.values()) > 20
    for most in (64, 0):
        monkeypatch.setattr(line_dedup, "MOST_PAIRS", most)
        assert {r[0]: r[3] for r in run(spark, rows)} == want
        monkeypatch.undo()
