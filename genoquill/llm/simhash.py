"""SimHash near-duplicate detection with pigeonhole blocks.

The fingerprint of a text is 64 bits wide: each bit is the majority of that bit over the XXH64 hashes of its word
shingles. Two fingerprints that differ in at most `distance` bits agree entirely in at least `blocks - distance` of
`blocks` blocks, so all such pairs meet in a bucket of some choice of that many blocks. Fingerprints are first made
distinct, so copies cost nothing. A bucket of two is checked from its minimum and maximum alone; larger buckets are cut
into tiles of bounded size, whose links are reduced to a spanning forest before they leave the task: no bucket emits
all its pairs, and none meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, made, materialize, release
from .components import connected_components

WIDTH, SEED, BITS = 4, 42, 64
TILE = 1024


def _hashes(raw: bytes, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 hashes of the shingles of UTF-8 text in their order: A-Z lowered, width words; none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(text, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(gaps[: n - width] + 1).tolist()], [*gaps[width - 1 :].tolist(), len(text)]
    return np.array([digest(text[i:j], seed) for i, j in zip(starts, ends, strict=True)], np.uint64)


#: What stands for a byte at a place in its word (places repeat after 64, with another factor), blanks being zero.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(42).integers(0, 1 << 64, (64, 256), np.uint64)
_BYTES[:, 65:91] = _BYTES[:, 97:123]
_BYTES[:, _BLANK] = 0
_BYTES = _BYTES.ravel()
CHUNK = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin, and a 64-bit hash of each that depends on its letters alone (A-Z as a-z)."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    place = np.arange(len(raw))
    if len(start):
        first = np.zeros(len(raw), np.int64)
        first[start] = start
        place -= np.maximum.accumulate(first)
    values = _BYTES[((place & 63) << 8) | raw]
    if (end - start > 64).any():
        values *= np.where(place < 64, np.uint64(1), _mixed((place >> 6).astype(np.uint64)) | np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return start, _mixed(sums[end] - sums[start] + (end - start).astype(np.uint64))


def _blocks(raw: bytes) -> Iterator[bytes]:
    """raw in blocks of about CHUNK bytes, cut at blanks."""
    at = 0
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def shingle_hashes(raws: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its shingles of width words in their order; of all its words if it has fewer, none without words."""
    out, waiting, held = [], [], 0
    with np.errstate(over="ignore"):
        for raw in raws:
            if held + len(raw) > CHUNK and waiting:
                out += _shingled(waiting, width)
                waiting, held = [], 0
            waiting.append(raw)
            held += len(raw)
        if waiting:
            out += _shingled(waiting, width)
    return out


def _shingled(raws: list[bytes], width: int) -> list[np.ndarray]:
    if len(raws) == 1:
        found = [_word_hashes(x)[1] for x in _blocks(raws[0])]
        words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        size = np.array([len(words)])
    else:
        start, words = _word_hashes(b"\n".join(raws))
        ends = np.cumsum([len(x) + 1 for x in raws])
        size = np.diff(np.searchsorted(start, ends), prepend=0)
    first = np.cumsum(size) - size
    n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)  # shingles of each text
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.repeat(first + size, n)
    total = np.zeros(len(at), np.uint64)
    weights = np.random.default_rng(width).integers(0, 1 << 64, width, np.uint64) | np.uint64(1)
    for k in range(width if len(at) else 0):
        total += np.where(at + k < last, words[np.minimum(at + k, len(words) - 1)] * weights[k], np.uint64(0))
    return np.split(_mixed(total), np.cumsum(n)[:-1])


def _majority(hashes: np.ndarray) -> int:
    """Each bit the majority of that bit over hashes, as a signed number; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(raw: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of UTF-8 text: A-Z lowered, shingles of width words; 0 without words."""
    return _majority(_hashes(raw, width, seed))


def _raws(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """b in slices of about two million bytes in a column."""
    group = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) >> 21
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], b.num_rows]):
        yield b.slice(lo, hi - lo)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id_col, fp): one row per row of docs; null text counts as empty."""
    kept = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("raw"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return kept.mapInArrow(lean(run), schema)


def block_masks(blocks: int, shared: int) -> list[int]:
    """Signed masks of every choice of `shared` of `blocks` nearly equal blocks."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [m - (1 << 64) if (m := sum(c)) >> 63 else m for c in combinations(one, shared)]


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks (distance + 3 at least) whose buckets hold one of n random fingerprints on average."""
    blocks = distance + 3
    while blocks < 16 and 2 ** (BITS * (blocks - distance) // blocks) < n:
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the components of fps at up to distance bits."""
    fps = np.unique(fps)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count((fps[i:] ^ fps[i]).view(np.uint64)) <= distance) + i
        old = np.unique(root[near])
        if len(old) > 1:
            root[np.isin(root, old)] = old[0]
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints in column fp whose closure equals that of all pairs at up to distance bits."""
    distinct = materialize(fps.select("fp").where("fp is not null").distinct(), "fps")
    blocks = blocks or blocks_for(distinct.count(), distance)
    masks = block_masks(blocks, blocks - distance)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(parts, "fp").select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.choice", "k.bits")
    buckets = materialize(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    twos = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    members = keyed.join(buckets.where("n > 2").select("choice", "bits", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), ["choice", "bits"])
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = members.select("choice", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiles = tiled.groupBy("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_forest(x.values.to_numpy(zero_copy_only=False), distance) for x in batch.column(0)]
            a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return twos.union(tiles.select("fps").mapInArrow(lean(run), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = WIDTH, seed: int = SEED, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null texts count as empty (fingerprint zero, linked like any other). A null id never becomes a component_id unless
    all ids of the component are null. Repeated ids are rows of their own. Other columns, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    own = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    least = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(links(own, distance, blocks), "a", "b")
    placed = materialize(least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return own.join(by_fp, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates share SIMILARITY of their distinct shingles (Jaccard). Two texts count as candidates if they share
#: COMMON shingles of their prefixes, or if their fingerprints differ in NEAR bits at most.
SIMILARITY, COMMON, NEAR = 0.8, 4, 4
#: Bits of the bitmaps by which what no other side has is left out before it is shuffled: eight for each value, within bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Shingles that stand in OFTEN or more of a sample of documents come last in prefixes; MOST_OFTEN of them at the utmost.
OFTEN, MOST_OFTEN, SAMPLE, LEAST_SAMPLE = 3, 1_000_000, 1 / 16, 5000


def needed_of(n: int, similarity: float) -> int:
    """Shingles that a text of n must share with another of that similarity, whatever the other's size."""
    return math.ceil(similarity * n - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have that Jaccard similarity."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def prefix(own: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a text's distinct hashes in an order common to all texts, rare ones first.

    Of two texts that share o hashes, the first n - o + k of the one and m - o + k of the other share k or more. o is at
    least needed_of both; k is COMMON, or all that are needed if those are fewer.
    """
    least = needed_of(len(own), similarity)
    seen = np.zeros(len(own), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], own), len(often[0]) - 1)
        seen = np.where(often[0][at] == own, often[1][at], 0)
    return own[np.argsort(seen, kind="stable")][: len(own) - least + min(COMMON, least)]


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashed values of column key, for about n of them: MOST_BITS / 64 rows go to the driver at the utmost."""
    bits = 1 << min(max((8 * n).bit_length(), LEAST_BITS.bit_length() - 1), MOST_BITS.bit_length() - 1)
    h = F.pmod(F.shiftright(F.col("key"), 7), F.lit(bits))
    words = keys.groupBy(F.shiftright(h, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    seen = np.zeros(bits // 64, np.uint64)
    seen[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return seen


def _hit(seen: np.ndarray, key: np.ndarray) -> np.ndarray:
    h = (key >> 7) & (64 * len(seen) - 1)
    return (seen[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _set_digest(own: np.ndarray, seed: int) -> tuple[int, int]:
    """A text's node and check: both halves of a 128-bit digest of its distinct hashes, signed."""
    digest = xxhash.xxh3_128_digest(own.tobytes(), seed)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _read_nodes(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """own (row, id, node, check, size, fp), nodes (node, least, size, fp, n) and the seed by which no two sets share a node.

    Texts of equal sets are one node, whose least is the smallest (id, row). rows: id, row, raw.
    """
    schema = T.StructType([rows.schema["id"], *[T.StructField(n, T.LongType()) for n in ("row", "node", "check", "size", "fp")]])
    for seed in range(3):

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _slices(b, 2):
                    got = []
                    for h in shingle_hashes(_raws(part.column(2)), width):
                        own = np.unique(h)
                        got.append((*_set_digest(own, seed), len(own), _majority(h)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in zip(*got, strict=True)]], names=schema.names)

        own = materialize(rows.select("id", "row", "raw").mapInArrow(lean(run), schema), "own")
        nodes = own.groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        nodes = materialize(nodes, "nodes")
        if nodes.where("lo <> hi").isEmpty():
            return own, nodes, seed
    raise RuntimeError("different sets share a node under every seed")


def similar_components(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(row, keep) per row of rows: keep is true for the row of each group with the smallest (id, row). row_col holds distinct numbers.

    Groups are the components of all pairs whose distinct shingles have the Jaccard similarity or more: no such pair is
    missed and none below it is a link. Candidates come from the pigeonhole blocks of 64-bit fingerprints and from an exact
    prefix-filter join, and each is verified by its whole sets. First each bucket's members are held against one of them, by
    an order of its own, then what is still apart against another one, so that groups of copies become components at linear
    cost; then all pairs of prefix buckets that are still apart, tile by tile.

    Texts are read four times and never shuffled; a task hands on equal texts once.
    """
    spark = rows.sparkSession
    raw = rows.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), F.col(text_col).cast("binary").alias("raw"))
    own, nodes, seed = _read_nodes(raw, width)
    n_nodes = nodes.count()
    share = min(1.0, max(SAMPLE, LEAST_SAMPLE / max(n_nodes, 1)))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 0):
                h = [np.unique(x) for x in shingle_hashes(_raws(part.column(0)), width)]
                key, n = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    sampled = raw.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share * (1 << 20)).select("raw").mapInArrow(lean(shingles), "key long, n long")
    often = sampled.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(MOST_OFTEN).toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], often["n"].to_numpy()[order]))
    masks = np.array(block_masks(blocks := blocks_for(n_nodes, NEAR), blocks - NEAR), np.int64)

    def buckets_of(seen):
        """(key, node) of prefixes (even keys) and of fingerprint blocks (odd keys)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mixers, done = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), set()
            for b in batches:
                for part in _slices(b, 0):
                    found, node = [np.zeros(0, np.int64)], []
                    with np.errstate(over="ignore"):
                        for h in shingle_hashes(_raws(part.column(0)), width):
                            distinct = np.unique(h)
                            own = _set_digest(distinct, seed)[0]
                            if own in done:
                                continue
                            done.add(own)
                            near = _mixed((masks & np.int64(_majority(h))).view(np.uint64) ^ mixers)
                            found.append(np.concatenate([prefix(distinct, common.value, similarity) & ~np.uint64(1), near | np.uint64(1)]).view(np.int64))
                            node.append(own)
                    key, node = np.concatenate(found), np.repeat(np.array(node, np.int64), [len(x) for x in found[1:]])
                    if seen is not None:
                        hit = _hit(seen.value, key)
                        key, node = key[hit], node[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

        return run

    # A bucket's members in an order of its own: the first and the last of them are held against the others.
    place = F.col("node").bitwiseXOR(F.col("key"))
    keyed = raw.select("raw").mapInArrow(lean(buckets_of(None)), "key long, node long")
    buckets = keyed.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    buckets = materialize(buckets.select("key", F.col("lo").bitwiseXOR(F.col("key")).alias("a"), F.col("hi").bitwiseXOR(F.col("key")).alias("z")), "buckets")
    seen = spark.sparkContext.broadcast(_bitmap(buckets, buckets.count()))
    members = raw.select("raw").mapInArrow(lean(buckets_of(seen)), "key long, node long").join(buckets, "key")
    members = materialize(members.groupBy("key", "node").agg(F.first("a").alias("a"), F.first("z").alias("z")), "members")
    seen.unpersist()
    common.unpersist()
    block = F.col("key").bitwiseAND(F.lit(1).cast("long"))
    needed = lambda c: F.least(F.lit(COMMON), F.ceil(similarity * F.col(f"{c}_size") - 1e-9))
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("fp").alias(f"{c}_fp"))

    def candidates(pairs: DataFrame) -> DataFrame:
        """(a, b) of (a, b, shared, blocks) that can have the similarity."""
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        sizes = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9
        near = (F.col("blocks") > 0) & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= NEAR)
        return both.where(sizes & (near | (F.col("shared") >= F.least(needed("a"), needed("b"))))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of pairs that have the similarity by their whole shingle sets."""
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least.row"), "node").select(F.xxhash64("row").alias("key"), "row"), "ends")
        wanted = spark.sparkContext.broadcast(_bitmap(ends, ends.count()))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.flatnonzero(_hit(wanted.value, b.column(2).to_numpy()))
                for part in _slices(b.take(pa.array(at)), 1):
                    found = [np.unique(h) for h in shingle_hashes(_raws(part.column(1)), width)]
                    node, own = [_set_digest(x, seed)[0] for x in found], [x.tobytes() for x in found]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array(own, pa.binary())], names=["row", "node", "own"])

        found = raw.select("row", "raw", F.xxhash64("row").alias("key")).mapInArrow(lean(sets), "row long, node long, own binary")
        found = materialize(found.join(ends.select("row"), "row", "left_semi").select("node", "own"), "sets")
        wanted.unpersist()
        both = pairs.select("a", "b").join(found.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
            for b in batches:
                yield b.select(["a", "b"]).filter(pa.array([similar(hashes(x), hashes(y), similarity) for x, y in zip(b.column("x"), b.column("y"), strict=True)], pa.bool_()))

        return materialize(both.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long"), "links")

    def ordered(pairs: DataFrame, *more) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)

    def stars(met: DataFrame, pivot: str) -> DataFrame:
        """Candidates of members (key, node) with the bucket's pivot."""
        pairs = met.where(F.col("node") != F.col(pivot)).select(F.col(pivot).alias("a"), F.col("node").alias("b"), block.alias("block"))
        return candidates(ordered(pairs, "block").groupBy("a", "b").agg(F.sum(1 - F.col("block")).alias("shared"), F.sum("block").alias("blocks")))

    def rooted(links: DataFrame) -> DataFrame:
        """Members of prefix buckets that hold more than one component, with their roots."""
        roots = connected_components(links, "a", "b").select(F.col("node").alias("_n"), "root")
        t = members.where(block == 0).join(roots, F.col("node") == F.col("_n"), "left").select("key", "node", "a", "z", F.coalesce("root", "node").alias("root"))
        t = materialize(t, "rooted")
        apart = t.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1").select("key", "n")
        return t.join(apart, "key")

    tested = materialize(stars(members, "a"), "stars")
    links = verified(tested)
    again = rooted(links)
    far = again.where("node = z").select("key", F.col("root").alias("z_root"))
    second = materialize(stars(again.join(far, "key").where("root <> z_root"), "z").join(tested, ["a", "b"], "left_anti"), "stars")
    tested, links = tested.union(second), links.union(verified(second))
    t = rooted(links).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).join(nodes.select("node", "size"), "node")
    home = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = t.select("key", F.struct("node", "root", "size", home.alias("home")).alias("m"), home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiles = tiled.groupBy("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j")).agg(F.collect_set("m").alias("m"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) of the tiles' pairs of different roots and like sizes; pairs of one home come from that home's own tile."""
        for b in batches:
            for i, j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                node, root, size, home = (c.to_numpy() for c in x.values.flatten())
                for k in range(len(node)):
                    fit = (root != root[k]) & (node > node[k]) & (np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k]) - 1e-9)
                    if i != j:
                        fit &= home != home[k]
                    if fit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(fit.sum()), node[k])), pa.array(node[fit])], names=["a", "b"])

    rest = tiles.select("i", "j", "m").mapInArrow(lean(across), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("shared"), F.lit(0).alias("blocks"))
    untested = materialize(candidates(rest).join(tested, ["a", "b"], "left_anti"), "rest")
    every = connected_components(links.union(verified(untested)), "a", "b").select(F.col("node").alias("_n"), "root")
    placed = nodes.join(every, nodes["node"] == every["_n"], "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_row"))
    return own.join(stay, own["row"] == stay["_row"], "left").select("row", F.col("_row").isNotNull().alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates (see similar_components) the one with the smallest id.

    Null texts count as empty; all texts without words are one group. Rows are told apart by a number of their own, so
    null and repeated ids don't matter. The tables that the search for groups wrote are removed at its end.
    """
    before = made()
    rows = materialize(docs.withColumn("_own_row", F.monotonically_increasing_id()), "rows")
    near = materialize(similar_components(rows, id_col, text_col, "_own_row", width, similarity).where("NOT keep").select(F.col("row").alias("_own_row")), "near")
    release(docs.sparkSession, rows, near, since=before)
    return rows.join(near, "_own_row", "left_anti").select(*docs.columns)
