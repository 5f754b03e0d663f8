"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The vocabulary and its scores are those of a given model; a segmentation's score is the sum of its pieces' scores, and a
character that no piece covers is written as its UTF-8 bytes at a fixed penalty. A forward Viterbi pass gives the best
score of every prefix. These scores are exact heuristics for an A-star search that runs backward from the end: it pops
segmentations best first and only ever expands parts of those it returns.

The lattice of a text falls apart wherever no piece holds the two characters on either side, which always is so in front
of a run of spaces. The parts are found, made distinct and searched batch by batch in numpy and Arrow, and the N best of a text follow exactly from the N best of its parts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that are handled at once; longer parts are searched one by one.
BLOCK, LONG = 1 << 20, 64
Ids = tuple[int, ...]


def load_vocabulary(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds) of a model file; kinds: 0 normal, 1 byte, 2 control or unknown."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(p.get_piece_size())
    kinds = [1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in n]
    return [p.id_to_piece(i) for i in n], [p.get_score(i) for i in n], kinds


@dataclass
class Encoded:
    """What is known of a text: ids and score of its best segmentation, and the parts that the next best ones may change.

    A part is (gap, place among the parts, place of its ids, the part).
    """

    ids: list[np.ndarray] = field(default_factory=list)
    score: float = 0.0
    lossless: bool = True
    n_ids: int = 0
    n_parts: int = 0
    weakest: list[tuple[float, int, int, str]] = field(default_factory=list)


class Codec:
    """Encoder and decoder for one vocabulary. Inside it a space stands for the model's space mark."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]) -> None:
        normal = [(p.replace(MARK, " "), i, s) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True)) if k == 0 and p]
        if any(" " in p.lstrip(" ") for p, *_ in normal):
            raise ValueError("a piece holds a space mark behind other characters")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 1 else p.replace(MARK, " ").encode() if k == 0 else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.unknown = min((s for s in scores if s > -1e8), default=0.0) - 10.0
        self.longest = max((len(p) for p, *_ in normal), default=1)
        self.piece = {p: (i, s) for p, i, s in normal}
        #: The pieces by their characters from the last to the first; at the empty key a piece's (score, ids).
        self.ends: dict = {}
        for p, i, score in normal:
            node = self.ends
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = (score, (i,))
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_all = np.frombuffer(b"".join(self.raw) or b"\0", np.uint8)
        alphabet = sorted({ch for p, *_ in normal for ch in p})
        #: The class of each code point, 0 for those of no piece, and whether a piece holds two classes side by side.
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(ch) for ch in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.n_classes = len(alphabet) + 1
        self.side_by_side = np.zeros(self.n_classes**2, bool)
        place = {ch: k for k, ch in enumerate(alphabet, 1)}
        self.side_by_side[[place[a] * self.n_classes + place[b] for p, *_ in normal for a, b in zip(p, p[1:])]] = True
        self._tree(normal, place)

    def _tree(self, normal: list[tuple[str, int, float]], place: dict[str, int]) -> None:
        """The same tree for numpy: nodes are numbered, and a hash table holds (node, class) and the node below."""
        nodes, steps = {"": 0}, []
        for p, *_ in normal:
            for k in range(1, len(p) + 1):
                if p[-k:] not in nodes:
                    nodes[p[-k:]] = len(nodes)
                    steps.append((nodes[p[len(p) - k + 1 :]] * self.n_classes + place[p[-k]], nodes[p[-k:]]))
        self.node_score, self.node_id = np.full(len(nodes), -math.inf), np.full(len(nodes), -1, np.int32)
        for p, i, score in normal:
            self.node_score[nodes[p]], self.node_id[nodes[p]] = score, i
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.below = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, node = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]], self.below[at[free]] = key[free], node[free]
            left = self.keys[at] != key
            key, node, at = key[left], node[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _below(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes below nodes by classes; 0 where there is none."""
        key = node.astype(np.int64) * self.n_classes + kind
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.below[at], 0)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.below[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def raw_ids(self, char: str) -> Ids:
        return tuple(self.byte[x] for x in char.encode())

    def edges(self, part: str, end: int) -> list[tuple[int, float, Ids]]:
        """(start, score, ids) of the lattice's edges that end at a place, the shortest first; bytes where no piece is the character."""
        out, node = [], self.ends
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            node = node.get(part[start])
            if node is None:
                break
            if found := node.get(""):
                out.append((start, *found))
        if not out or out[0][0] != end - 1:
            out.insert(0, (end - 1, self.unknown, self.raw_ids(part[end - 1])))
        return out

    def forward(self, part: str) -> tuple[list[float], list[tuple[int, float, Ids]]]:
        """Viterbi: the best score of each prefix; and by place the start and ids of the edge that gives it, and how much less the next edge gives.

        Of edges that give equal scores the longest is taken.
        """
        low, longest, ends = -math.inf, self.longest, self.ends
        scores, steps = [0.0], [(0, math.inf, ())]
        for end in range(1, len(part) + 1):
            best, second, at, last, node = low, low, -1, (), ends
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                node = node.get(part[start])
                if node is None:
                    break
                if "" in node:
                    score, ids = node[""]
                    x = scores[start] + score
                    if x >= best:
                        best, second, at, last = x, best, start, ids
                    elif x > second:
                        second = x
            if part[end - 1] not in ends or "" not in ends[part[end - 1]]:
                x = scores[end - 1] + self.unknown
                if x > best:
                    best, second, at, last = x, best, end - 1, self.raw_ids(part[end - 1])
                elif x > second:
                    second = x
            scores.append(best)
            steps.append((at, best - second, last))
        return scores, steps

    def best(self, part: str) -> tuple[float, float, Ids]:
        """(score, gap, ids) of a part: its best segmentation, and how much worse the next best is (infinite if there is none).

        This is the beginning of search: as its heuristics are exact, the best entry always extends the one just popped, so
        that the way to the first segmentation needs no heap; the best of all that was left aside is the next to come.
        """
        scores, steps = self.forward(part)
        place, gap, path = len(part), math.inf, []
        while place:
            place, less, ids = steps[place]
            path.append(ids)
            gap = min(gap, less)
        return scores[-1], gap, tuple([i for ids in reversed(path) for i in ids])

    def best_of(self, parts: pa.Array, kinds: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best for many parts at once: scores, gaps, numbers of ids, and all ids in a row. kinds: the parts' classes in a row.

        The forward pass and the way back go place by place through all parts together. Parts of over LONG characters and
        those with a character that only stands inside longer pieces are left to best, which has the same rules.
        """
        n, fit = len(size), size <= LONG
        order = np.argsort(-np.where(fit, size, 0), kind="stable")  # the longest first, those for best last
        sizes = np.where(fit, size, 0)[order]
        top = int(sizes[0]) if n else 0
        tall = np.searchsorted(-sizes, -np.arange(1, top + 1), side="right")  # how many parts have a first, second, ... character
        col = np.concatenate([[0], np.cumsum(tall)])  # characters lie column by column: all first ones, all second ones, ...
        total = int(col[-1])
        column = np.repeat(np.arange(top), tall)
        row = np.arange(total) - col[column]
        kinds = kinds[(np.cumsum(size) - size)[order[row]] + column]
        alive, node, edge = np.arange(total), np.zeros(total, np.int32), []
        for length in range(1, min(self.longest, top) + 1):  # (scores, ids) of the edges of a length, by the last character's place
            skip = col[length - 1]
            node = self._below(node, kinds[col[column[alive] - length + 1] + row[alive]])
            here = node > 0
            alive, node = alive[here], node[here]
            score, ids = np.full(total - skip, -math.inf), np.full(total - skip, -1, np.int32)
            score[alive - skip], ids[alive - skip] = self.node_score[node], self.node_id[node]
            edge.append((score, ids))
            more = alive >= col[length]
            alive, node = alive[more], node[more]
        if edge:
            edge[0][0][edge[0][1] < 0] = self.unknown
        scores, gap, step = [np.zeros(n)], np.empty(total), np.empty(total, np.int8)
        for place in range(1, top + 1):
            k, lo, hi = tall[place - 1], col[place - 1], col[place]
            best, second, length = scores[place - 1][:k] + edge[0][0][lo:hi], np.full(k, -math.inf), np.ones(k, np.int8)
            for j in range(2, min(place, len(edge)) + 1):
                x = scores[place - j][:k] + edge[j - 1][0][lo - col[j - 1] : hi - col[j - 1]]
                better = (x >= best) & (x > -math.inf)
                np.maximum(second, np.where(better, best, x), out=second)
                best[better], length[better] = x[better], j
            scores.append(best)
            gap[lo:hi], step[lo:hi] = best - second, length
        values = np.zeros(n)
        for place in range(1, top + 1):  # a longer part writes over what a shorter prefix of it has
            values[: tall[place - 1]] = scores[place]
        least, count, odd = np.full(n, math.inf), np.zeros(n, np.int64), ~fit[order]
        rows, place, path = np.flatnonzero(sizes), sizes[sizes > 0].astype(np.int64), []
        while len(rows):
            at = col[place - 1] + rows
            least[rows] = np.minimum(least[rows], gap[at])
            width, ids = step[at], np.full(len(rows), -1, np.int32)
            for j in range(1, len(edge) + 1):
                of = np.flatnonzero(width == j)
                ids[of] = edge[j - 1][1][at[of] - col[j - 1]]
            odd[rows[ids < 0]] = True
            path.append((rows, count[rows], ids))
            count[rows] += 1
            place = place - width
            rows, place = rows[place > 0], place[place > 0]
        others = {int(k): self.best(parts[int(order[k])].as_py()) for k in np.flatnonzero(odd)}
        for k, (score, less, ids) in others.items():
            values[k], least[k], count[k] = score, less, len(ids)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        by_row = np.cumsum(count[rank])[order]  # where a part's ids end
        flat = np.zeros(int(count.sum()), np.int32)
        for rows, back, ids in path:
            sound = ~odd[rows]
            flat[by_row[rows[sound]] - 1 - back[sound]] = ids[sound]
        for k, (_, _, ids) in others.items():
            flat[by_row[k] - len(ids) : by_row[k]] = ids
        return values[rank], least[rank], count[rank], flat

    def search(self, part: str, n: int) -> list[tuple[float, Ids]]:
        """The n best (score, ids) of one part, best first, by A-star from the end; the best scores of all prefixes are its heuristics.

        An entry of the heap links to the one that it extends, so a path costs no copies however long the part is. Of equal
        scores the one reached last comes first, and of the edges at a place the longest is reached last.
        """
        scores, _ = self.forward(part)
        known: dict[int, list[tuple[int, float, Ids]]] = {}
        heap, out, count = [(-scores[-1], 0, None, len(part), 0.0)], [], 0
        while heap and len(out) < n:
            _, _, path, place, behind = heapq.heappop(heap)
            if not place:
                ids = []
                while path:
                    path, some = path
                    ids += some
                out.append((behind, tuple(ids)))
                continue
            if (edges := known.get(place)) is None:
                edges = known[place] = self.edges(part, place)
            for start, score, ids in edges:
                count -= 1
                heapq.heappush(heap, (-(behind + score + scores[start]), count, (path, ids), start, behind + score))
        return out

    def parts(self, blocks: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The parts of all blocks, as an Arrow array; the classes of all characters; where parts and where the parts of each block begin."""
        size = np.array([len(x) for x in blocks])
        text = "".join(blocks)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[code].astype(np.int32)
        cut = np.empty(len(code) + 1, bool)
        cut[1:-1] = ~self.side_by_side[kind[:-1] * self.n_classes + kind[1:]]
        border = np.concatenate([[0], np.cumsum(size)])
        cut[border] = True
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int32)]).astype(np.int32)[cut]
        found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(text.encode()))
        return found, kind, np.flatnonzero(cut), np.concatenate([[0], np.cumsum(cut)])[border]

    def add(self, blocks: list[tuple[int, str]], to: list[Encoded], n: int) -> None:
        """Search the parts of (text's number, block) and add what is found to the texts. A text's blocks come in order."""
        found, kind, begins, begin = self.parts([x for _, x in blocks])
        coded = found.dictionary_encode()
        names, which = coded.dictionary, coded.indices.to_numpy()
        one_of = np.zeros(len(names), np.int64)
        one_of[which] = np.arange(len(which))
        length = np.diff(begins)[one_of]
        score, gap, size, flat = self.best_of(names, kind[np.repeat(begins[one_of] - np.cumsum(length) + length, length) + np.arange(length.sum())], length)
        first = np.cumsum(size) - size
        sizes = size[which]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        lossless = self.joined(ids) == found.buffers()[2].to_pybytes()
        sums, gaps = np.add.reduceat(score[which], begin[:-1]), gap[which]
        ends = np.concatenate([[0], ends])
        for k, (number, text) in enumerate(blocks):
            lo, hi = begin[k], begin[k + 1]
            one = to[number]
            own = ids[ends[lo] : ends[hi]]
            if n > 1:
                g = gaps[lo:hi]
                if len(g) >= n:
                    near = np.flatnonzero(g <= np.partition(g, n - 2)[n - 2])
                    near = near[np.argsort(g[near], kind="stable")[: n - 1]]
                else:
                    near = np.arange(len(g))
                more = [(float(g[j]), one.n_parts + int(j), one.n_ids + int(ends[lo + j] - ends[lo]), names[int(which[lo + j])].as_py()) for j in near if g[j] < math.inf]
                one.weakest = sorted([*one.weakest, *more])[: n - 1]
            one.lossless &= lossless or self.joined(own) == text.encode()
            one.score += float(sums[k])
            one.n_ids += len(own)
            one.n_parts += int(hi - lo)
            one.ids.append(own)

    def encode_many(self, texts: list[str], n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
        """For each text the n best (score, ids), best first; fewer if it has fewer. An empty text has one, without ids."""
        return [[(s, ids) for s, ids in self.nbest(one, n)] for one in self.analyse(texts, n)]

    def analyse(self, texts: list[str], n: int) -> list[Encoded]:
        """The best segmentation of each text and what the next best may change; texts are cut into blocks in front of spaces."""
        out, waiting, held = [Encoded() for _ in texts], [], 0
        for number, text in enumerate(texts):
            text = f" {text}" if text else ""
            at = 0
            while at < len(text):
                end = at + BLOCK
                if end < len(text):
                    while end < len(text) and not (text[end] == " " != text[end - 1]):
                        end += 1
                block = text[at:end]
                at += len(block)
                if held and held + len(block) > BLOCK:
                    self.add(waiting, out, n)
                    waiting, held = [], 0
                waiting.append((number, block))
                held += len(block)
        if waiting:
            self.add(waiting, out, n)
        return out

    def nbest(self, one: Encoded, n: int) -> Iterator[tuple[float, np.ndarray]]:
        """The n best (score, ids) of an analysed text, best first.

        To change a part costs its gap at least. The n - 1 parts of the smallest gaps, the first ones among equals, give
        n - 1 segmentations beside the best one; no other part has to be changed in any of the n best. Of equal scores the
        one that changes less of them, then earlier ones of them, comes first. Each must decode as the text.
        """
        base = np.concatenate(one.ids) if one.ids else np.zeros(0, np.int32)
        beam: list[tuple[float, tuple]] = [(0.0, ())]
        for gap, _, at, part in one.weakest:
            if len(beam) == n and gap > beam[-1][0]:
                break
            (score, ids), *others = self.search(part, n)
            more = []
            for other, changed in others:
                if self.bytes_of(changed) != self.bytes_of(ids):
                    raise ValueError("an alternative decodes to another text")
                more += [(lost + score - other, (*swaps, (at, len(ids), changed))) for lost, swaps in beam]
            beam = heapq.nsmallest(n, [*beam, *more], key=lambda x: x[0])
        for lost, swaps in beam:
            ids = base
            for at, size, changed in sorted(swaps, reverse=True):
                ids = np.concatenate([ids[:at], np.array(changed, np.int32), ids[at + size :]])
            yield one.score - lost, ids

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """encode_many for one text."""
        return [(s, ids.tolist()) for s, ids in self.encode_many([text], n)[0]]

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        size = self.raw_size[ids]
        end = np.cumsum(size)
        return self.raw_all[np.repeat(self.raw_start[ids] - end + size, size) + np.arange(end[-1])].tobytes() if len(ids) else b""

    def bytes_of(self, ids: Ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        return self.bytes_of(ids).removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, vocabulary) -> Codec:
    """A worker builds a codec once and keeps it between tasks."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*vocabulary.value)
    return _CODECS[key]


def broadcast_vocabulary(spark: SparkSession, path: str = MODEL):
    """The vocabulary is read on the driver and broadcast; its size is bounded by the model file."""
    return f"{path}", spark.sparkContext.broadcast(load_vocabulary(path))


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """b in slices of about BLOCK bytes of text."""
    group = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], b.num_rows]):
        yield b.slice(lo, hi - lo)


def encode_rows(docs: DataFrame, text_col: str = "text", n: int = 4, path: str = MODEL, every: bool = False) -> DataFrame:
    """docs without text_col, and of the n best segmentations of the text, best first:

    ids (of the best), score (of the best), scores, lossless (all decode to the text), decoded_sha256 (of the best, decoded),
    ids_sha256 (of the best's ids as little-endian 32-bit numbers), ids_sha256s (of each one's) and, with every, all_ids.

    One row per row of docs. Null counts as empty: one segmentation, no ids, score 0. Columns of docs with the names of these
    are replaced, others stay; null and repeated ids and empty tables don't matter. A text is handled in blocks.
    """
    key, vocabulary = broadcast_vocabulary(docs.sparkSession, path)
    whole = T.ArrayType(T.IntegerType())
    added = [
        T.StructField("ids", whole), T.StructField("score", T.DoubleType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("lossless", T.BooleanType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("ids_sha256", T.StringType()), T.StructField("ids_sha256s", T.ArrayType(T.StringType())), *([T.StructField("all_ids", T.ArrayType(whole))] if every else []),
    ]
    kept = [f for f in docs.schema if f.name != text_col and f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, vocabulary)
        for b in batches:
            for part in _slices(b, len(kept)):
                texts = [x or "" for x in part.column(len(kept)).to_pylist()]
                rows = []
                for text, one in zip(texts, codec.analyse(texts, n), strict=True):
                    found = list(codec.nbest(one, n))
                    back = text if one.lossless else codec.decode(found[0][1].tolist())
                    digests = [_digest(ids) for _, ids in found]
                    row = [found[0][1], found[0][0], [s for s, _ in found], one.lossless, hashlib.sha256(back.encode()).hexdigest(), digests[0], digests]
                    rows.append([*row, [ids.tolist() for _, ids in found]] if every else row)
                columns = list(zip(*rows, strict=True))
                sizes = np.cumsum([0, *map(len, columns[0])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(columns[0])))
                rest = [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids, *[pa.array(c, k) for c, k in zip(columns[1:], rest)]], names=schema.names)

    return docs.select(*[f.name for f in kept], F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """(id_col, text) from (id_col, ids); null ids decode to the empty text."""
    key, vocabulary = broadcast_vocabulary(encoded.sparkSession, path)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=schema.names)

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(lean(run), schema)
