"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

The lattice of a text has a node at each character boundary and an edge for each vocabulary piece between
two nodes. A piece of score s weighs 1 / (1 - s) ** SHARPNESS, its rank's share under a power law; characters
without a piece are spelt in byte pieces. Forward filtering sums the weights of all paths to each node;
backward sampling then walks from the end, choosing each incoming edge by its share of the node's sum. That
draws a segmentation with exactly its probability under the lattice.

No piece of this vocabulary has a blank after another character, or certain marks after a letter (both are
read off the vocabulary), so that no edge crosses such places and the lattice falls apart there:
the node tables of a stretch are built once and shared by all its occurrences, and the walks of a whole batch
of texts take their steps together. A long stretch has no table: one number for each of its nodes is kept, and
the edges are found anew window by window on the way back. The choices depend on the row's key, the stretch's place in the text and
the step alone, so that a row's segmentation is the same in any partitioning, order or batch.

Decoding joins the pieces and turns byte pieces back into bytes. The blank sign itself, where a text holds
it, is spelt in byte pieces, and so decoding gives back every text.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import tokenizer_path
from millrace.runtime import small_batches

VOCABULARY = "piece_bpe_32k.model"
SHARPNESS, SEED = 2.0, 42
#: A factor for each character of a piece: all paths get the same, and sums stay within a double's range.
PER_CHAR = 50.0
BLANK = "▁"
#: Stretches whose tables are kept, per Python worker, and the longest that is kept.
TABLE_STRETCHES, KEPT_CHARS = 100_000, 40
#: UTF-8 bytes of texts that are sampled together; a longer text is sampled alone, so many stretches at a time.
BATCH_BYTES, STRETCHES = 1 << 19, 1 << 17
#: Nodes of a long stretch whose edges are held at once.
WINDOW = 4096
_ROLL = np.array([0x9E3779B97F4A7C15], np.uint64)


class Lattice:
    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[k] = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes_of[k] = piece.replace(BLANK, " ").encode()
                self.pieces[piece.replace(BLANK, " ")] = (k, (1 - min(0.0, model.get_score(k))) ** -sharpness)
        self.ascii_id = np.array(self.byte_id[:128])
        self.longest = max(map(len, self.pieces))
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece holds a blank inside; stretches can't be cut at blanks")
        after_letter = {b for p in self.pieces for a, b in itertools.pairwise(p) if a.isalpha()}
        marks = "".join(re.escape(c) for c in map(chr, range(128)) if not c.isalpha() and c != " " and c not in after_letter)
        pattern = re.compile(rf" *[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+(?=[{marks}])| *[^ ]+| +" if marks else r" *[^ ]+| +")
        self.cut, self.cuts = pattern.findall, pattern.finditer
        self.rare = (2.0 - min(model.get_score(k) for k in range(n))) ** -sharpness
        self._index()
        self.reset()

    def _index(self) -> None:
        """Pieces by a rolling hash of their characters, in an open table; a multiplier without collisions is sought."""
        names = list(self.pieces)
        while True:
            if len({self._hash(p) for p in names}) == len(names):
                break
            _ROLL[0] += np.uint64(2)
        size = 1 << (len(names) * 8).bit_length()
        self.slot_hash, self.slot_piece = np.zeros(size, np.uint64), np.full(size, -1)
        for k, name in enumerate(names):
            at = (self._hash(name) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 40 & size - 1
            while self.slot_piece[at] >= 0:
                at = at + 1 & size - 1
            self.slot_hash[at], self.slot_piece[at] = self._hash(name), k
        self.piece_id = np.array([self.pieces[p][0] for p in names])
        self.piece_weight = np.array([self.pieces[p][1] * PER_CHAR ** len(p) for p in names])

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for ch in piece:
            value = (value * int(_ROLL[0]) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, or -1."""
        mask = np.uint64(len(self.slot_hash) - 1)
        at = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) & mask
        found = np.full(len(hashes), -1)
        open_ = np.arange(len(hashes))
        while len(open_):
            piece = self.slot_piece[at[open_]]
            hit = (piece >= 0) & (self.slot_hash[at[open_]] == hashes[open_])
            found[open_[hit]] = piece[hit]
            open_ = open_[(piece >= 0) & ~hit]
            at[open_] = (at[open_] + np.uint64(1)) & mask
        return found

    def add_all(self, stretches: list[str]) -> None:
        """Build the nodes of many stretches at once, none longer than KEPT_CHARS."""
        stretches = sorted(stretches, key=len)
        for at in range(0, len(stretches), 2048):
            self._add_block(stretches[at : at + 2048])

    def _add_block(self, stretches: list[str]) -> None:
        s, width = len(stretches), len(stretches[-1])
        size = np.array([len(x) for x in stretches])
        chars = np.zeros((s, width), np.uint64)
        inside = np.arange(width) < size[:, None]
        chars[inside] = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        most = min(self.longest, width)
        weight, piece = np.zeros((s, width, most)), np.full((s, width, most), -1)
        rolled = np.zeros((s, width), np.uint64)  # hash of the substring of each length that starts here
        for k in range(most):
            rolled = rolled[:, : width - k] * _ROLL[0] + chars[:, k:] + np.uint64(1)
            here = inside[:, k:]
            found = np.full(here.shape, -1)
            found[here] = self._find(rolled[here])
            piece[:, k:, k] = found
            weight[:, k:, k] = np.where(found >= 0, self.piece_weight[found], 0)
            if k == 0:
                weight[:, :, 0] = np.where((found < 0) & inside, self.rare * PER_CHAR, weight[:, :, 0])
        sums = np.zeros((s, width + 1))
        sums[:, 0] = 1
        for end in range(1, width + 1):
            n = min(most, end)
            weight[:, end - 1, :n] *= sums[:, end - n : end][:, ::-1]
            sums[:, end] = weight[:, end - 1, :n].sum(1)
        edge = weight > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.cumsum(weight, 2) / sums[:, 1:, None]
        row, end, back = np.nonzero(edge)
        got = piece[row, end, back]
        ids = np.where(got >= 0, self.piece_id[got], -1 - chars[row, end].astype(np.int64))
        shares = share[row, end, back]
        last = np.r_[(row[1:] != row[:-1]) | (end[1:] != end[:-1]), True] if len(row) else np.zeros(0, bool)
        shares[last] = 1.0
        per = edge.sum(2)  # edges of each node but the first
        grid = np.zeros((s, width + 1), np.int64)
        grid[:, 1:] = per
        real = np.arange(width + 1) <= size[:, None]
        first = self.nodes
        self.new.append((self.edges + np.cumsum(grid[real]), shares, back + 1, ids))
        self.nodes += int(real.sum())
        self.edges += len(row)
        ends = first + np.cumsum(size + 1) - 1
        self.ends.update(zip(stretches, ends.tolist(), strict=True))

    def reset(self) -> None:
        self.ends: dict[str, int] = {}
        self.nodes = self.edges = 0  # so far; what is new since the last call of tables() is in self.new
        self.new: list[tuple] = []  # of each call: where each node's edges end, shares, nodes to go back, pieces or -1 - character
        self.done = (0, 0)  # nodes and edges that the arrays hold
        self.arrays = [np.zeros(1 << 16, kind) for kind in (np.int64, np.float64, np.int32, np.int64)]

    def _window(self, stretch: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges into the nodes lo + 1 to hi of a long stretch: where each node's begin, nodes to go back, weights, pieces or -1 - character."""
        start = max(0, lo - self.longest + 1)
        chars = np.frombuffer(stretch[start:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, ends, back, weight, ids = len(chars), [], [], [], []
        rolled = np.zeros(n, np.uint64)
        for k in range(min(self.longest, n)):
            rolled = rolled[: n - k] * _ROLL[0] + chars[k:] + np.uint64(1)
            found = self._find(rolled)
            at = np.flatnonzero(found >= 0)
            ends.append(at + k + 1)
            back.append(np.full(len(at), k + 1))
            weight.append(self.piece_weight[found[at]])
            ids.append(self.piece_id[found[at]])
            if not k:
                bare = np.flatnonzero(found < 0)
                ends.append(bare + 1)
                back.append(np.ones(len(bare), int))
                weight.append(np.full(len(bare), self.rare * PER_CHAR))
                ids.append(-1 - chars[bare].astype(np.int64))
        end = np.concatenate(ends) + start
        own = np.flatnonzero(end > lo)
        own = own[np.argsort(end[own], kind="stable")]
        first = np.searchsorted(end[own], np.arange(lo + 1, hi + 2))
        return first, *(np.concatenate(x)[own] for x in (back, weight, ids))

    def _long(self, stretch: str, key: int) -> np.ndarray:
        """A segmentation of a long stretch: logarithms of the forward sums are kept, edges only of one window at a time."""
        n, most = len(stretch), self.longest
        logs, sums, scale = np.zeros(n + 1), [1.0], 0.0  # sums: of the last nodes, each times exp(-scale)
        for lo in range(0, n, WINDOW):
            hi = min(n, lo + WINDOW)
            first, back, weight, _ = (x.tolist() for x in self._window(stretch, lo, hi))
            got = []
            for node in range(hi - lo):
                total = 0.0
                for k in range(first[node], first[node + 1]):
                    total += weight[k] * sums[-back[k]]
                got.append(math.log(total) + scale)
                sums.append(total)
                if not 1e-150 < total < 1e150:
                    sums = [x / total for x in sums[-most:]]
                    scale += math.log(total)
            sums = sums[-most:]
            logs[lo + 1 : hi + 1] = got
        out, at, step = [], n, 0
        while at:
            hi, lo = at, max(0, at - WINDOW)
            first, back, weight, ids = self._window(stretch, lo, hi)
            node = np.repeat(np.arange(lo + 1, hi + 1), np.diff(first))
            bounds = np.cumsum(weight * np.exp(logs[node - back] - logs[node]))  # a node's shares add up to 1
            u = ((_mix(np.uint64(key) + np.arange(step, step + hi - lo, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            first, back, ids, bounds = first.tolist(), back.tolist(), ids.tolist(), [0.0, *bounds.tolist()]
            taken = step
            while at > lo:
                a, b = first[at - lo - 1], first[at - lo]
                edge = bisect.bisect_right(bounds, bounds[a] + u[step - taken] * (bounds[b] - bounds[a]), a + 1, b) - 1
                out.append(ids[edge])
                at -= back[edge]
                step += 1
        return np.array(out[::-1], np.int64)

    def tables(self) -> tuple[np.ndarray, ...]:
        """First edge of each node; of each edge, its node plus the shares up to it, the nodes to go back, the piece."""
        nodes, edges = self.done
        n, m = self.nodes, self.edges
        for k, size in enumerate((n + 1, m, m, m)):
            if size > len(self.arrays[k]):
                self.arrays[k] = np.concatenate([self.arrays[k], np.zeros(max(size, len(self.arrays[k])), self.arrays[k].dtype)])
        first, bounds, back, ids = self.arrays
        if n > nodes:
            first[nodes + 1 : n + 1], bounds[edges:m], back[edges:m], ids[edges:m] = (np.concatenate(x) for x in zip(*self.new, strict=True))
            bounds[edges:m] += np.repeat(np.arange(nodes, n), np.diff(first[nodes : n + 1]))
            self.new = []
        self.done = (n, m)
        return first[: n + 1], bounds[:m], back[:m], ids[:m]

    def sample(self, texts: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """A segmentation of each text as piece ids; a text's key seeds it."""
        if len(texts) == 1:
            cuts, out, number = self.cuts(texts[0] and " " + texts[0]), [np.zeros(0, np.int64)], 0
            while part := [m.group() for m in itertools.islice(cuts, STRETCHES)]:
                out += self._sample([part], keys, number, seed)
                number += len(part)
            return [np.concatenate(out)]
        return self._sample([self.cut(text and " " + text) for text in texts], keys, 0, seed)

    def _sample(self, parts: list[list[str]], keys: list[int], before: int, seed: int) -> list[np.ndarray]:
        """Of the stretches of each text; `before` of them come before these."""
        if len(self.ends) > TABLE_STRETCHES:
            self.reset()
        every = list(itertools.chain(*parts))
        if not every:
            return [np.zeros(0, np.int64) for _ in parts]
        self.add_all([x for x in {*every} - self.ends.keys() if len(x) <= KEPT_CHARS])
        node = np.array([self.ends.get(x, -1) for x in every])
        first, bounds, back, ids = self.tables()
        sizes = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(parts)), sizes)
        number = before + np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = _mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)[row] + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        key = _mix(key + number.astype(np.uint64))
        live, order, step = np.flatnonzero(node >= 0), [], 0
        long = {int(k): self._long(every[k], int(key[k])) for k in np.flatnonzero(node < 0)}
        while True:
            open_ = first[node[live] + 1] > first[node[live]]
            live = live[open_]
            if not len(live):
                break
            u = (_mix(key[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(bounds, node[live] + u, "right")
            edge = np.minimum(np.maximum(edge, first[node[live]]), first[node[live] + 1] - 1)
            order.append((live, ids[edge]))
            node[live] -= back[edge]
            step += 1
        steps = np.zeros(len(node), np.int64)
        for walks, _ in order:
            steps[walks] += 1
        for k, own in long.items():
            steps[k] = len(own)
        ends = np.cumsum(steps)
        got = np.zeros(ends[-1], np.int64)
        for k, (walks, chosen) in enumerate(order):
            got[ends[walks] - 1 - k] = chosen  # walks run backwards
        for k, own in long.items():
            got[ends[k] - len(own) : ends[k]] = own
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        if self.nodes > 20 * TABLE_STRETCHES:
            self.reset()
        return [self._spelt(got[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece, as byte pieces."""
        low = (ids < 0) & (ids >= -128)
        ids = np.where(low, self.ascii_id[np.where(low, -1 - ids, 0)], ids)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        spelt = [[self.byte_id[b] for b in chr(-1 - int(ids[k])).encode("utf-8", "surrogatepass")] for k in odd]
        parts = np.split(ids, odd)
        return np.concatenate([parts[0], *(np.r_[s, p[1:]] for s, p in zip(spelt, parts[1:], strict=True))]).astype(np.int64)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        parts = (np.asarray(ids[at : at + STRETCHES]).tolist() for at in range(0, len(ids), STRETCHES))
        return b"".join(b"".join(map(self.bytes_of.__getitem__, p)) for p in parts)[1:].decode("utf-8", "surrogatepass")

    def log_probability(self, text: str, ids: list[int]) -> float:
        """Of a segmentation under the lattice; for tests on short texts."""
        total, weight, at = {0: 1.0}, 0.0, 0
        padded = " " + text
        for end in range(1, len(padded) + 1):
            total[end] = sum(total[s] * self.pieces[padded[s:end]][1] for s in range(max(0, end - self.longest), end) if padded[s:end] in self.pieces)
            if padded[end - 1] not in self.pieces:
                total[end] += total[end - 1] * self.rare
        for i in ids:
            piece = self.bytes_of[i].decode()
            weight += math.log(self.pieces[piece][1])
            at += len(piece)
        return weight - math.log(total[len(padded)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _lattice(path: str, sharpness: float) -> Lattice:
    return Lattice(path, sharpness)


def _segmented(own: Lattice, batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Rows (id, text, key) with their texts and sampled ids, so many together that their characters are bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        start = 0
        while start < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 4096]), BATCH_BYTES, "right")))
            part = batch.slice(start, n)
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield part, texts, own.sample(texts, part.column(2).to_pylist(), seed)
            start += n


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """(id, text, ids array<int>) of every row: one sampled segmentation, seeded by the row's id.

    Null and empty texts have no pieces. Rows of one id and text get one segmentation. A null id seeds as an empty one.
    Texts of any length are encoded whole; other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(VOCABULARY)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, done in _segmented(_lattice(path, sharpness), batches, seed):
            offsets = np.cumsum([0, *map(len, done)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(done).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], [id_col, text_col, "ids"])

    schema = T.StructType([docs.schema[id_col], docs.schema[text_col]]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(id_col, text_col, _key(id_col)).mapInArrow(sampled, schema)


def _key(id_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_k")


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """`encoded` with `out`: the text that the pieces spell; null ids give null, no ids the empty text.

    Repeated rows are decoded each for itself; an `out` that is there already is replaced, other columns stay.
    """
    small_batches(encoded.sparkSession)
    path = path or tokenizer_path(VOCABULARY)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = _lattice(path, SHARPNESS)
        return pa.array((own.decode(x.values.to_numpy()) if x.is_valid else None for x in ids), pa.string())  # a row at a time

    return encoded.withColumn(out, text(ids_col))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED) -> DataFrame:
    """(id, n_pieces, ids_crc32, lossless) of every row: digests of its sampled pieces, and whether they decode to its text.

    Encoding and decoding as in `encode` and `decode`, in one worker, so that ids need not pass between processes.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(VOCABULARY)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lattice(path, SHARPNESS)
        for part, texts, done in _segmented(own, batches, seed):
            same = [own.decode(ids) == t for ids, t in zip(done, texts, strict=True)]
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in done]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, done), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], [id_col, "n_pieces", "ids_crc32", "lossless"])

    schema = T.StructType([docs.schema[id_col]]).add("n_pieces", "long").add("ids_crc32", "long").add("lossless", "boolean")
    return docs.select(id_col, text_col, _key(id_col)).mapInArrow(checked, schema)
