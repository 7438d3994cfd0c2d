"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern; each match ("piece") is encoded by itself, as the merge ranks say. Pieces are grouped by
length into padded matrices of ids, and in each round every row merges its leftmost pair of least rank: the ranks of all neighbouring
pairs come from a hash table of pairs in numpy arrays, and the matrix is compacted after the merge. A long piece is cut into segments, which are rows of
the same matrices; its segments are then joined two by two, again by matrices over the tokens around each seam. Pieces seen before come from a
cache of bounded size, so a piece costs its merges once for each time the cache is filled.
"""
import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Bytes of a segment of a long piece, tokens on each side of a seam that are merged anew at first, and bytes from which on a row is a matrix by itself.
SEGMENT, SEAM, WIDE = 256, 4, 1024
#: The cache of pieces is emptied when it holds more than this; that only costs time.
CACHE_PIECES = 300_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one file of ranks. encode_texts gives what the tiktoken library's encode_ordinary gives."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.table = np.empty(self.size, object)
        self.table[:] = self.bytes_of
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], "i4")
        self._build_pairs()
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.start, self.count, self.used = np.zeros(1 << 16, "u4"), np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8"), 0

    def _build_pairs(self) -> None:
        """Open addressing: the slot of (left, right) holds the pair's key and the rank of the two joined."""
        keys, ranks = [], []
        get = self.ranks.get
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                left = get(whole[:i])
                if left is not None:
                    right = get(whole[i:])
                    if right is not None:
                        keys.append(left * self.size + right)
                        ranks.append(rank)
        keys, ranks = np.array(keys, "i8"), np.array(ranks, "i4")
        self.least = np.full(self.size, NONE, "i4")  # of each token: the least rank of a pair that it is part of
        np.minimum.at(self.least, keys // self.size, ranks)
        np.minimum.at(self.least, keys % self.size, ranks)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank, self.probes = np.full(1 << bits, -1, "i8"), np.full(1 << bits, NONE, "i4"), 0
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("i8")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair joined, NONE where there is no such token."""
        shape = left.shape
        keys = (left.astype("i8") * self.size + right).ravel()
        keys[(right < 0).ravel()] = -2
        at, out = self._slot(keys), np.full(keys.shape, NONE, "i4")
        open_ = np.flatnonzero(keys >= 0)
        for _ in range(self.probes):
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        ids = np.full((n, width), -1, "i4")
        flat = self.byte_id[np.frombuffer(b"".join(pieces), "u1")]
        lens = np.fromiter(map(len, pieces), "i8", n)
        row = np.repeat(np.arange(n), lens)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        ids[row, col] = flat
        out: list[np.ndarray] = [None] * n
        alive = np.arange(n)
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1)  # the leftmost of the least
            low = rank[np.arange(len(alive)), at]
            done = low == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    r = ids[k]
                    out[alive[k]] = r[r >= 0].astype("u4")
                go = ~done
                alive, ids, at, low = alive[go], ids[go], at[go], low[go]
                if not len(alive):
                    return out
                used = int((ids >= 0).sum(1).max())
                ids = ids[:, :used]
            cols = np.arange(ids.shape[1] - 1)
            left = np.where(cols[None, :] > at[:, None], ids[:, 1:], ids[:, :-1])  # what is right of the merge moves left
            left[np.arange(len(alive)), at] = low
            ids = left
            if ids.shape[1] == 1:
                ids = np.concatenate([ids, np.full((len(ids), 1), -1, "i4")], 1)
            rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])

    def _wide(self, piece: bytes) -> np.ndarray:
        """One row of any length. Where no pair with the new token comes before it, all rounds that merge the same least pair are done at once."""
        ids = self.byte_id[np.frombuffer(piece, "u1")]
        while len(ids) > 1:
            rank = self.pair_ranks(ids[:-1], ids[1:])
            low = int(rank.min())
            if low == NONE:
                break
            at = np.flatnonzero(rank == low)
            if self.least[low] > low:
                order = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, order, 0))
                at = at[(order - first) % 2 == 0]  # of pairs that overlap every other one, from the left
            else:
                at = at[:1]
            ids[at] = low
            ids = np.delete(ids, at + 1)
        return ids.astype("u4")

    def _merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > WIDE:
                out[k] = self._wide(p)
            else:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()) if len(p) > 16 else (len(p) + 1) // 2 * 2, []).append(k)
        for width, ks in buckets.items():
            step = max(1, 400_000 // width)
            for i in range(0, len(ks), step):
                part = ks[i : i + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The encoding of each left and right together. A sequence of tokens is the encoding of its bytes if each two neighbours are that of theirs, so only the
        tokens around the seam change: they are merged anew, more of them until the outermost ones stay as they were."""
        out: list[np.ndarray] = [None] * len(pairs)
        todo, n = list(range(len(pairs))), SEAM
        while todo:
            coded = self._merge([self.decode(np.concatenate([pairs[k][0][-n:], pairs[k][1][:n]])) for k in todo])
            again = []
            for k, ids in zip(todo, coded, strict=True):
                left, right = pairs[k]
                if (len(left) <= n or ids[0] == left[-n]) and (len(right) <= n or ids[-1] == right[n - 1]):
                    out[k] = np.concatenate([left[:-n], ids, right[n:]])
                else:
                    again.append(k)
            todo, n = again, 2 * n
        return out

    def _long(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces of more than SEGMENT bytes."""
        cut = [[p[i : i + SEGMENT] for i in range(0, len(p), SEGMENT)] for p in pieces]
        coded = iter(self._merge([x for parts in cut for x in parts]))
        rows = [[next(coded) for _ in parts] for parts in cut]
        while any(len(r) > 1 for r in rows):
            seams = [(k, i) for k, r in enumerate(rows) for i in range(0, len(r) - 1, 2)]
            joined = self._joined([(rows[k][i], rows[k][i + 1]) for k, i in seams])
            new: list[list[np.ndarray]] = [[] for _ in rows]
            for (k, _), ids in zip(seams, joined, strict=True):
                new[k].append(ids)
            rows = [a + (r[-1:] if len(r) % 2 else []) for a, r in zip(new, rows, strict=True)]
        return [r[0] for r in rows]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        short, long_ = [], []
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = np.array([whole], "u4")
            else:
                (long_ if len(p) > SEGMENT else short).append(k)
        for ks, coded in ((short, self._merge([pieces[k] for k in short])), (long_, self._long([pieces[k] for k in long_]))):
            for k, ids in zip(ks, coded, strict=True):
                out[k] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Puts new pieces into the cache."""
        coded = self.encode_pieces([p.encode() for p in pieces])
        lens = np.fromiter(map(len, coded), "i8", len(coded))
        n, need = len(self.cache), self.used + int(lens.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : need] = np.concatenate(coded)
        self.start[n : n + len(pieces)] = self.used + np.cumsum(lens) - lens
        self.count[n : n + len(pieces)] = lens
        self.used = need
        self.cache.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode_texts(self, texts: list[str | None]):
        """Yields the ids of each text (null: none), as little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > 1_000_000:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]):
        if len(self.cache) > CACHE_PIECES:
            self._clear()
        split = [self.find(t) for t in texts]
        new: dict[str, None] = {}
        for pieces in split:
            new.update(dict.fromkeys(p for p in set(pieces) if p not in self.cache))
        if new:
            self._learn(list(new))
        where = self.cache.__getitem__
        for pieces in split:
            at = np.fromiter(map(where, pieces), "i8", len(pieces))
            n = self.count[at]
            ends = np.cumsum(n)
            yield self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + n, n)].astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


_LOADED: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def tokenize(docs: DataFrame, path: str, pattern: str, ids_column: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every whole text, then decodes its ids.

    One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int). A null text counts
    as empty: no ids, and the digests of nothing. Repeated rows and rows with a null doc_id give a row each; other columns are not read,
    whatever their names, unless named in `keep`, which passes them on after doc_id; an empty table gives an empty result. A text of any length is encoded whole, within its own task.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids_column:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        coder = bpe(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n, ids_sha, text_sha, kept = [], [], [], []
                for ids in coder.encode_texts(part.column(1).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if ids_column:
                        kept.append(ids.astype("i4"))
                cols = [part.column(0), *part.columns[2:], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if ids_column:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select(id_col, text_col, *keep).mapInArrow(run, T.StructType(fields))
