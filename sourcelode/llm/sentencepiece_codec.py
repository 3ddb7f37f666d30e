"""Operator 5: SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a word with its leading space mark) that the
worker has not met yet are concatenated and indexed by a suffix array, as deep
as the longest piece needs. Every piece of the vocabulary is looked up by binary
search; its range in the suffix array gives all its occurrences, which are the
edges of the segmentation lattice. Edges are sorted by position and relaxed from
left to right, all segments side by side. The model file holds a BPE model, so
the relaxation does not add scores: an edge extends the encoding that ends where
it starts exactly if the merge order would keep the last piece and the new one
apart. This gives the library's ids, byte fallback included.

Edge cases: a null or empty text has no pieces and decodes to the empty text;
texts of any length are taken whole; characters that the vocabulary lacks become
byte pieces; the space mark U+2581 in a text decodes to a space, which the
column round_trip shows; repeated rows, null ids and an empty table pass
through; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slim, table

MARK = "▁"
NONE = np.int64(1 << 40)
CHUNK_CHARS, LEARN_CHARS, CACHE_SIZE, PAIR_CACHE, CACHE_BYTES = 500_000, 150_000, 100_000, 1 << 20, 32_000_000


class Pieces:
    """Tables of a BPE model file. Pieces are renumbered: single characters first, then by merge order."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        text = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size())}
        self.runs = {len(text[i]): i for i in normal if len(text[i]) > 1 and set(text[i]) == {MARK}}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        single = [i for i in normal if len(text[i]) == 1]
        merged = sorted((i for i in normal if len(text[i]) > 1 and i not in self.runs.values()), key=lambda i: -sp.get_score(i))
        if len({sp.get_score(i) for i in merged}) < len(merged) or any(MARK in text[i][1:] for i in merged):
            raise ValueError("pieces with equal scores or inner space marks are not supported")
        order = [-1, *single, *merged]  # 0 stands for a character that the vocabulary lacks
        self.ids, self.base = np.array(order, np.int32), 1 + len(single)
        number = {text[i]: k for k, i in enumerate(order) if k}
        pairs = {}
        for p, k in number.items():
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a and b:
                    pairs[a, b] = k
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[by], np.array(list(pairs.values()), np.int64)[by]
        self.left, self.right = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        usable = list(range(1, self.base))
        for k in range(self.base, len(order)):
            if whole := self._last_merge([number.get(c, 0) for c in text[order[k]]], pairs, k):
                self.left[k], self.right[k] = whole
                if max(whole) > k:
                    raise ValueError("a piece precedes its parts in merge order")
                usable.append(k)
        edges = [(text[order[k]].encode(), k) for k in usable]
        self.index = PieceIndex(edges)
        self.space = int(order[number[MARK]])
        spoken = {i: text[i].replace(MARK, " ").encode() for i in normal} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_of = [spoken.get(i, b"") for i in range(sp.get_piece_size())]

    @staticmethod
    def _last_merge(symbols, pairs, want):
        """The two parts of the last merge if the merge order makes one piece of these characters."""
        last = None
        while len(symbols) > 1:
            best = min((pairs.get(x, NONE), i) for i, x in enumerate(zip(symbols, symbols[1:])))
            if best[0] == NONE:
                return None
            last = symbols[best[1]], symbols[best[1] + 1]
            symbols[best[1] : best[1] + 2] = [best[0]]
        return last if symbols[0] == want else None


class PieceIndex:
    """Pieces by the eight bytes from a depth on: key bounds to search for, and an index of the longer pieces below each key."""

    def __init__(self, pieces: list[tuple[bytes, int]], depth: int = 0):
        number = lambda t, fill: int.from_bytes(t.ljust(8, fill), "big")
        here = sorted((number(p[depth : depth + 8], b"\0"), number(p[depth : depth + 8], b"\xff"), len(p), k) for p, k in pieces if len(p) <= depth + 8)
        self.depth, self.longest = depth, max((len(p) for p, _ in pieces), default=0)
        self.low, self.high = (np.array([x[i] for x in here], np.uint64) for i in (0, 1))
        self.length, self.piece = (np.array([x[i] for x in here], np.int64) for i in (2, 3))
        below: dict[int, list] = {}
        for p, k in pieces:
            if len(p) > depth + 8:
                below.setdefault(number(p[depth : depth + 8], b"\0"), []).append((p, k))
        self.key = np.array(sorted(below), np.uint64)
        self.below = [PieceIndex(below[int(x)], depth + 8) for x in self.key]


def suffix_ranges(text: np.ndarray, index: PieceIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences (start, length, piece number) of the pieces in text, by binary search in its suffix array.

    Suffixes are ordered by eight bytes at a time; deeper ranges are ordered only where a longer piece reaches them.
    """
    padded = np.r_[text, np.zeros(8 + index.longest, np.uint8)]
    eight = padded[: len(padded) - 7].astype(np.uint64)
    for k in range(1, 8):
        eight = eight << np.uint64(8) | padded[k : len(padded) - 7 + k]
    found, todo = [], [(np.arange(len(text)), index)]
    while todo:
        at, node = todo.pop()  # suffixes that share their first bytes with the pieces of the node
        key = eight[at + node.depth]
        by = np.argsort(key)
        at, key = at[by], key[by]
        low = np.searchsorted(key, node.low)
        size = np.searchsorted(key, node.high, "right") - low
        some = np.flatnonzero(size)
        if len(some):
            low, size = low[some], size[some]
            rank = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found.append((at[rank], np.repeat(node.length[some], size), np.repeat(node.piece[some], size)))
        if len(node.key):
            low, high = np.searchsorted(key, node.key), np.searchsorted(key, node.key, "right")
            todo += [(at[low[i] : high[i]], node.below[i]) for i in np.flatnonzero(low < high)]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


class Codec:
    """Encodes and decodes texts; keeps what it has learnt about segments, in bounded memory."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.p, self.cache_size, self.cache, self.held, self.run_cache = Pieces(path), cache_size, {"": b""}, 0, {}
        self.broken: set[str] = set()  # segments whose ids do not decode to them
        self.pair_key, self.pair_ok = np.full(PAIR_CACHE, -1, np.int64), np.zeros(PAIR_CACHE, bool)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the merge order leaves pieces x and y next to each other unmerged."""
        key = x << 20 | y
        slot = ((key * -7046029254386353131) >> 44 & (PAIR_CACHE - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            fresh = self._apart(some >> 20, some & ((1 << 20) - 1))[back]
            ok[new] = fresh
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], fresh
        return ok

    def _apart(self, x, y):
        """Walks back through the merges of both pieces: at no time may their touching parts have merged."""
        p, ok = self.p, np.ones(len(x), bool)
        at, end_x, end_y = np.arange(len(x)), np.full(len(x), NONE), np.full(len(x), NONE)
        while len(at):
            key = x << 20 | y
            i = np.minimum(np.searchsorted(p.pair_keys, key), len(p.pair_keys) - 1)
            merge = np.where(p.pair_keys[i] == key, p.pair_to[i], NONE)
            bad = (merge < end_x) & (merge <= end_y)
            ok[at[bad]] = False
            born_x, born_y = np.where(x >= p.base, x, -1), np.where(y >= p.base, y, -1)
            undo = born_x > born_y
            end_x, end_y = np.where(undo, born_x, end_x), np.where(undo, end_y, born_y)
            x, y = np.where(undo, p.right[x], x), np.where(undo, y, p.left[y])
            go = ~bad & (np.maximum(born_x, born_y) >= 0)
            at, x, y, end_x, end_y = at[go], x[go], y[go], end_x[go], end_y[go]
        return ok

    def learn(self, segments: set[str]) -> None:
        """Encode the segments that the cache lacks, which begins anew once it holds too many or too long ones."""
        if len(self.cache) > self.cache_size or self.held > CACHE_BYTES:
            self.cache, self.held, self.broken = {"": b""}, 0, set()
        some, size = [], 0
        for x in segments.difference(self.cache):
            some.append(x)
            if (size := size + len(x)) > LEARN_CHARS:  # bounds the lattice held at once
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)

    def _learn(self, new: list[str]) -> None:
        p, raw = self.p, [s.encode() for s in new]
        size = np.array([len(b) for b in raw])
        start = np.r_[0, np.cumsum(size + 1)[:-1]]
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)  # a byte that UTF-8 never has
        s, n, k = suffix_ranges(text, p.index)
        head = np.flatnonzero((text & 0xC0) != 0x80)
        head = head[text[head] != 0xFF]
        width = np.select([text[head] < 0x80, text[head] < 0xE0, text[head] < 0xF0], [1, 2, 3], 4)
        known = np.zeros(len(text), bool)
        known[s[k < p.base]] = True
        lack = ~known[head]
        s, n, k = np.r_[s, head[lack]], np.r_[n, width[lack]], np.r_[k, np.zeros(lack.sum(), np.int64)]
        # where no piece reaches across a place nothing can merge across it: a segment falls into parts there
        across = np.cumsum(np.bincount(s + 1, minlength=len(text) + 2) - np.bincount(s + n, minlength=len(text) + 2))[: len(text)]
        opens = across == 0
        opens[text == 0xFF] = False
        opens[start[size > 0]] = True
        parts = np.flatnonzero(opens)
        first = parts[np.maximum(np.cumsum(opens) - 1, 0)]
        ends = np.r_[parts[1:], len(text)]
        ends = ends - (text[ends - 1] == 0xFF)
        rel = s + n - first[s]
        by = np.argsort(rel.astype(np.uint16) if rel.max() < 65536 else rel, kind="stable")  # sorted by position within the part
        s, n, k, rel = s[by], n[by], k[by], rel[by]
        bounds = np.searchsorted(rel, np.arange(1, rel[-1] + 2))
        last, source = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            es, en, ek = s[a:b], n[a:b], k[a:b]
            opening = opens[es]
            before = np.where(opening, 0, last[es])
            ok = opening.copy()
            rest = np.flatnonzero(~opening & (before >= 0))
            ok[rest] = self.apart(before[rest], ek[rest])
            es, en, ek = es[ok], en[ok], ek[ok]
            last[es + en], source[es + en] = ek, es
        at, out = ends, []
        while len(at):
            out.append((last[at], source[at]))
            at = source[at]
            at = at[~opens[at]]
        piece, begin = (np.concatenate(x) for x in zip(*out))
        by = np.argsort(begin)
        piece, begin = piece[by], begin[by]
        seg = np.searchsorted(start, begin, "right") - 1
        wide = np.ones(len(text) + 1, np.int64)
        wide[head] = width
        reps = np.where(piece == 0, wide[begin], 1)
        ids = np.repeat(p.ids[piece], reps)
        inner = np.arange(len(ids)) - np.repeat(np.r_[0, np.cumsum(reps)[:-1]], reps)
        lacking = np.repeat(piece == 0, reps)
        ids[lacking] = p.byte_ids[text[(np.repeat(begin, reps) + inner)[lacking]]]
        ends = 4 * np.cumsum(np.bincount(np.repeat(seg, reps), minlength=len(new)))
        buf = ids.astype(np.int32).tobytes()
        cuts = [buf[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        self.cache.update(zip(new, cuts))
        self.held += len(buf) + len(text)
        if self._raw(ids.tolist()) != b"".join(raw).replace(MARK.encode(), b" "):
            self.broken.update(x for x, ids in zip(new, cuts) if self._raw(np.frombuffer(ids, np.int32).tolist()) != x.replace(MARK, " ").encode())

    def _run(self, n: int) -> np.ndarray:
        """Pieces for n space marks in a row: equal scores, so the leftmost possible merge goes first."""
        if n not in self.run_cache:
            if len(self.run_cache) > 1000 or n > 10_000:
                self.run_cache = {}
            sizes, i = [1] * n, 0
            while i < len(sizes) - 1:
                if sizes[i] + sizes[i + 1] in self.p.runs:
                    sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
                    i = max(i - 1, 0)
                else:
                    i += 1
            self.run_cache[n] = np.array([self.p.runs.get(x, self.p.space) for x in sizes], np.int32)
        return self.run_cache[n]

    @staticmethod
    def segments(text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ")

    def join(self, segments: list[str]) -> np.ndarray:
        """Ids of a text, given its segments, all of them learnt."""
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, segments)), np.int32)
        space = ids == self.p.space
        if not (space[1:] & space[:-1]).any():
            return ids
        edge = np.flatnonzero(np.diff(np.r_[0, space.view(np.int8), 0]))
        out, at = [], 0
        for a, b in zip(edge[::2], edge[1::2]):
            out += [ids[at:a], self._run(int(b - a))]
            at = b
        return np.concatenate([*out, ids[at:]])

    def encode(self, text: str | None) -> np.ndarray:
        segments = self.segments(text or "")
        self.learn(set(segments))
        return self.join(segments)

    def _raw(self, ids) -> bytes:
        return b"".join(map(self.p.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self._raw(ids).removeprefix(b" ").decode("utf-8", "replace")

    def returns(self, text: str, segments: list[str]) -> bool:
        """Whether the ids of a text decode to it: its segments' ids do, which is decoded once per segment, and no space mark turns into a space."""
        return MARK not in text and (not self.broken or self.broken.isdisjoint(segments))


def encode(docs: DataFrame, path: str, cache_size: int = CACHE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the pieces' ids), n_pieces, round_trip (the ids decode to the text) for every row of docs."""
    docs = slim(docs, id_col, text_col)

    def run(batches):
        codec = Codec(path, cache_size)
        for batch in batches:
            at, held, chars = 0, [], 0

            def flush():
                codec.learn({x for _, segments in held for x in segments})
                ids = [codec.join(segments) for _, segments in held]
                trips = [codec.returns(text, segments) for text, segments in held]
                sizes = np.array([len(x) for x in ids], np.int64)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))
                columns = [batch.column(0).slice(at, len(held)), pieces, pa.array(sizes), pa.array(trips, pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_pieces", "round_trip"])

            for text in batch.column(1):
                text = text.as_py() or ""
                held.append((text, codec.segments(text)))
                if (chars := chars + len(text)) > CHUNK_CHARS:
                    yield flush()
                    at, held, chars = at + len(held), [], 0
            yield flush()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for every row of ids; null ids decode to the empty text."""
    d = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batches):
        codec = Codec(path)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
