"""Operator 1: language-model scores from a log-frequency Bloom filter.

Word and word-pair counts are gathered over all training rows, quantised to
levels of a logarithmic scale and stored in a Bloom filter: an n-gram of level
q is entered once for each level 1..q. The filter is broadcast; a worker finds
a level by probing upwards until a probe misses. A token's probability mixes
the pair estimate with the word estimate, weighted by the level of the context.
The weights come from all training text, each occurrence left out of its own counts.

Counting: a task sorts the hashes of about CHUNK_BYTES of text and hands each
shard of the hash space one packed row, so a frequent word costs one entry per
chunk, not per occurrence. A shard's task adds the counts up, builds the
filter's segment for that shard, and sums the exact base score of the chunk's
documents, which needs the counts but no join by word. Shards are sized by bytes
of text; a document's sum goes back from the shards that hold one of its words
only, so what is sent back stays below a fixed multiple of the text.

The filter grows with the corpus: a segment is as large as its entries need at
PROBES probes, and no word or pair is left out. While all segments together
stay within max_filter_mb they are broadcast. A larger filter is never put
together: the hashes that chunks send for counting name all they will ask, so
each shard probes its segment as soon as it is built, once for each distinct
hash, and sends every chunk its levels back. A chunk keeps the order of its
tokens, from which the pairs follow again. Both ways probe the
same bits and give the same scores. Texts of more than TEXT_A_FILTER times the
bound take the second way at once; others do if their filter turns out larger.
The base score is exact up to collisions of 64-bit hashes.

Edge cases: null or empty texts are one end token; a null doc_id trains and is
not held out; rows with the same id and text share one result each; without
training rows every score follows from zero counts; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, drop_shuffles, fold_of, materialise, slim, table

CHUNK_BYTES, CHUNK_DOCS, PROBES, BASE, MAX_FILTER_MB = 6_000_000, 60_000, 5, 1.5, 128
SHARD_BYTES = 10_000_000  # of text, on average
TEXT_A_FILTER = 8  # bytes of text for a byte of the filter, at least, where texts are prose
FLOOR = 0.1
START = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
RATIO_BINS = 64  # of log2(pair / word estimate), from -24 up; one more bin for pairs not found
LEVELS = 96


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count) for counts of 1 and more."""
    return (np.log(count.astype(float)) / math.log(BASE) + 1e-9).astype(np.int64) + 1


_EDGES = [math.ceil(BASE**q - 1e-9) for q in range(LEVELS + 1)]
#: What a level stands for: the geometric middle of the counts it holds, 0 at level 0.
VALUE = np.array([0.0] + [math.sqrt(a * max(b - 1, a)) for a, b in zip(_EDGES, _EDGES[1:])])


@dataclass
class Chunk:
    """Tokens of some documents in order; each document ends with an end token."""

    hashes: np.ndarray
    doc: np.ndarray
    train: np.ndarray
    n_tokens: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every token with its predecessor, and the predecessors' hashes."""
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[:1] = START
        before[1:][self.doc[1:] != self.doc[:-1]] = START
        return mixed(before * np.uint64(3) + self.hashes * _B), before


def chunk_of(texts: list[bytes], train: list[bool]) -> Chunk:
    from xxhash import xxh64_intdigest as h

    end, hashes, n = h(b""), [], []
    for t in texts:
        words = t.translate(FOLD).split()
        hashes.extend(map(h, words))
        hashes.append(end)
        n.append(len(words) + 1)
    n = np.array(n, np.int64)
    return Chunk(np.array(hashes, np.uint64), np.repeat(np.arange(len(n)), n), np.array(train, bool), n)


def chunks(batches):
    """Chunks of the rows (doc_id, thash, train, text) of a task: (columns so far, Chunk)."""
    ids, keys, train, texts, size = [], [], [], [], 0
    for b in batches:
        for i, k, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            raw = (x.as_py() or "").encode()
            ids.append(i), keys.append(k), train.append(t), texts.append(raw)
            size += len(raw)
            if size > CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                yield ids, keys, chunk_of(texts, train)
                ids, keys, train, texts, size = [], [], [], [], 0
    if ids:
        yield ids, keys, chunk_of(texts, train)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64) if n else np.empty(0, np.int64)


PACKED = "kind int, shard long, chunk long, a binary, b binary, c binary, d binary, n long, ids array<long>, keys array<long>, e binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("e", pa.binary())])
WORDS, PAIRS, INFO, SUMS, WORD_LEVELS, PAIR_LEVELS = 0, 1, 2, 3, 4, 5


TOP_WORDS = 4096


def _ranked(top: np.ndarray, n: int) -> np.ndarray:
    """Places of n sorted words, those of top first."""
    rest = np.ones(n, bool)
    rest[top] = False
    return np.r_[top, np.flatnonzero(rest)]


def _order(back: np.ndarray, n: int) -> tuple[bytes, bytes]:
    """Places of the most frequent words, and the tokens' places when those come first, compressed by bytes of equal weight."""
    top = np.argsort(-np.bincount(back, minlength=n), kind="stable")[:TOP_WORDS]
    rank = np.empty(n, "<u4")
    rank[_ranked(top, n)] = np.arange(n)
    return top.astype("<u4").tobytes(), zlib.compress(rank[back].view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _places(top: bytes, order: bytes, n: int) -> np.ndarray:
    """The places of the tokens among n sorted words."""
    rank = np.ascontiguousarray(np.frombuffer(zlib.decompress(order), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return _ranked(np.frombuffer(top, "<u4").astype(np.int64), n)[rank]


def _pack(bits: int, ask: bool):
    """Task side of counting; with ask, pairs outside training are sent too, and what puts the levels in order."""
    shift = np.uint64(64 - bits)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for at, (ids, keys, c) in enumerate(chunks(batches)):
            chunk, rows = base + at, []
            words, back = np.unique(c.hashes, return_inverse=True)
            per, times = np.unique(back * len(ids) + c.doc, return_counts=True)
            word, doc = per // len(ids), per % len(ids)
            learn = np.bincount(word, times * c.train[doc], len(words)).astype(np.int64)
            cut = np.searchsorted(words >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(words)])
            first = np.searchsorted(word, np.arange(len(words) + 1))
            for s in range(1 << bits):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    p, q = first[a], first[b]
                    # hashes; training counts; documents per hash; then times and document of each
                    rows.append((WORDS, s, chunk, words[a:b].tobytes(), _narrow(learn[a:b]), _narrow(np.diff(first[a : b + 1])), _narrow(times[p:q]), q - p, None, None, _narrow(doc[p:q])))
            rows.append((INFO, int(mixed(np.array([chunk], np.uint64))[0] & np.uint64((1 << bits) - 1)), chunk, _narrow(c.n_tokens), c.train.tobytes(), *(_order(back, len(words)) if ask else (None, None)), len(ids), ids, keys, None))
            pair, learned = c.pairs()[0] >> np.uint64(16), c.train[c.doc]
            if ask:
                other, more = np.unique(pair[~learned], return_counts=True)
                pair, times = np.unique(pair, return_counts=True)
                times[np.searchsorted(pair, other)] -= more
            else:
                pair, times = np.unique(pair[learned], return_counts=True)
            cut = np.searchsorted(pair >> np.uint64(48 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(pair)])
            low, high = (pair & _LOW).astype(np.uint32), (pair >> np.uint64(32)).astype(np.int64)
            for s in range(1 << bits):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    # hashes are sorted: their low halves, times, and how many there are of each upper half that the shard holds
                    rows.append((PAIRS, s, chunk, low[a:b].tobytes(), _narrow(times[a:b]), _narrow(np.bincount(high[a:b] - (s << 16 - bits), minlength=1 << 16 - bits)), None, b - a, None, None, None))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 64]), _SCHEMA)], schema=_SCHEMA)

    return run


_LOW = np.uint64(0xFFFFFFFF)


def _level_hash(h: np.ndarray, level: int) -> np.ndarray:
    return mixed(h + np.array([level], np.uint64) * START)


def _positions(x: np.ndarray, n_bits: np.ndarray, probe: int) -> np.ndarray:
    """Bit of a probe, from a level's hash: double hashing on its halves, scaled to fewer than 2 ** 32 bits."""
    y = (x + (x >> np.uint64(32) | np.uint64(1)) * np.array([probe], np.uint64)) & _LOW
    return (y * n_bits >> np.uint64(32)).astype(np.int64)


def segment(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter bits of one shard."""
    level = level_of(counts)
    bits = np.zeros(int(level.sum() * PROBES / math.log(2) / 8) + 8, np.uint8)
    n_bits = np.array([8 * len(bits)], np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = _level_hash(h[level >= q], q)
        for probe in range(PROBES):
            at = _positions(some, n_bits, probe)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def _reduce(bits: int, ask: bool):
    """Shard side: totals, filter segments or, with ask, the levels they give, and base-score sums."""
    out = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("z", pa.float64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def filled(kind, shard, h, total, back, rows, sizes):
        """The segment, or what it says of each row's hashes."""
        some, z = total > 0, 0.0
        raw = segment(h[some], total[some])
        if kind == WORDS:
            z = float(VALUE[level_of(total[some])].sum())
        made = [(kind, shard, 0, None if ask else raw, None, None, None, int(total.sum()), int(some.sum()), z, None, None)]
        if ask:
            levels = Filter(0, {0: raw}, 64).levels(h)[back]
            of = WORD_LEVELS if kind == WORDS else PAIR_LEVELS
            made += [(of, shard, r["chunk"], levels[end - n : end].tobytes(), r["a"] if kind == WORDS else None, None, None, n, 0, 0.0, None, None) for r, n, end in zip(rows, sizes, np.cumsum(sizes))]
        return made

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kind, shard = rows[0]["kind"], rows[0]["shard"]
        made = []
        if kind == INFO:
            made = [(INFO, shard, r["chunk"], r["a"], r["b"], r["c"], r["d"], r["n"], 0, 0.0, r["ids"], r["keys"]) for r in rows]
        elif kind == PAIRS:
            uppers = np.arange(shard << 16 - bits, (shard + 1) << 16 - bits).astype(np.uint64) << np.uint64(32)
            high = np.concatenate([np.repeat(uppers, _wide(r["c"], len(uppers))) for r in rows])
            pair, back = np.unique(high | np.frombuffer(b"".join(r["a"] for r in rows), np.uint32), return_inverse=True)
            del high
            total = np.bincount(back, np.concatenate([_wide(r["b"], r["n"]) for r in rows])).astype(np.int64)
            made = filled(PAIRS, shard, pair, total, back, rows, [r["n"] for r in rows])
        else:
            h = np.frombuffer(b"".join(r["a"] for r in rows), np.uint64)
            word, back = np.unique(h, return_inverse=True)
            sizes = np.array([len(r["a"]) // 8 for r in rows])
            total = np.bincount(back, np.concatenate([_wide(r["b"], n) for r, n in zip(rows, sizes)])).astype(np.int64)
            log, known = np.log10(total + FLOOR), total > 0
            for r, n, end in zip(rows, sizes, np.cumsum(sizes)):
                which = np.repeat(back[end - n : end], _wide(r["c"], n))
                doc, times = _wide(r["e"], r["n"]), _wide(r["d"], r["n"])
                sums, counts = np.bincount(doc, times * log[which]), np.bincount(doc, times * known[which]).astype(np.int64)
                some, where = np.unique(doc), None
                if 2 * len(some) < len(sums):
                    sums, counts, where = sums[some], counts[some], _narrow(some)
                made.append((SUMS, shard, r["chunk"], sums.tobytes(), _narrow(counts), where, None, len(sums), 0, 0.0, None, None))
            made += filled(WORDS, shard, word, total, back, rows, sizes.tolist())
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)

    return run, "kind int, shard long, chunk long, a binary, b binary, c binary, d binary, n long, v long, z double, ids array<long>, keys array<long>"


def _ordered(table: pa.Table) -> pa.Table:
    """Chunk side: the levels of each document's tokens in order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
    info = next(r for r in rows if r["kind"] == INFO)
    n_tokens, train = _wide(info["a"], info["n"]), np.frombuffer(info["b"], bool)
    ends = np.cumsum(n_tokens)
    words = np.frombuffer(b"".join(r["b"] for r in rows if r["kind"] == WORD_LEVELS), np.uint64)
    back = _places(info["c"], info["d"], len(words))
    c = Chunk(words[back], np.repeat(np.arange(len(n_tokens), dtype=np.int32), n_tokens), train, n_tokens)
    pa.default_memory_pool().release_unused()
    out = []
    for kind, order in ((WORD_LEVELS, back), (PAIR_LEVELS, np.unique(c.pairs()[0] >> np.uint64(16), return_inverse=True)[1])):
        levels = np.frombuffer(b"".join(r["a"] for r in rows if r["kind"] == kind), np.uint8)
        raw = levels[order].tobytes()
        out.append(pa.array([raw[a:b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary()))
    return pa.table({"doc_id": pa.array(info["ids"], pa.int64()), "thash": pa.array(info["keys"], pa.int64()), "train": pa.array(train), "words": out[0], "pairs": out[1]})


LEVELS_OF = "doc_id long, thash long, train boolean, words binary, pairs binary"


class Filter:
    """The broadcast filter: bits of all segments of words or pairs."""

    def __init__(self, bits: int, segments: dict[int, bytes], width: int):
        self.bits, self.width = bits, width
        parts = [segments.get(s, bytes(8)) for s in range(1 << bits)]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.size, self.offset = (8 * sizes).astype(np.uint64), 8 * np.r_[0, np.cumsum(sizes)[:-1]]
        self.raw = b"".join(parts)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each hash: probes level 1, 2, ... until one misses."""
        raw = np.frombuffer(self.raw, np.uint8)
        shard = (h >> np.uint64(self.width - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        size, offset = self.size[shard], self.offset[shard]
        out, at = np.zeros(len(h), np.uint8), np.arange(len(h))
        for q in range(1, LEVELS + 1):
            x = _level_hash(h, q)
            for probe in range(PROBES):
                bit = offset + _positions(x, size, probe)
                hit = np.flatnonzero((raw[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if len(hit) < len(at):
                    at, h, x, size, offset = at[hit], h[hit], x[hit], size[hit], offset[hit]
            if not len(at):
                break
            out[at] = q
        return out


@dataclass
class Evidence:
    """Levels of the words and pairs of some documents' tokens, in order."""

    words: np.ndarray
    pairs: np.ndarray
    n_tokens: np.ndarray


@dataclass
class Model:
    """Everything a worker needs: both filters, the normaliser and the mixing weights by context level."""

    words: Filter | None
    pairs: Filter | None
    z: float
    v: int
    n_docs: int
    weight: np.ndarray | None = None

    def probe(self, c: Chunk) -> Evidence:
        """Looks every distinct word and pair up in the filters once."""
        words, back = np.unique(c.hashes, return_inverse=True)
        pairs, which = np.unique(c.pairs()[0] >> np.uint64(16), return_inverse=True)
        return Evidence(self.words.levels(words)[back], self.pairs.levels(pairs)[which], c.n_tokens)

    def estimates(self, e: Evidence):
        """Per token: count of the word, of the context (with its level) and of the pair, as the levels stand for them."""
        level = np.r_[0, e.words[:-1]].astype(np.int64)
        first = np.cumsum(e.n_tokens) - e.n_tokens
        level[first] = int(level_of(np.array([self.n_docs]))[0]) if self.n_docs else 0
        count, context = VALUE[e.words], VALUE[level]
        return count, context, level, np.minimum(VALUE[e.pairs], np.minimum(count, context))

    def word_probability(self, count):
        return (count + FLOOR) / (self.z + FLOOR * (self.v + 1))

    def histogram(self, e: Evidence) -> np.ndarray:
        """Tokens by context level and ratio of the pair estimate to the word estimate, each token left out of its counts."""
        count, context, level, times = self.estimates(e)
        p = self.word_probability(np.maximum(count - 1, 0))
        q = np.maximum(times - 1, 0) / np.maximum(context - 1, 1)
        ratio = np.where(q > 0, np.clip(np.floor(np.log2(np.maximum(q, 1e-300) / p)) + 25, 1, RATIO_BINS), 0).astype(np.int64)
        return np.bincount(level * (RATIO_BINS + 1) + ratio, minlength=(LEVELS + 1) * (RATIO_BINS + 1))

    def fit_weights(self, table: np.ndarray) -> None:
        """Expectation maximisation of one weight per context level over the whole histogram."""
        ratio = np.r_[0.0, 2.0 ** (np.arange(1, RATIO_BINS + 1) - 24.5)]
        table = table.reshape(LEVELS + 1, RATIO_BINS + 1)
        w = np.full(LEVELS + 1, 0.5)
        for _ in range(200):
            of_pair = w[:, None] * ratio / (w[:, None] * ratio + 1 - w[:, None])
            w = np.clip(((table * of_pair).sum(axis=1) + 0.1) / (table.sum(axis=1) + 1.0), 1e-6, 0.999)
        w[0] = 0.0
        self.weight = w

    def scores(self, e: Evidence) -> np.ndarray:
        count, context, level, times = self.estimates(e)
        w = self.weight[level]
        p = w * times / np.maximum(context, 1) + (1 - w) * self.word_probability(count)
        return np.bincount(np.repeat(np.arange(len(e.n_tokens)), e.n_tokens), np.log10(p), len(e.n_tokens))


def _evidence(words: pa.Array, pairs: pa.Array) -> Evidence:
    w, p = words.to_pylist(), pairs.to_pylist()
    return Evidence(np.frombuffer(b"".join(w), np.uint8), np.frombuffer(b"".join(p), np.uint8), np.array([len(x) for x in w], np.int64))


def lm_scores(docs: DataFrame, train_fold=None, max_filter_mb: int = MAX_FILTER_MB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    train_fold: a boolean column over doc_id, true for rows to learn from; default: crc32 of the id as text, modulo 10, is not 0.
    """
    docs = slim(docs, id_col, text_col)
    spark = docs.sparkSession
    train = fold_of(F.col("doc_id"), 10) != 0 if train_fold is None else F.coalesce(train_fold, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("thash"), train.alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(2, math.ceil(math.log2(size / SHARD_BYTES + 1))))  # 65,536 shards hold 650 GB of text at that size, and grow beyond it

    def count(ask: bool) -> DataFrame:
        reduce, schema = _reduce(bits, ask)
        return materialise(rows.mapInArrow(_pack(bits, ask), PACKED).groupBy("kind", "shard").applyInArrow(reduce, schema), "lm-counts", compression="zstd")

    limit = max_filter_mb << 20
    at_shards = size > TEXT_A_FILTER * limit
    counted = count(at_shards)
    if not at_shards and (counted.where(F.col("kind").isin(WORDS, PAIRS)).agg(F.sum(F.length("a"))).first()[0] or 0) > limit:
        at_shards, counted = True, count(True)
    totals = counted.where(F.col("kind") == WORDS).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("z").alias("z")).first()
    n_tokens, n_words, z = totals["n"] or 0, totals["v"] or 0, totals["z"] or 0.0
    n_docs = counted.where(F.col("kind") == INFO).select(F.sum(F.length(F.translate(F.hex("b"), "0", "")))).first()[0] or 0
    model = Model(None, None, z, n_words, n_docs)
    if not at_shards:
        segments = counted.where(F.col("kind").isin(WORDS, PAIRS)).select("kind", "shard", "a")
        found: dict[int, dict] = {WORDS: {}, PAIRS: {}}
        for r in segments.toLocalIterator():  # max_filter_mb at most
            found[r["kind"]][r["shard"]] = bytes(r["a"])
        model.words, model.pairs = Filter(bits, found.pop(WORDS), 64), Filter(bits, found.pop(PAIRS), 48)
        filled = spark.sparkContext.broadcast(model)

        def probe(batches):
            for ids, keys, c in chunks(batches):
                e = filled.value.probe(c)
                ends = np.cumsum(e.n_tokens).tolist()
                cut = [(a, b) for a, b in zip([0, *ends], ends)]
                w, p = e.words.tobytes(), e.pairs.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(c.train), pa.array([w[a:b] for a, b in cut], pa.binary()), pa.array([p[a:b] for a, b in cut], pa.binary())],
                    ["doc_id", "thash", "train", "words", "pairs"],
                )

        levels = rows.mapInArrow(probe, LEVELS_OF)
    else:
        asked = counted.where(F.col("kind").isin(INFO, WORD_LEVELS, PAIR_LEVELS)).select("kind", "shard", "chunk", "a", "b", "c", "d", "n", "ids", "keys")
        levels = asked.groupBy("chunk").applyInArrow(_ordered, LEVELS_OF)
    # two bytes a token, read twice: to fit the weights, and to score
    if at_shards:
        drop_shuffles(spark)
    probed = materialise(levels, "lm-levels")
    if at_shards:
        drop_shuffles(spark)
    model.words = model.pairs = None
    plain = spark.sparkContext.broadcast(model)

    def tally(batches):
        total = np.zeros((LEVELS + 1) * (RATIO_BINS + 1), np.int64)
        for b in batches:
            total += plain.value.histogram(_evidence(b.column(0), b.column(1)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    table = np.zeros((LEVELS + 1) * (RATIO_BINS + 1))
    for r in probed.where("train").select("words", "pairs").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r["n"]
    model.fit_weights(table)
    weight = model.weight

    def score(batches):
        m = plain.value
        m.weight = weight
        for b in batches:
            e = _evidence(b.column(3), b.column(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(e.n_tokens), pa.array(m.scores(e))], ["doc_id", "thash", "train", "n_tokens", "score"])

    scored = probed.mapInArrow(score, "doc_id long, thash long, train boolean, n_tokens long, score double")
    bottom = math.log10(n_tokens + FLOOR * (n_words + 1))

    def base(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        info = next(r for r in rows if r["kind"] == INFO)
        total, known = np.zeros(info["n"]), np.zeros(info["n"], np.int64)
        for r in rows:
            if r["kind"] == SUMS:
                at = slice(r["n"]) if r["c"] is None else _wide(r["c"], r["n"])
                total[at] += np.frombuffer(r["a"], np.float64)
                known[at] += _wide(r["b"], r["n"])
        tokens = _wide(info["a"], info["n"])
        return pa.table({"doc_id": pa.array(info["ids"], pa.int64()), "thash": pa.array(info["keys"], pa.int64()), "n_known": known, "base_score": total - tokens * bottom})

    sums = counted.where(F.col("kind").isin(INFO, SUMS)).select("kind", "chunk", "a", "b", F.when(F.col("kind") == SUMS, F.col("c")).alias("c"), "n", "ids", "keys")
    based = sums.groupBy("chunk").applyInArrow(base, "doc_id long, thash long, n_known long, base_score double").dropDuplicates(["doc_id", "thash"])
    joined = scored.alias("s").join(based.alias("b"), (F.col("s.thash") == F.col("b.thash")) & F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return joined.select(
        "s.doc_id", F.expr("not s.train").alias("held_out"),
        "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
