import random

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from sourcelode.llm import sentencepiece_codec as s

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(11)
    out = ["", " ", "a", "  a  b ", "\n", "a\n\n b", "日本語 テキスト", "🙂🙂 x", "\0", "a\tb\r\n", "▁ a▁▁b", "x" * 3000, "ab" * 500, "aaaaaaa aaaa", "<s> </s> <0x0A> <unk>"]
    out += [" " * n + "end" for n in range(40)] + ["a" + " " * n for n in (14, 15, 16, 17, 33, 100)]
    for n in (1, 2, 3, 5, 10, 50, 400):
        for alphabet in ("ab ", "etaoin shrdlu", "the and ing ér ß\n", "01 .,-'\"", "aé日🙂 \t"):
            out += ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(12)]
    return out


def test_ids_equal_the_library():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), s.Codec(PATH)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for t in [*texts(), *docs]:
        assert codec.encode(t).tolist() == sp.encode(t), t[:200]
        assert codec.decode(codec.encode(t).tolist()) == t.replace(s.MARK, " ")


def test_suffix_ranges_find_every_occurrence():
    import numpy as np

    raw = b"abracadabra abracadabra-abracadabra\xff" * 3
    pieces = [(b"a", 1), (b"abra", 2), (b"abracadabra", 3), (b"abracadabra abracadabra", 4), (b"zz", 5), (b"bracadabr", 6)]
    at, size, number = s.suffix_ranges(np.frombuffer(raw, np.uint8), s.PieceIndex(pieces))
    want = sorted((i, len(p), k) for p, k in pieces for i in range(len(raw)) if raw.startswith(p, i))
    assert sorted(zip(at.tolist(), size.tolist(), number.tolist())) == want


def test_dataframe_encode_and_decode(spark):
    rows = [(i, t, 1) for i, t in enumerate([None, *texts()])] + [(None, "null id", 2), (3, "copy", 2), (3, "copy", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    enc = s.encode(docs, PATH, cache_size=50).cache()
    got = sorted((str(r.doc_id), r.ids, r.n_pieces, r.round_trip) for r in enc.collect())
    assert got == sorted((str(i), x := sp.encode(t or ""), len(x), s.MARK not in (t or "")) for i, t, _ in rows)
    back = sorted((str(r.doc_id), r.text) for r in s.decode(enc, PATH).collect())
    assert back == sorted((str(i), (t or "").replace(s.MARK, " ")) for i, t, _ in rows)
    assert s.encode(docs.limit(0), PATH).count() == 0
