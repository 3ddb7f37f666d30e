import random
import sys
from pathlib import Path

import public_tokenizers
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
import test_mixing  # noqa: E402
import test_quality_rules  # noqa: E402
import test_simhash  # noqa: E402

import corpus_pipeline  # noqa: E402
from sourcelode.llm import mixing, quality_rules, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rnd = random.Random(12)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(400)] + ["the", "of", "and", "to"] * 60
    rows = []
    for i in range(160):
        text = " ".join(rnd.choices(words, k=rnd.randrange(60, 200)))
        if i % 5 == 0:
            text += " you pathetic moron and frobber you"
        if i % 11 == 0:
            text = " ".join(f"{w}***" for w in text.split()[:40])
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    rows += [[200 + i, rows[i][1] + (" extra" if i % 2 else ""), "en", "s0", 1] for i in range(0, 40)]
    return rows + [[None, rows[6][1], None, None, None], [300, None, None, None, None], [301, "", "en", "s1", 0], rows[7], [None, " ".join(rnd.choices(words, k=90)), None, None, 3]]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = _documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    text = lambda df: sorted(map(str, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())))

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, str(tmp_path)).cache()
        assert out.schema.simpleString() == docs.schema.simpleString()
        kept = [tuple(r) for r in before.collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect() if r.predicted}
            want = [r for r in kept if r[0] not in bad]
            assert 20 < len(kept) - len(want) < 60
        elif name == "quality_rules":
            want = []
            for r in kept:
                n, _, symbols, _, _, failed = test_quality_rules.brute(r[1])
                if not failed and symbols < 0.2 * n:
                    want.append(r)
            assert len(want) < len(kept)
        elif name == "simhash_near_dedup":
            order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
            roots = test_simhash.brute_components([test_simhash.brute_fp(r[1]) for r in order])
            want = [order[i] for i in sorted(set(roots))]
            assert len(want) < len(kept)
        else:
            drawn = test_mixing.brute([(r[0], r[1], r[3]) for r in kept], mixing.Mix())
            want = [next(r for r in kept if (-1 if r[0] is None else r[0]) == d) for d, *_ in drawn]
        assert text(out) == sorted(map(str, want)), name
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    want = sorted((str(r.doc_id), sp.encode(r.text)) for r in out.collect())
    assert sorted((str(r.doc_id), r.ids) for r in last) == want and all(r.round_trip for r in last)
    assert sorted((str(r.doc_id), r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_native_stage_plans(spark):
    docs = spark.createDataFrame(_documents(), SCHEMA)
    for df in (quality_rules.keep_good(docs), mixing.mixed_rows(docs)):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
