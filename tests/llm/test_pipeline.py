import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm import test_decontamination, test_minhash_dedup, test_phrase_dedup, test_run_length_dedup
from tests.llm.common import DOC_SCHEMA, awkward, shared
from tests.llm.test_classifiers import corpus

LENGTHS = "\x20\x09-\x0d"


def tables(spark, path):
    rows, labels = corpus(150)
    leaked, items = test_decontamination.corpus(3, 0.05)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(shared(61, 60))] + [(2000 + i, r[1], "en", "s", 1) for i, r in enumerate(leaked)]
    rows += [(3000 + i, *r[1:]) for i, r in enumerate(awkward()) if r[1] is None or len(r[1]) < 1000]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC_SCHEMA + ", kept int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_each_stage_equals_brute_force(spark, tmp_path):
    items = tables(spark, str(tmp_path))
    docs, rows = pipeline.documents(spark, str(tmp_path)), None
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)))
        got, before = sorted(map(tuple, docs.collect()), key=str), rows
        if name == "quality classifier":
            assert 0 < len(got) and {r[0] for r in got} >= set(range(2000, 2060))
        if name == "near-duplicates":
            kept = {(r[0], r[1]) for r, (i, _, c, k) in zip(before, test_minhash_dedup.brute(before), strict=True) if k}
            assert len(got) < len(before) and sorted({r[:2] for r in got}, key=str) == sorted(kept, key=str)
            assert len([r for r in got if r[1] is not None]) == len({r[:2] for r in got if r[1] is not None})
        if name == "repeated strings":
            raw, want = [(r[1] or "").encode() for r in before], []
            for r, t, gone in zip(before, raw, test_run_length_dedup.covered(raw, 240), strict=True):
                left = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
                if not gone.any():
                    want.append(r)
                elif test_phrase_dedup.WORD.search(left):
                    want.append((*r[:1], left, *r[2:4], len(left)))
            assert got == sorted(want, key=str) and len(set(want) - set(before)) > 5
        if name == "benchmark leaks":
            bad = {r[:2] for r in before if test_decontamination.leaks(items, r[1])}
            assert len(bad) > 3 and sorted((r for r in before if r[:2] not in bad), key=str) == got
        if name == "bpe round trip":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in before)
        else:
            assert tuple(docs.columns) == pipeline.COLUMNS
        rows = got
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()), key=str) == rows


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA + ", key int, chars string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_a_long_text(spark, tmp_path):
    text = " ".join(f"v{i * 48_271 % 2_147_483_647}" for i in range(400_000))
    rows = [(1, text, "en", "s", len(text)), (2, "a few words that stay as they are", "en", "s", 33)]
    clash = "key, row_key, chars, bad, id, nth, kept, score, no_text, item_id, copies, starts, t1".split(", ")
    docs = spark.createDataFrame([(*r, *([1] * len(clash))) for r in rows], DOC_SCHEMA + "".join(f", {c} int" for c in clash))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "another line that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) for r in rows}
