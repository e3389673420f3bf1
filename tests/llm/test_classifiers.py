import random
import zlib

import numpy as np

from tests.llm.common import DOC_SCHEMA, awkward, frame, shared
from tidepool.llm import language_id, ngrams, quality_classifier, quality_rules, queries
from tidepool.llm.textbuf import text_buffers


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    syllables = {"en": "the th ing on er and".split(), "fr": "eau le é oi ai ment".split(), "de": "sch ung ein ß ver keit".split(), "es": "ción ñ lla os ar ja".split()}
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 80))]
        good = rnd.random() < 0.7
        if not good:
            words = [w + rnd.choice(["###", "$$$", "%%%"]) for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words), lang, None, None))
        labels.append((i, int(good), 0))
    return rows, labels


def test_sums_equal_brute_force():
    import pyarrow as pa

    texts = ["", "abc", "Abc abc\nabc é", None, "a", "xy"]
    data, offsets = text_buffers(pa.array(texts))
    buckets = ngrams.Buckets((2, 3), 8, words=True)
    weights = np.random.default_rng(0).normal(size=(buckets.total, 2))
    total, count = buckets.sums(data, offsets, weights)
    for d, text in enumerate(texts):
        raw = text or ""
        words = raw.split()
        assert count[d] == max(0, len(raw) - 1) + max(0, len(raw) - 2) + 2 * len(words)
        at, times = buckets.sparse(*text_buffers(pa.array([text])))[0]
        share = times / max(1, times.sum())
        np.testing.assert_allclose((share[:, None] * weights[at]).sum(axis=0) * count[d] if len(at) else 0, total[d], atol=1e-5)


def test_quality_held_out(spark, tmp_path):
    rows, labels = corpus(1500)
    rows += [(10_000 + i, *r[1:]) for i, r in enumerate(awkward()) if r[0] is not None] + [(None, "x", None, None, None)]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op6_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_language_held_out(spark, tmp_path):
    rows, _ = corpus(seed=2)
    rows += [(10_000 + i, r[1], *r[2:]) for i, r in enumerate(awkward()) if r[0] is not None] + [(20_000, "12 34 --", "en", None, None), (20_001, "ß", None, None, None)]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_language_id(spark, str(tmp_path)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows[:400] if got[i].held_out]) > 0.97
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in (next(x[1] for x in rows if x[0] == i) or ""))) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.quality_scores(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert quality_classifier.quality_scores(frame(spark, []), quality_classifier.train(docs, none)).count() == 0
    silent = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.language_id(silent, language_id.train(silent)).collect()} == {"und"}
    one = frame(spark, [r for r in shared(3, 5)]).drop("lang").selectExpr("*", "'xx' lang")
    assert {r.lang_pred for r in language_id.language_id(one, language_id.train(one)).collect()} == {"xx"}


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 7):
        code = language_id.codewords(n)
        trust = rng.uniform(0.1, 2, code.shape[1])
        model = language_id.Codes([f"l{i}" for i in range(n)], code, np.zeros((1, 1)), np.zeros(1), trust)
        margins = rng.normal(0, 3, (50, code.shape[1]))
        best, score, lead = model.decode(margins)
        for row, b, s, far in zip(margins, best, score, lead, strict=True):
            loss = [sum(t * np.log(1 + np.exp(-m * c)) for m, c, t in zip(row, word, trust, strict=True)) for word in code]
            ordered = sorted(loss)
            assert loss[b] == min(loss) and np.isclose(s, np.exp(-loss[b]) / sum(np.exp(-x) for x in loss))
            assert n == 1 and np.isinf(far) or n > 1 and np.isclose(far, ordered[1] - ordered[0])


def test_scores_equal_the_network():
    """Scoring by one number a bucket gives what averaging the vectors and the layer give."""
    import pyarrow as pa

    rng, buckets = np.random.default_rng(6), quality_classifier.BUCKETS
    vectors, layer, bias = rng.normal(size=(buckets.total, 8)), rng.normal(size=(8, 2)), rng.normal(size=2)
    model = quality_classifier.Embeddings(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))
    texts = ["", "one two two", "é ü 言葉 words", None]
    got = model.score(*text_buffers(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        at, times = buckets.sparse(*text_buffers(pa.array([text])))[0]
        z = (times / max(1, times.sum())) @ vectors[at] @ layer + bias if len(at) else bias
        assert np.isclose(score, np.exp(z[1]) / np.exp(z).sum())


def test_many_languages(spark):
    """Every language can be predicted, also beyond the 200 most frequent."""
    rnd = random.Random(5)
    rows = []
    for k in range(260):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(12)]
        rows += [(4 * k + j, " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(30)), f"l{k:03}", None, None) for j in range(4)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    model = language_id.train(docs)
    assert len(model.languages) == 260
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.9


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_counts_beyond_two_bytes():
    """A long text's shares in training are those of all its n-grams."""
    import pyarrow as pa

    buckets = ngrams.Buckets((1,), 8, words=False)
    texts = ["a" * 300_000 + "b" * 100_000, "ab", ""]
    sample = pa.table(ngrams.sample_columns(buckets, pa.RecordBatch.from_pydict({"text": pa.array(texts)})))
    long, short, empty = (ngrams.Shares(sample, [0, 1, 2])[i] for i in range(3))
    assert sorted(long[1].tolist()) == [0.25, 0.75] and sorted(short[1].tolist()) == [0.5, 0.5]
    assert set(long[0]) == set(short[0]) and len(empty[0]) == len(empty[1]) == 0


def test_a_sample_is_bounded_when_ids_repeat(spark):
    rows = [(i % 3, f"text {i}", "en", None, None) for i in range(300)] + [(7, None, "en", None, None)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    got = quality_rules.labelled_sample(docs, labels, "quality", 8).collect()
    assert sorted((r.doc_id, r.text or "", r.y) for r in got) == [(0, "text 0", 1), (1, "text 1", 1), (2, "text 101", 1), (7, "", 1)]
    two = docs.union(spark.createDataFrame([(i, "mot " * 9, "fr", None, None) for i in range(100, 103)] * 50, DOC_SCHEMA))
    assert language_id.train(two).languages == ["en", "fr"]
