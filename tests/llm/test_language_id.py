"""Language identification: gradients against differences, held-out accuracy, awkward rows."""

import zlib

import numpy as np

from spectrafold.llm import language_id


def _loss(model, segments, label):
    found = model.run(np.stack([segments.T, segments.T[::-1]]))
    p = model.probabilities(found[:, 0], found[::-1, 1])
    return -np.log(p[:, label, np.arange(len(label))]).mean()


def test_gradients():
    draw = np.random.default_rng(3)
    segments, label = draw.integers(97, 105, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    model = language_id.Network(["a", "b", "c"])
    for weights, gradient in zip(model.weights, model.step(segments, label)):
        for at in np.argsort(-np.abs(gradient), None)[:3]:
            at = np.unravel_index(at, gradient.shape)
            was = weights[at]
            weights[at] = was + 0.01
            more = _loss(model, segments, label)
            weights[at] = was - 0.01
            less = _loss(model, segments, label)
            weights[at] = was
            assert abs((more - less) / 0.02 - gradient[at]) < 0.01 * abs(gradient[at]) + 1e-4


def test_segments_of_any_length():
    # Each segment alone gives what it gives beside longer ones, and the mean over a text is over its bytes.
    model, text = language_id.Network(["a", "b"]), bytes(range(97, 123)) * 11
    whole = model.predict([b"short", text, b"x", text[:128]])
    for k, t in enumerate([b"short", text, b"x", text[:128]]):
        total = np.zeros(2)
        for at in range(0, len(t), language_id.SEGMENT):
            s = np.frombuffer(t[at : at + language_id.SEGMENT], np.uint8)[None]
            total += model.sums(s, np.array([s.shape[1]]))[0]
        assert np.allclose(whole[k], total / len(t), atol=1e-5) and abs(whole[k].sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    known = docs.where("lang IS NOT NULL").select("doc_id", "lang").collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in known if found[r["doc_id"]]["held_out"]]
    assert len(right) > 200 and np.mean(right) > 0.97
    # The columns that must not matter don't: the text alone decides.
    other = docs.selectExpr("doc_id", "text", "lang", "'z' AS source")
    again = language_id.identify(other.unionByName(other.selectExpr("doc_id + 1000000 AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source"))).where("doc_id >= 1000000").collect()
    assert all(r["lang_pred"] == found[r["doc_id"] - 1000000]["lang_pred"] for r in again)


def test_awkward_rows(spark):
    texts = [None, "", "12 ,.", "中", "a", "abc " * 40000, "abc", "abc"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(None, "abc", "xx"), (0, None, "xx")], "doc_id long, text string, lang string")
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect())
    # One language alone is certain; texts without letters are unknown.
    assert out == [(-1, "xx", 1.0), (0, "und", 0.0), (0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (3, "xx", 1.0), (4, "xx", 1.0), (5, "xx", 1.0), (6, "xx", 1.0), (7, "xx", 1.0)]
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).collect() == []
