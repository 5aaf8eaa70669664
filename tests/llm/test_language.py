import zlib

import numpy as np

from tessera.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in language.op13_language(spark, sf).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == true.keys() and all(0 <= r.score <= 1 and r.lang_pred in set(true.values()) | {"und"} for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    test = [rows[k].lang_pred == v for k, v in true.items() if rows[k].held_out]
    assert len(test) > 200 and np.mean(test) > 0.97
    assert np.mean([r.rejected for r in rows.values()]) < 0.03


def test_learns_from_the_given_rows_only(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    usable = docs.where(~language.held_out(docs.doc_id))
    model = language.train(usable)
    other = language.train(usable.union(docs.where(language.held_out(docs.doc_id)).selectExpr("doc_id", "text", "cast(null as string)", "source", "n_chars")))
    assert model.languages == other.languages and (model.centroids == other.centroids).all()
    # The prediction is of the text alone.
    texts = [r.text for r in docs.limit(20).collect()]
    alone = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.lang_pred for r in language.identified(alone, model).collect()) == sorted(model.predict(texts)[0])


def test_pieces_count_like_the_whole(monkeypatch):
    text = "Être ou  ne pas, x1y élan"
    whole = language.counts([text])[0]
    for size in (1, 2, 5, 24):
        monkeypatch.setattr(language, "PIECE", size)
        assert (language.counts([text])[0] == whole).all()
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    grams = [c for c in padded if c != " "] + [padded[i : i + 2] for i in range(len(padded) - 1) if padded[i : i + 2] != "  "] + [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]
    assert whole.sum() == len(grams) and (whole > 0).sum() <= len(set(grams))


def test_clusters_per_language():
    rng = np.random.default_rng(0)
    rows = np.zeros((60, language.DIMENSION), np.float32)
    for i in range(60):  # three kinds of text in one language, one in the other
        rows[i, 100 * (i % 4) : 100 * (i % 4) + 20] = rng.integers(5, 9, 20)
    model = language.fit(rows, ["a" if i % 4 else "b" for i in range(60)])
    x = language.weighted(rows, model.idf)
    assert [model.languages[k] for k in (x @ model.centroids.T).argmax(1)] == ["a" if i % 4 else "b" for i in range(60)]
    assert model.languages.count("a") >= 3 and (1 - (x @ model.centroids.T).max(1) <= model.radii.max()).all()


def test_rejects_what_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    names, score, rejected = model.predict(["щщщ жжж ъъъ ффф", "中文语言学", "qqzx xzqq zzxq " * 20])
    assert rejected.all() and (score < 0.5).all() and set(names) <= set(model.languages)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "la maison", "fr", ""), (2, "the house", "en", ""), (2, "the house", "en", ""), (3, None, "en", ""), (4, "12 + 3", "xx", ""), (5, "", None, ""), (None, "das haus", "de", ""), (6, "le mur", None, ""), (7, "the wall " * 90_000, "en", "")]
    docs = spark.createDataFrame(rows, schema)
    model = language.train(docs)
    assert sorted(set(model.languages)) == ["de", "en", "fr"]
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in language.identified(docs, model).collect())
    assert got == [("1", "fr", True), ("2", "en", True), ("2", "en", True), ("3", "und", False), ("4", "und", False), ("5", "und", False), ("6", "fr", True), ("7", "en", True), ("None", "de", True)]
    assert language.identified(docs.limit(0), model).count() == 0
    blank = language.train(docs.limit(0))
    assert {(r.lang_pred, r.score, r.rejected) for r in language.identified(docs, blank).collect()} == {("und", 0.0, False)}
