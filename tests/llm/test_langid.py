import zlib

import numpy as np
from pyspark.sql import functions as F

from keyweave.llm import langid
from tests.llm.conftest import DOCUMENT, ODD, with_extra


def test_held_out_accuracy(documents, document_rows):
    made = {r.doc_id: r for r in langid.identify(documents).collect()}
    assert len(made) == len(document_rows)
    held = [r for r in document_rows if made[r.doc_id].held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in document_rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([made[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in made.values())


def test_only_text_counts(documents, document_rows):
    """Languages and keys of the held-out fold change nothing."""
    changed = documents.withColumn("lang", F.when(langid.remainder("doc_id") == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    rows = lambda df: sorted(tuple(r) for r in langid.identify(df).collect())
    assert rows(changed) == rows(documents)


def test_odd_rows(spark, odd, no_documents):
    made = langid.identify(odd)
    assert made.columns == ["doc_id", "held_out", "lang_pred", "score"] and made.count() == len(ODD)
    unknown = {r.doc_id for r in made.where("lang_pred = 'und'").collect()}
    assert unknown == {1, 2, 3, 5, None} and made.where("doc_id is null").count() == 2
    assert made.where("doc_id is null and held_out").count() == 0
    assert langid.identify(no_documents).count() == langid.keep_identified(no_documents).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3, 5)").count() == 0
    nothing_known = with_extra(spark.createDataFrame([(1, "some words", None, "a", 1)], DOCUMENT))
    assert tuple(langid.identify(nothing_known).first())[2:] == ("und", 0.0)


def test_contradicted_language_goes(documents, document_rows):
    swapped = (langid.remainder("doc_id") == 2) & (F.col("lang") == "en")
    wrong = documents.withColumn("lang", F.when(swapped, "fr").otherwise(F.col("lang")))
    relabelled = {r.doc_id for r in document_rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang == "en"}
    kept = {r.doc_id for r in langid.keep_identified(wrong).collect()}
    assert relabelled and len(relabelled & kept) <= len(relabelled) // 4
    assert len(kept - relabelled) >= len(document_rows) - len(relabelled) - 1


def test_batches_and_kernel_products_agree(document_rows):
    """The product with the landmarks' weighted sum is the kernel expansion over the landmarks."""
    texts = [r.text for r in document_rows[:80]]
    places = [langid._places(t) for t in texts]
    bits = np.zeros((80, langid.OFFSETS[-1]), np.uint8)
    for i, p in enumerate(places):
        bits[i, p] = 1
    langs = [r.lang for r in document_rows[:80]]
    model = langid.solve(bits, langs, landmarks=30)
    names, scores = model.score(texts)
    assert np.mean([a == b for a, b in zip(names, langs)]) > 0.9
    one_by_one = [model.score([t]) for t in texts]
    assert names == [n[0] for n, _ in one_by_one] and np.allclose(scores, [s[0] for _, s in one_by_one], atol=1e-5)
    sets = [set(p.tolist()) for p in places]
    kernel = lambda a, b: sum(len(x & y) / np.sqrt(len(x) * len(y)) for lo, hi in zip(langid.OFFSETS, langid.OFFSETS[1:]) for x, y in [({v for v in a if lo <= v < hi}, {v for v in b if lo <= v < hi})]) / 3
    x = langid._scaled(bits[:6].astype(np.float32))
    assert np.allclose(x @ x.T, [[kernel(a, b) for b in sets[:6]] for a in sets[:6]], atol=1e-5)


def plain_grams(text):
    """Sets of character n-grams of length 1 to 3; letters in lower case, other runs and both ends one space."""
    kept = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in kept:
        kept = kept.replace("  ", " ")
    return [{kept[i : i + n] for i in range(len(kept) - n + 1)} for n in (1, 2, 3)]


def test_against_a_plain_kernel_ridge(document_rows):
    """Predictions of kernel ridge regression written out with sets of n-grams, unhashed, with all training texts as landmarks."""
    rows = [r for r in document_rows if r.text and any(c.isalpha() for c in r.text)]
    train, tested = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:100], [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2][:40]
    grams = {r.doc_id: plain_grams(r.text) for r in train + tested}
    kernel = lambda a, b: sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(grams[a.doc_id], grams[b.doc_id])) / 3
    names = sorted({r.lang for r in train})
    y = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in train])
    inner = np.array([[kernel(a, b) for b in train] for a in train])
    alpha = np.linalg.solve(inner + langid.RIDGE * len(train) * np.eye(len(train)), y)
    outputs = np.array([[kernel(a, b) for b in train] for a in tested]) @ alpha
    bits = np.zeros((len(train), langid.OFFSETS[-1]), np.uint8)
    for i, r in enumerate(train):
        bits[i, langid._places(r.text)] = 1
    model = langid.solve(bits, [r.lang for r in train], landmarks=len(train))
    got, scores = model.score([r.text for r in tested])
    assert got == [names[i] for i in outputs.argmax(axis=1)]
    assert np.abs(scores - np.clip((1 + outputs.max(axis=1)) / 2, 0, 1)).max() < 0.05  # hashing lets a few n-grams meet


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    df = spark.createDataFrame([(i, f"word{i} some text", f"l{i % 6 if i < 60 else i % 2}") for i in range(200)], "doc_id long, text string, lang string")
    assert langid.fit(df).langs == ("l0", "l1", "l2")


def test_hot_language_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 4900, "en").otherwise("fr").alias("lang"))
    model = langid.fit(df)
    assert model.langs == ("en", "fr")
