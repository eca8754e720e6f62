from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm import langid
from tests.llm.helpers import docs, prose

SAMPLES = {"en": "the cat and the dog went to the river with all of their friends and this was what they thought about it",
           "de": "der hund und die katze gingen mit allen ihren freunden zum fluß und das war was sie darüber dachten",
           "fr": "le chat et le chien sont allés à la rivière avec tous leurs amis et voilà ce qu'ils en pensaient"}


def grams(text):
    points = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    points = " ".join(points.split())
    points = f" {points} " if points else ""
    c = Counter()
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            g = points[i:i + n]
            if g != " ":
                c[g] += 1
    return c


def code(g):
    v = 0
    for ch in g:
        v = (v << 21) | ord(ch)
    return v


def ranked(c, top):
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][:top]


def nearest(text, profiles, top):
    mine = ranked(grams(text), top)
    if not mine or not profiles:
        return "und", 0.0
    best = min((sum(abs(i - p[g]) if g in p else top for i, g in enumerate(mine)), name) for name, p in profiles.items())
    return best[1], 1 - best[0] / (len(mine) * top)


ROWS = [(i * 10 + j, " ".join(s.split()[j:j + 9]), lang) for i, (lang, s) in enumerate(SAMPLES.items()) for j in range(8)] + [
    (100, None, "en"), (101, "", "de"), (102, "12 34 !!", "fr"), (103, "Le CHAT", None), (104, "日本語のテキスト 👍 Ünï", "ja"), (None, "the dog", "en"),
    (0, "the dog again", "en"), (105, "cat " * 30_000 + "fluß", "en"), (106, "a\x00b İ ΣΑΣ", "x")]


@pytest.mark.parametrize("top", [5, 400])
def test_profiles_and_predictions_equal_the_definition(spark, top):
    d = docs(spark, ROWS).repartition(3)
    profiles = langid.learn_profiles(d, top=top)
    want = {}
    for _, text, lang in ROWS:
        if text is not None and lang is not None:
            want.setdefault(lang, Counter()).update(grams(text))
    want = {lang: {g: i for i, g in enumerate(ranked(c, top))} for lang, c in want.items() if c}
    got = {}
    for r in profiles.collect():
        got.setdefault(r.lang, {})[r.gram] = r.rank
    assert got == {lang: {code(g): i for g, i in p.items()} for lang, p in want.items()}
    out = langid.identify(d, profiles, keep={"doc_id": F.col("doc_id"), "text": F.col("text")}, top=top).collect()
    assert len(out) == len(ROWS)
    for r in out:
        lang, score = nearest(r.text or "", want, top)
        assert (r.lang_pred, pytest.approx(r.score)) == (lang, score), r.doc_id


def test_more_languages_than_a_band(spark, monkeypatch):
    monkeypatch.setattr(langid, "BAND", 2)
    d = docs(spark, ROWS)
    profiles = langid.learn_profiles(d)
    banded = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(d, profiles, keep={"doc_id": F.col("doc_id")}).collect()}
    monkeypatch.setattr(langid, "BAND", 512)
    assert banded == {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(d, profiles, keep={"doc_id": F.col("doc_id")}).collect()}


def test_nothing_learned_and_empty(spark):
    d = docs(spark, [(1, "some text")])
    none = langid.learn_profiles(d)
    assert [(r.lang_pred, r.score) for r in langid.identify(d, none, keep={"doc_id": F.col("doc_id")}).collect()] == [("und", 0.0)]
    assert langid.identify(docs(spark, []), none, keep={"doc_id": F.col("doc_id")}).count() == 0


def test_held_out_accuracy(spark):
    from panelcast.llm.queries import op10_language_id

    sf = "/root/testdata/sf0.01"
    j = op10_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n = j.count()
    assert n > 100 and j.where("lang = lang_pred").count() >= 0.97 * n
