import random

from conftest_llm import documents

from stemma.llm import langid as G


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(6)
    texts, langs = [], []
    for k in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(25)]
        for _ in range(4 if k >= 64 else 6):
            texts.append(" ".join(rng.choice(own) for _ in range(80)))
            langs.append(f"l{k:02}")
    docs = documents(spark, texts, langs=langs)
    model = G.fit(docs)
    assert model.languages == sorted(set(langs))
    assert [r["lang_pred"] for r in G.predict(docs, model).orderBy("doc_id").collect()] == langs
