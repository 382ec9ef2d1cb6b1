import random

from kinweave.llm import toxicity
from test_toxicity import corpus


def test_a_clean_text_of_any_length_is_clean():
    rows = corpus(1500)
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows], toxicity.ToxicityParams())
    rng = random.Random(3)
    plain = [w for w in ("w%d" % i for i in range(500)) if not any(f in model.weights for f in toxicity.features(w.encode()))]
    text = ". ".join(" ".join(rng.choice(plain) for _ in range(5)) for _ in range(50_000))
    assert model.score(text)[0] < 0.05
    probability, worst, over = model.score(text + ". so vile, so grubby")
    assert probability >= toxicity.THRESHOLD and worst == 50_000 and over == 1
    assert toxicity.fit([], [], toxicity.ToxicityParams()).score("fine. " * 100_000)[0] < 0.01


def test_an_over_long_text_is_skipped_alone(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, "w1 " * 100_000) for i in range(1000, 1040)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(i, 0) for i in range(1000, 1040)], "doc_id long, toxic int")
    params = toxicity.ToxicityParams(max_bytes=290_000)
    alone = toxicity.train(docs.where("doc_id < 1000"), labels.where("doc_id < 1000"), params)
    assert alone.weights and toxicity.train(docs, labels, params) == alone
