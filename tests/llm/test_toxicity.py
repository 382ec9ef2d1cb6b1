import random
import zlib

from kinweave.llm import toxicity

BAD = ["vile", "scorn", "grubby"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        lines = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 25))]
        place = rng.randrange(len(lines))
        if toxic:
            lines[place].insert(1, rng.choice(BAD).title() + rng.choice(["", "x", "yz"]) + ",")
        rows.append((i, ". ".join(" ".join(x) for x in lines), toxic, place))
    return rows


def test_held_out_accuracy_and_place(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] + ("x",) for r in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "vile vile", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3
    for i, _, toxic, place in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(got[i].score >= 0.3)
        if toxic and got[i].predicted:
            assert got[i].worst_sentence == place
    held = [(got[i].predicted, toxic) for i, _, toxic, _ in rows if got[i].held_out]
    assert sum(p != t for p, t in held) <= 0.01 * len(held)
    assert got[9000].score == got[9001].score == 0 and not got[None].held_out
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_noisy_or_by_hand():
    model = toxicity.Model({b"bad": 3.0}, -2.0)
    p = lambda s: 1 / (1 + 2.718281828459045**-s)
    score, worst, over = model.score("fine. Bad thing! fine")
    assert abs(score - (1 - (1 - p(-2)) ** 2 * (1 - p(1)))) < 1e-9 and (worst, over) == (1, 1)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 1
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
