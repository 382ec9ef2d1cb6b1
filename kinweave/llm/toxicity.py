"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the document's label is known. A sentence's probability is
a logistic function of its words; the document's is their noisy-or, 1 - prod(1 - p). Weights are fitted
to document labels through the noisy-or, so that they settle on the words of the offending sentences,
which scoring then points out. Scoring with a fitted model gives a document the probability of one neutral
sentence, and a sentence adds what its words raise it above that, so that neutral sentences add nothing however
many they are. In fitting they count in full: that is what draws the bias down, and weights are surer for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.durable import durable
from kinweave.llm.words import slices

THRESHOLD = 0.3
#: Sentence ends become line ends, other punctuation spaces, A-Z lower case.
_FOLD = bytearray(range(256))
for _c in b".!?;\r":
    _FOLD[_c] = ord("\n")
for _c in b",:\"'()[]{}<>*#$%&|/\\_-+=~`^@\t\x0b\x0c":
    _FOLD[_c] = ord(" ")
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32
FOLD = bytes(_FOLD)


@dataclass(frozen=True)
class ToxicityParams:
    """max_documents, max_bytes: bounds of the labelled sample that is fitted; min_documents: that a feature
    must occur in; min_z, min_phi: of its association with the label (the correlation, times the square root
    of the number of documents and as it is); max_features: features with weights."""

    max_documents: int = 6000
    max_bytes: int = 64 << 20
    min_documents: int = 3
    min_z: float = 2.5
    min_phi: float = 0.07
    max_features: int = 4096
    steps: int = 300
    rate: float = 0.1
    l1: float = 2e-3


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    return [w for w in (s.split() for s in (text or "").encode().translate(FOLD).split(b"\n")) if w]


def features(word: bytes) -> set[bytes]:
    """A word and its proper beginnings of three to nine characters, marked by a hyphen."""
    text = word.decode(errors="replace")
    return {word, *(text[:n].encode() + b"-" for n in range(3, 10) if len(text) > n)}


class _Sums(dict):
    """Summed weights of recent words; starts anew when full."""

    def __init__(self, weights: dict):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        total = self[word] = sum(self.weights.get(f, 0.0) for f in features(word)) if self.weights else 0.0
        return total


@dataclass(frozen=True)
class Model:
    """Weights of words and beginnings (bytes), and the bias of a sentence. above: a sentence adds only what lies
    above a neutral one, and one neutral sentence counts for the document; else each counts in full."""

    weights: dict
    bias: float
    above: bool = False

    def summed(self) -> _Sums:
        return _Sums(self.weights)

    def score(self, text: str | None, sums: _Sums | None = None) -> tuple[float, int, int]:
        """(probability of the document, its most offending sentence or -1, number of sentences more likely than not)."""
        get, total, worst, best, over = (sums if sums is not None else self.summed()).__getitem__, 0.0, -1, 0.0, 0
        base = float(np.logaddexp(0.0, self.bias))
        for k, words in enumerate(sentences(text)):
            if self.above and not k:
                total = base
            s = sum(map(get, sorted(set(words))))
            if s:
                own = float(np.logaddexp(0.0, s + self.bias))
                total += max(0.0, own - base) if self.above else own
                if s > best:
                    worst, best = k, s
                over += s + self.bias > 0
            elif not self.above:
                total += base
        return -float(np.expm1(-total)), worst, over


def fit(texts: list[str], labels: list[int], params: ToxicityParams) -> Model:
    """Fits the noisy-or of sentence probabilities to document labels by gradient descent, with soft thresholding."""
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return Model({}, -20.0, True)
    bags = [sentences(t) for t in texts]
    seen: dict[bytes, list[int]] = {}
    for own, label in zip(bags, labels, strict=True):
        for w in {f for w in {w for s in own for w in s} for f in features(w)}:
            c = seen.setdefault(w, [0, 0])
            c[0] += 1
            c[1] += label
    share = y.mean()
    z = {
        w: (pos - n * share) / np.sqrt(n * share * (1 - share))
        for w, (n, pos) in seen.items()
        if n >= params.min_documents
    }
    least = max(params.min_z, params.min_phi * len(y) ** 0.5)
    chosen = sorted((w for w in z if z[w] >= least), key=lambda w: (-z[w], w))[: params.max_features]
    index = {w: k for k, w in enumerate(chosen)}
    sentence, feature, doc = [], [], []
    for d, own in enumerate(bags):
        for s in own:
            hit = [index[f] for w in set(s) for f in features(w) if f in index]
            sentence += [len(doc)] * len(hit)
            feature += hit
            doc.append(d)
    sentence, feature, doc = (np.array(x, np.int64) for x in (sentence, feature, doc))
    w, b = np.zeros(len(chosen)), -6.0
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, params.steps + 1):
        s = b + np.bincount(sentence, w[feature], len(doc))
        total = np.bincount(doc, np.logaddexp(0.0, s), len(y))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        g = pull[doc] / (1 + np.exp(-s)) / len(y)
        grad = np.append(np.bincount(feature, g[sentence], len(chosen)), g.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = params.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w = w - move[:-1]
        w = np.maximum(np.abs(w) - params.rate * params.l1, 0) * np.sign(w)
        b = min(b - move[-1], -4.0)
    return Model({c: float(x) for c, x in zip(chosen, w, strict=True) if abs(x) > 0.05}, float(b), True)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> Model:
    """Fits a model on a bounded sample of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` mark.

    Rows whose crc32(doc_id as text) mod 4 is 2 are left out. The sample is the first rows by hash of
    doc_id, up to the bounds of ``params``; a document that would pass max_bytes is skipped, the next ones are not.
    Null labels and texts are left out. Raises ValueError if there are labelled texts and none of them fits; without any, or
    with labels of one kind only, the model calls nothing toxic.
    """
    params = params or ToxicityParams()
    crc = F.crc32(F.col("id").cast("string")) % 4
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where(F.col("toxic").isNotNull() & (crc != 2))
    chosen = durable(
        known.groupBy("id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(params.max_documents)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("text").isNotNull())
    sample = durable(texts.join(chosen, "id").select("id", "label", "text"))
    sizes = sample.groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).orderBy(F.xxhash64("id"), "id").collect()
    keep, held = [], 0
    for r in sizes:
        if held + r.n <= params.max_bytes:
            keep.append(r.id)
            held += r.n
    if sizes and not keep:
        raise ValueError(f"every labelled text is longer than max_bytes, {params.max_bytes}")
    known = docs.sparkSession.createDataFrame([(i,) for i in keep], "id long")
    few = sample if len(keep) == len(sizes) else sample.join(known, "id", "left_semi")
    rows = sorted(few.collect(), key=lambda r: (r.id, r.text))
    return fit([r.text for r in rows], [r.label for r in rows], params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, worst_sentence, n_offending.

    Null and empty texts have no sentence and score 0. worst_sentence counts the document's sentences with
    words from 0; -1 where no word has weight. A null doc_id is not held out.
    """

    def run(batches):
        sums = model.summed()
        for batch in slices(batches):
            found = [model.score(t, sums) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "score": pa.array([x[0] for x in found], pa.float64()),
                "worst_sentence": pa.array([x[1] for x in found], pa.int32()), "n_offending": pa.array([x[2] for x in found], pa.int32()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double, worst_sentence int, n_offending int")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "worst_sentence",
        "n_offending",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged.

    Null and empty texts stay; texts of any length are scored whole, a few MB at a time; repeated rows are judged alike.
    """
    model = train(docs, labels, params)

    def run(batches):
        sums = model.summed()
        for batch in batches:
            texts = pa.record_batch({"text": batch.column(batch.schema.get_field_index("text"))})
            mild = [model.score(t, sums)[0] < THRESHOLD for part in slices([texts]) for t in part.column("text").to_pylist()]
            yield batch.filter(pa.array(mild, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_mil_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
