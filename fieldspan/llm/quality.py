"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import Hasher, texts
from ._work import keep

#: Labelled documents to fit on; rounds; pseudo-labels a view gives in a round; confidence they need.
LABELLED, ROUNDS, GIVEN, SURE = 4000, 4, 200, 0.97
TRIGRAMS, META = 512, 128
#: Costs of losing a good document, where letting a bad one pass costs 1.
COST = 10.0
_SHAPE = 12


def text_view(col: pa.Array) -> np.ndarray:
    """Shares of byte classes, word statistics and hashed byte trigrams of each whole text."""
    out, hasher = np.zeros((len(col), _SHAPE + TRIGRAMS), np.float32), Hasher()
    kind = np.full(256, 6, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[[9, 10, 11, 12, 13, 32]], kind[[44, 46, 39, 45, 63, 58, 59]], kind[128:] = 0, 1, 2, 3, 4, 5
    for first, buf, off in texts(col):
        n, size = len(off) - 1, np.maximum(np.diff(off), 1)
        doc = np.repeat(np.arange(n), np.diff(off))
        s, e, h, wo = hasher.words(buf, off)
        words = np.maximum(np.diff(wo), 1)
        wdoc = np.repeat(np.arange(n), np.diff(wo))
        part = out[first : first + n]
        part[:, :7] = np.bincount(doc * 7 + kind[buf], minlength=7 * n).reshape(n, 7) / size[:, None] if len(buf) else 0
        if len(h):
            part[:, 7] = np.bincount(wdoc, e - s, minlength=n) / words / 10
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
            part[:, 8] = np.bincount(wdoc, same, minlength=n) / words
            key = np.sort((wdoc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            part[:, 9] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / words
            odd = e - s == 1
            part[:, 10] = np.bincount(wdoc, odd & (kind[buf[s]] >= 4), minlength=n) / words
            part[:, 11] = np.bincount(wdoc, kind[buf[e - 1]] == 6, minlength=n) / words
        if len(buf) > 2:
            g = buf[:-2].astype(np.uint64) | (buf[1:-1].astype(np.uint64) << np.uint64(8)) | (buf[2:].astype(np.uint64) << np.uint64(16))
            slot = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
            inside = doc[2:] == doc[:-2]
            hist = np.bincount((doc[:-2] * TRIGRAMS + slot)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
            part[:, _SHAPE:] = np.sqrt(hist / size[:, None])
    return out


def meta_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed language, source and size class of each row; a null is a value of its own."""
    out = np.zeros((len(lang), META), np.float32)
    sizes = [None if x is None else int(np.log2(max(x, 0) + 1)) for x in n_chars.to_pylist()]
    for field, values in enumerate((lang.to_pylist(), source.to_pylist(), sizes)):
        memo: dict[object, int] = {}
        slots = [memo[v] if v in memo else memo.setdefault(v, zlib.crc32(f"{field}:{v!r}".encode()) % META) for v in values]
        out[np.arange(len(slots)), slots] += 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    total = weight.sum()
    rate = 1 / (0.25 * np.linalg.norm(x * np.sqrt(weight / total)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) / total + ridge * np.append(v[:-1], 0)
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class CoTrained:
    """Weights of both views, their calibrations, the weights that join them, and the score below which documents go."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibrate_text: np.ndarray
    calibrate_meta: np.ndarray
    joint: np.ndarray
    threshold: float

    def views(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality by text, by metadata, and by both."""
        a = _line(((t - self.mean) / self.scale) @ self.text[:-1] + self.text[-1], self.calibrate_text)
        b = _line(m @ self.meta[:-1] + self.meta[-1], self.calibrate_meta)
        return _p(a), _p(b), _p(a * self.joint[0] + b * self.joint[1] + self.joint[2])


def _line(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return z * w[0] + w[1]


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, part: np.ndarray, surest: Callable, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views. y: 1 or 0; part: 0 to calibrate the views on, 1 to join them and choose the cut on, else to train on.

    In a round each view labels the unlabelled documents it is surest of, in the proportion of the classes, and the other
    view learns from them as well, at half the weight of given labels. surest(step, model, low, high) gives for each view
    the features and labels of its `low` surest bad and `high` surest good documents of that round.
    None without both labels to train and to calibrate on; parts 0 and 1 stand in for each other if one lacks a label.
    """
    train, sets = part > 1, [part == 0, part == 1]
    both = part <= 1
    if any(len(set(y[x])) < 2 for x in (train, both)):
        return None
    calibrate, choose = (x if len(set(y[x])) == 2 else both for x in sets)
    mean, scale = t[train].mean(0), t[train].std(0) + 1e-3
    split = lambda t, m: ((t - mean) / scale, m)
    views, ridge, share = split(t, m), (1e-3, 1e-2), y[train].mean()
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def fitted() -> CoTrained:
        weights, lines = [], []
        for k, x in enumerate(views):
            more, labels = [g for g, _ in given[k]], [v for _, v in given[k]]
            n = sum(map(len, labels))
            weights.append(fit(np.concatenate([x[train], *more]), np.concatenate([y[train], *labels]), np.repeat([1.0, 0.5], [train.sum(), n]), ridge[k]))
            z = x[calibrate] @ weights[k][:-1] + weights[k][-1]
            lines.append(fit(z[:, None], y[calibrate], np.ones(len(z)), 1e-4))
        return CoTrained(mean, scale, *weights, *lines, np.array([0.5, 0.5, 0.0]), 0.5)

    for step in range(rounds):
        for k, (more_t, more_m, label) in enumerate(surest(step, fitted(), int(GIVEN * (1 - share)), int(GIVEN * share))):
            if len(label):
                given[1 - k].append((split(more_t, more_m)[1 - k], label))
    model = fitted()
    logits = [np.log(p / (1 - p)) for p in model.views(t[choose], m[choose])[:2]]
    model.joint = fit(np.stack(logits, 1), y[choose], np.ones(choose.sum()), 1e-3)
    score = model.views(t[choose], m[choose])[2]
    good = y[choose] == 1
    cuts = np.unique(np.concatenate([[0.0], (np.sort(score)[1:] + np.sort(score)[:-1]) / 2]))
    lost = [(score[good] < c).sum() * COST + (score[~good] >= c).sum() for c in cuts]
    model.threshold = float(cuts[int(np.argmin(lost))])
    return model


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(batch.column("lang"), batch.column("source"), batch.column("n_chars"))


def _features(batches):
    for b in batches:
        rows = [x.tobytes() for x in np.hstack(_views(b))]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "x": pa.array(rows, pa.binary())})


def _gather(docs: DataFrame, ids: DataFrame) -> dict[int, np.ndarray]:
    """Features of the documents of a bounded list of ids, on the driver. Of rows that share an id the least counts."""
    some = docs.join(F.broadcast(ids.select(F.col("doc_id").alias("_id"))), F.col("doc_id") == F.col("_id"))
    some = some.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_r")).select("doc_id", "_r.*")
    got = some.mapInArrow(_features, "doc_id long, x binary").collect()
    return {r.doc_id: np.frombuffer(r.x, np.float32) for r in got}


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = _SHAPE + TRIGRAMS
    return x[:, :cut], x[:, cut:]


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit on at most `labelled` documents with a quality label, the first by a hash of doc_id, and on all without.

    Unlabelled documents are dealt to the rounds by a hash, so that the rounds together look at every one of them: each
    document of the round is scored by both views, and the surest of each view and class are taken (a bounded top-k).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).where("doc_id is not null")
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_l")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    label = keep(label, "quality_labels")
    some = label.join(docs.select("doc_id"), F.col("doc_id") == F.col("_l"), "left_semi").orderBy(F.xxhash64("_l", F.lit(3)), "_l").limit(labelled)
    some = some.select(F.col("_l").alias("doc_id"), "_y", F.pmod(F.xxhash64("_l", F.lit(5)), F.lit(6)).cast("int").alias("_part"))
    known = sorted(some.collect())
    if not known:
        return None
    features = _gather(docs, spark.createDataFrame([(r.doc_id,) for r in known], "doc_id long"))
    x = np.stack([features[r.doc_id] for r in known])

    def surest(step: int, model: CoTrained, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(vars(model))

        def score(batches):
            now = CoTrained(**shared.value)
            for b in batches:
                p = now.views(*_views(b))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "p0": p[0].astype(np.float64), "p1": p[1].astype(np.float64)})

        mine = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds)) == step)
        scored = mine.mapInArrow(score, "doc_id long, p0 double, p1 double")
        scored = keep(scored.where(f"least(p0, p1) <= {1 - SURE} or greatest(p0, p1) >= {SURE}"), "quality_scored")
        scored = scored.join(label.select("_l"), F.col("doc_id") == F.col("_l"), "left_anti").groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
        scored = keep(scored, "quality_unlabelled")
        tie = F.xxhash64("doc_id", F.lit(11))
        top = [
            scored.where(p <= 1 - SURE if not good else p >= SURE).orderBy(p.desc() if good else p, tie, "doc_id").limit(n).select("doc_id", F.lit(k).alias("k"), F.lit(good).alias("good"))
            for k, p in enumerate((F.col("p0"), F.col("p1"))) for good, n in ((0, low), (1, high))
        ]
        picked = sorted((r.k, r.doc_id, r.good) for r in functools.reduce(DataFrame.union, top).collect())
        got = _gather(docs, spark.createDataFrame([(i,) for i in sorted({i for _, i, _ in picked})], "doc_id long")) if picked else {}
        out = []
        for k in (0, 1):
            ids, v = [i for j, i, _ in picked if j == k], [g for j, _, g in picked if j == k]
            out.append((*_halves(np.stack([got[i] for i in ids]) if ids else np.zeros((0, x.shape[1]), np.float32)), np.array(v, np.int64)))
        return out

    return co_train(*_halves(x), np.array([r._y for r in known]), np.array([r._part for r in known]), surest, rounds)


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "quality_view", **sizes: int) -> DataFrame:
    """docs with a struct column `out`: text_score, meta_score, score and keep.

    docs has doc_id, text, lang, source and n_chars; labels has doc_id and quality (0 or 1). Two logistic
    regressions, one of the text's bytes and words, one of language, source and size, are co-trained: fitted on a
    bounded sample of labelled documents (parameter labelled), and in each round (parameter rounds) on the documents of
    the other view's surest verdicts, which are looked for among all unlabelled documents. Some labelled documents are
    set aside to calibrate the views, others to join them. Every document's whole text is scored. keep is false where
    the score is below the cut that cost least on the latter, a lost good document counting as ten bad ones kept.

    Null text is empty and scored as such; nulls of metadata are values of their own. Without labels of both kinds
    all documents are kept, with score 1. Labels that disagree are averaged. Repeated rows get equal results. An
    empty table gives an empty result. Other columns pass through.
    """
    learned = learn(docs, labels, **sizes)
    model = docs.sparkSession.sparkContext.broadcast(learned and vars(learned))

    def of(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        n = len(text)
        got = [np.ones(n)] * 3
        keep = np.ones(n, bool)
        if model.value is not None and n:
            joint = CoTrained(**model.value)
            # Rounded, so that equal rows have equal scores wherever they stand in a batch.
            got = [np.round(x, 9) for x in joint.views(text_view(text), meta_view(lang, source, n_chars))]
            keep = got[2] >= joint.threshold
        return pa.StructArray.from_arrays([pa.array(np.asarray(x, np.float64)) for x in got] + [pa.array(keep)], ["text_score", "meta_score", "score", "keep"])

    score = F.arrow_udf(of, "text_score double, meta_score double, score double, keep boolean")
    return docs.withColumn(out, score("text", "lang", "source", F.col("n_chars").cast("long")))
