"""Language identification by prediction by partial matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._kernels import texts
from ._work import keep, small

#: Documents of each language to learn from.
DOCS = 400
ORDER = 3
PAD = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text (spaces before its start), as one 32-bit number."""
    x = buf.astype(np.uint32)
    out = x.copy()
    starts = off[:-1][np.diff(off) > 0]
    ends = off[1:][np.diff(off) > 0]
    for k in range(1, ORDER + 1):
        prev = np.full(len(x), PAD, np.uint32)
        prev[k:] = x[:-k]
        for j in range(k):
            prev[(starts + j)[starts + j < ends]] = PAD
        out |= prev << np.uint32(8 * k)
    return out


def _count(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        sums: dict[str, list[np.ndarray]] = {}
        for first, buf, off in texts(batch.column("text")):
            codes = _codes(buf, off)
            for i in range(len(off) - 1):
                sums.setdefault(langs[first + i], []).append(codes[off[i] : off[i + 1]])
        for lang, parts in sums.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code), pa.string()), "code": code.astype(np.int64), "n": n.astype(np.int64)})


def context_trees(langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
    """Context trees of all languages with frozen counts, as plain tables of code lengths in bits.

    A context of order 0 to 3 with n symbols seen, t of them different, gives a symbol with count c the
    probability c / (n + t), and escapes with t / (n + t) to the context one byte shorter, whose
    probabilities for symbols not seen here are scaled up to sum to one. Under order 0 all 256 bytes are equal.
    So every context is a full distribution over bytes, and sums of code lengths are exact.

    For each order: the keys (context and symbol) and the contexts that any language has, sorted; for each key the
    bits under every language, by its escapes where it lacks the key; for each context the bits of every language's
    escape (0 where it lacks the context). Every context of the sample is there.
    """
    out: dict = {"langs": langs, "keys": [], "bits": [], "contexts": [], "escapes": []}
    below = [None] * len(langs)
    for order in range(ORDER + 1):
        full = code & ((1 << 8 * (order + 1)) - 1)
        seen, contexts = np.unique(full), np.unique(full >> 8)
        escapes = np.zeros((len(contexts), len(langs)))
        bits = _lengths(out, seen) + np.zeros((len(seen), len(langs)))
        for i in range(len(langs)):
            mine, inverse = np.unique(full[lang == i], return_inverse=True)
            count = np.bincount(inverse, n[lang == i])
            ctx, of = np.unique(mine >> 8, return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            # What the shorter context leaves to symbols not seen here.
            shorter = np.full(len(mine), 1 / 256) if order == 0 else below[i][1][np.searchsorted(below[i][0], mine & ((1 << 8 * order) - 1))]
            rest = 1 - np.bincount(of, shorter)
            closed = (kinds == 256) | (rest < 1e-12)
            whole = np.where(closed, total, total + kinds)
            p = count / whole[of]
            below[i] = (mine, p)
            escapes[np.searchsorted(contexts, ctx), i] = -np.log2(np.where(closed, 1e-30, kinds / whole / np.where(closed, 1, rest)))
            bits[:, i] += escapes[np.searchsorted(contexts, seen >> 8), i]
            bits[np.searchsorted(seen, mine), i] = -np.log2(p)
        out["keys"].append(seen.astype(np.uint32))
        out["bits"].append(bits.astype(np.float32))
        out["contexts"].append(contexts.astype(np.uint32))
        out["escapes"].append(escapes.astype(np.float32))
    return out


class _Find:
    """Places of numbers in a sorted table: one probe by hash, and a search for what another number's slot hides."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        bits = max(4, int(4 * len(table)).bit_length())
        self.shift = np.uint32(32 - min(bits, 24))
        self.slot = np.zeros(1 << min(bits, 24), np.int32)
        self.slot[self._hash(table)] = np.arange(len(table))

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint32(2654435761)) >> self.shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Place of each number, -1 where the table lacks it."""
        at = self.slot[self._hash(x)]
        off = np.flatnonzero(self.table[at] != x)
        if len(off):
            found = np.minimum(np.searchsorted(self.table, x[off]), len(self.table) - 1)
            at[off] = np.where(self.table[found] == x[off], found, -1)
        return at


def _lengths(trees: dict, codes: np.ndarray, finds: list | None = None) -> np.ndarray:
    """Bits of the last byte of each code after the bytes before it, under each language; orders as many as trees has."""
    order = len(trees["keys"]) - 1
    out = np.zeros((len(codes), len(trees["langs"])), np.float32)
    left, x = np.arange(len(codes)), codes.astype(np.uint32)
    for k in range(order, -1, -1):
        x = x & np.uint32((1 << 8 * (k + 1)) - 1)
        by_key, by_context = finds[k] if finds else (_Find(trees["keys"][k]), _Find(trees["contexts"][k]))
        at = by_key(x)
        hit = at >= 0
        if hit.all() and k == order:
            return trees["bits"][k][at]
        out[left[hit]] += trees["bits"][k][at[hit]]
        left, x = left[~hit], x[~hit]
        if not len(left):
            return out
        at = by_context(x >> np.uint32(8))
        out[left[at >= 0]] += trees["escapes"][k][at[at >= 0]]
    out[left] += 8.0
    return out


def code_lengths(trees: dict, buf: np.ndarray, off: np.ndarray, finds: list | None = None) -> np.ndarray:
    """Code length in bits of each text buf[off[i]:off[i+1]] under each language."""
    out = np.zeros((len(off) - 1, len(trees["langs"])))
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        out[some] = np.add.reduceat(_lengths(trees, _codes(buf, off), finds), off[some], axis=0, dtype=np.float64)
    return out


def finders(trees: dict) -> list:
    return [(_Find(k), _Find(c)) for k, c in zip(trees["keys"], trees["contexts"], strict=True)]


def learn(docs: DataFrame, docs_per_lang: int = DOCS) -> dict | None:
    """Context trees from at most docs_per_lang documents of each language, the first by a hash of doc_id.

    Only documents that are not held out and whose lang is not null are read. None if there are none. The hash cuts each
    language to about twice that many rows before they are ranked, so no task ranks a whole language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    hashed = F.xxhash64("doc_id")
    sizes = usable.groupBy(F.col("lang").alias("_of")).agg(F.count("*").alias("_rows"))
    ids = usable.select("doc_id", "lang").join(small(keep(sizes, "language_sizes")), F.col("lang") == F.col("_of"))
    ids = ids.where(F.shiftrightunsigned(hashed, 11) * F.pow(F.lit(2.0), F.lit(-53)) * F.col("_rows") < 2.0 * docs_per_lang + 50).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_per_lang)
    ids = keep(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "language_sample")
    chosen = usable.join(small(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    if not len(got):
        return None
    langs = sorted(set(got["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    return context_trees(langs, got["lang"].map(number).to_numpy(), got["code"].to_numpy(), got["n"].to_numpy())


def predict_language(docs: DataFrame, docs_per_lang: int = DOCS) -> DataFrame:
    """The language whose context tree gives each whole text the shortest code.

    docs has doc_id, text and lang. Returns doc_id, held_out, lang_pred and score, one row for each row of docs.
    held_out: crc32 of the doc_id as text leaves 2 modulo 4; such documents are not learned from. The model is
    learned from a bounded sample, docs_per_lang documents of each language, all of whose contexts it keeps; the
    sample's counts are what the driver gets, and the model, a number for each context, symbol and language, is what
    is broadcast, as plain arrays.

    score is the posterior of the language under equal priors. Equal codes: the smaller name. `und`, score 0:
    null text, text without a letter, or nothing to learn from. A null doc_id is not held out and not learned from.
    Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = learn(docs, docs_per_lang)
    shared = spark.sparkContext.broadcast(model)

    def of(col: pa.Array) -> pa.Array:
        trees, best, score = shared.value, [], []
        finds = finders(trees) if trees else None
        for _, buf, off in texts(col):
            if trees is None:
                best += ["und"] * (len(off) - 1)
                score.append(np.zeros(len(off) - 1))
                continue
            bits = code_lengths(trees, buf, off, finds)
            at = bits.argmin(axis=1)
            best += [trees["langs"][i] for i in at]
            score.append(1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["lang", "score"])

    guess = F.arrow_udf(of, "lang string, score double")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("_l"), guess("text").alias("_g"))
    return out.select("doc_id", "held_out", F.when(F.col("_l"), F.col("_g.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("_l"), F.col("_g.score")).otherwise(0.0).alias("score"))
