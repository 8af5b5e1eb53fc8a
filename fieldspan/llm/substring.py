"""Substring deduplication by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import Hasher, lists, mix, spans, texts
from ._work import BROADCAST_ROWS, keep, small


def _minimum(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    m, have = g, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(g) - w + 1], m[w - have : w - have + len(g) - w + 1]) if have < w else m


def levels(window: int, shortest: int = 25) -> list[int]:
    """Lengths from the window's last half of at least `shortest` words, doubled up to the window: 25 and 50, for 50."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def _anchors(hasher: Hasher, h: np.ndarray, wo: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (as word numbers), the text of each, and the least hash of a run of `length` words inside each."""
    n = np.maximum(np.diff(wo) - window + 1, 0)
    owner, place = spans(n)
    start = wo[:-1][owner] + place
    if not len(start):
        return start, owner, np.zeros(0, np.uint64)
    return start, owner, _minimum(hasher.grams(h, length), window - length + 1)[start]


def _first_of_runs(least: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without repeats in a row, and how many each of n texts has."""
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    return least[new].view(np.int64), np.bincount(owner[new], minlength=n)


def _fitting(least: np.ndarray, owner: np.ndarray, wanted: pa.Array, first: int, n: int) -> np.ndarray:
    """Whether a window's anchor is among the candidates of its text."""
    fit = np.zeros(len(least), bool)
    ends = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        if ends[i] < ends[i + 1]:
            some = np.asarray(wanted[first + i].as_py() or [], np.int64).view(np.uint64)
            fit[ends[i] : ends[i + 1]] = np.isin(least[ends[i] : ends[i + 1]], some)
    return fit


def _survey(window: int, length: int):
    """Per text: its words, the digest of its words joined by one space, and the anchors of its windows."""

    def of(col: pa.Array) -> pa.Array:
        hasher, n_words, digest, anchors, lengths = Hasher(), [], [], [], []
        for _, buf, off in texts(col):
            _, _, h, wo = hasher.words(buf, off)
            start, owner, least = _anchors(hasher, h, wo, window, length)
            some, many = _first_of_runs(least, owner, len(off) - 1)
            anchors.append(some)
            lengths.append(many)
            n_words.append(np.diff(wo))
            raw = buf.tobytes()
            digest += [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(digest, pa.string()), lists(anchors, lengths, pa.int64())],
            ["n_words", "kept_sha256", "anchors"],
        )

    return of


def _extend(window: int, before: int, length: int):
    """The anchors of one level, of those windows whose anchor of the level before is among the candidates."""

    def of(col: pa.Array, wanted: pa.Array) -> pa.Array:
        hasher, anchors, lengths = Hasher(), [], []
        for first, buf, off in texts(col):
            _, _, h, wo = hasher.words(buf, off)
            _, owner, least = _anchors(hasher, h, wo, window, before)
            fit = _fitting(least, owner, wanted, first, len(off) - 1)
            _, _, longer = _anchors(hasher, h, wo, window, length)
            some, many = _first_of_runs(longer[fit], owner[fit], len(off) - 1)
            anchors.append(some)
            lengths.append(many)
        return lists(anchors, lengths, pa.int64())

    return of


#: Added to the hashes of words for the second half of a window's 128 bits.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _windows(window: int, length: int):
    """128 bits of hash, and start, of every window whose anchor of the level before is among the candidates."""

    def of(col: pa.Array, wanted: pa.Array) -> pa.Array:
        hasher, starts, hashes, others, lengths = Hasher(), [], [], [], []
        for first, buf, off in texts(col):
            _, _, h, wo = hasher.words(buf, off)
            start, owner, least = _anchors(hasher, h, wo, window, length)
            fit = _fitting(least, owner, wanted, first, len(off) - 1)
            hashes.append(hasher.grams(h, window)[start[fit]].view(np.int64))
            others.append(hasher.grams(mix(h + SECOND), window)[start[fit]].view(np.int64))
            starts.append(start[fit] - wo[:-1][owner[fit]])
            lengths.append(np.bincount(owner[fit], minlength=len(off) - 1))
        return pa.StructArray.from_arrays([lists(hashes, lengths, pa.int64()), lists(others, lengths, pa.int64()), lists(starts, lengths, pa.int32())], ["h", "g", "p"])

    return of


def _cut(window: int):
    """The words no given window covers, joined by one space; how many are covered; the digest."""

    def of(col: pa.Array, starts: pa.Array) -> pa.Array:
        kept, gone = [], []
        for text, at in zip(col, starts, strict=True):
            words = (text.as_py() or "").encode().split()
            cover = np.zeros(len(words) + 1, np.int64)
            p = np.asarray(at.as_py() or [], np.int64)
            np.add.at(cover, p, 1)
            np.add.at(cover, p + window, -1)
            covered = np.cumsum(cover[:-1]) > 0
            gone.append(int(covered.sum()))
            kept.append(b" ".join([w for w, c in zip(words, covered, strict=True) if not c]))
        return pa.StructArray.from_arrays(
            [pa.array([k.decode() for k in kept], pa.string()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["kept", "n_removed", "kept_sha256"],
        )

    return of


def _runs(window: int):
    """The runs of words that windows at the given starts cover: start and end by turns."""

    def of(starts: pa.Array) -> pa.Array:
        out = []
        for at in starts:
            p = np.unique(np.asarray(at.as_py() or [], np.int64))
            new = np.flatnonzero(np.diff(p) > window) + 1
            out.append(np.stack([p[np.r_[0, new]], p[np.r_[new - 1, len(p) - 1]] + window], 1).ravel() if len(p) else p)
        return pa.array(out, pa.list_(pa.int64()))

    return of


def _without(col: pa.Array, runs: pa.Array) -> pa.Array:
    """Each text's words outside the given runs, joined by one space, and how many are inside."""
    kept, gone = [], []
    for text, at in zip(col, runs, strict=True):
        words, left, end = text.as_py().encode().split(), [], 0
        bounds = at.as_py() or []
        for a, b in zip(bounds[::2], bounds[1::2], strict=True):
            left += words[end:a]
            end = b
        left += words[end:]
        kept.append(b" ".join(left).decode())
        gone.append(len(words) - len(left))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.int64())], ["kept", "n_removed"])


def substring_dedup(docs: DataFrame, window: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Words of each document that earlier documents do not have in the same run of `window` words.

    docs has doc_id and text. A word goes if a window of so many consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept_sha256 and kept_text, one row for each row of docs; kept_text is null where nothing was
    removed, else the kept words joined by one space. With `carry`, columns of docs, returns these with
    n_removed and kept_text: then what joins the documents is narrow, the runs of words that go.

    Lengths double from level to level up to the window (`levels`: 25 and 50 words for a window of 50). Below the
    window, only the run of least hash inside each window, its anchor, is surveyed: equal windows have equal anchors, so
    none is lost, and about one position in thirteen is shuffled. Anchors found in one text alone end there; the
    windows of the others go on to anchors of twice the length, and at last to whole windows, of which the smallest
    document is looked for. The loop ends early where no candidate survives. Longer levels than the window would not
    change what goes: whatever a longer repeated passage covers, its windows cover too. Texts that are equal as a whole
    go through all levels once.

    Texts are shuffled only for documents with candidates, while these are few enough to broadcast their
    ids; hot passages meet in sums that are combined before the shuffle, and in joins of two plain
    exchanges that Spark splits when skewed. Windows are compared by 128 bits of hash.

    Null text has no words. Shorter texts keep all words. A document with a null doc_id is left whole and
    owns nothing. Rows that repeat a doc_id are one document to each other: nothing is removed for their
    sake. An empty table gives an empty result. Other columns are ignored unless carried.
    """
    lengths = levels(window)
    half = F.arrow_udf(_survey(window, lengths[0]), "n_words long, kept_sha256 string, anchors array<long>")
    seen = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("_t"), half("text").alias("_s"))
    seen = keep(seen.select("doc_id", F.unhex("_t").alias("_t"), "_s.*"), "substring_survey")

    # Equal texts: the smallest doc_id stands for all.
    first = keep(seen.where("doc_id is not null and n_words >= %d" % window).groupBy("_t").agg(F.min("doc_id").alias("_rep")), "substring_first")
    reps = seen.where("size(anchors) > 0").join(first, (seen["_t"] == first["_t"]) & (seen["doc_id"] == first["_rep"]), "left_semi")
    anchors = reps.select("doc_id", "_t", F.explode("anchors").alias("_a"))

    def candidates(anchors: DataFrame) -> DataFrame:
        """The documents that have anchors which are in two texts at least, and those anchors."""
        code = F.xxhash64("_t")
        twice = keep(anchors.groupBy("_a").agg(F.min(code).alias("_x"), F.max(code).alias("_y")).where("_x <> _y").select("_a"), "substring_anchors")
        return keep(anchors.join(twice, "_a").groupBy("doc_id", "_t").agg(F.collect_set("_a").alias("_wanted")), "substring_wanted")

    def with_texts(wanted: DataFrame) -> DataFrame:
        ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
        few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        some = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left_semi")
        return some.withColumn("_t", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(wanted, ["doc_id", "_t"])

    wanted = candidates(anchors)
    for before, length in zip(lengths[:-2], lengths[1:-1], strict=True):
        if not wanted.limit(1).count():
            break
        extend = F.arrow_udf(_extend(window, before, length), "array<long>")
        wanted = candidates(with_texts(wanted).select("doc_id", "_t", F.explode(extend("text", "_wanted")).alias("_a")))

    # The last level: whole windows.
    whole = F.arrow_udf(_windows(window, lengths[max(0, len(lengths) - 2)]), "h array<long>, g array<long>, p array<int>")
    pairs = with_texts(wanted).withColumn("_w", whole("text", "_wanted")).drop("_wanted")
    pairs = keep(pairs.drop("text") if carry else pairs, "substring_windows")
    windows = pairs.select("doc_id", "_t", F.explode(F.arrays_zip("_w.h", "_w.g", "_w.p")).alias("_z"))
    windows = windows.select("doc_id", "_t", F.col("_z.h").alias("_h"), F.col("_z.g").alias("_g"), F.col("_z.p").alias("_p"))
    owner = windows.groupBy("_h", "_g").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    owner = keep(owner.select("_h", "_g", "_first"), "substring_owners")
    hits = windows.join(owner, ["_h", "_g"]).where("_first < doc_id").groupBy("doc_id", "_t").agg(F.collect_set("_p").alias("_at"))

    # All documents: copies lose all, changed documents what was cut, the others nothing.
    base = seen.drop("anchors").join(first, "_t", "left")
    copy = F.coalesce((F.col("_rep") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    if carry:
        runs = F.arrow_udf(_runs(window), "array<long>")
        cuts = hits.select("doc_id", "_t", runs("_at").alias("_runs"))
        copies = base.where(copy).select("doc_id", "_t", F.array(F.lit(0).cast("long"), F.col("n_words")).alias("_runs")).distinct()
        touched = keep(cuts.unionByName(copies), "substring_runs").withColumnsRenamed({"doc_id": "_id", "_t": "_it"})
        source = docs.select(*dict.fromkeys([*carry, "text", "doc_id"])).withColumn("_t", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        on = (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_it"))
        less = F.arrow_udf(_without, "kept string, n_removed long")
        new = source.join(small(touched), on).withColumn("_c", less("text", "_runs"))
        same = source.join(small(touched), on, "left_anti").select(*carry, F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"))
        return same.union(new.select(*carry, F.col("_c.n_removed").alias("n_removed"), F.col("_c.kept").alias("kept_text")))
    cut = F.arrow_udf(_cut(window), "kept string, n_removed long, kept_sha256 string")
    changed = keep(pairs.drop("_w").join(hits, ["doc_id", "_t"]).select("doc_id", "_t", cut("text", "_at").alias("_c")), "substring_changed")
    facts = base.select("doc_id", "_t", "n_words", "kept_sha256", copy.alias("_copy"))
    out = facts.join(changed.dropDuplicates(["doc_id", "_t"]), ["doc_id", "_t"], "left")
    return out.select("doc_id", "n_words", *_verdict())


def _verdict() -> Iterator:
    empty = hashlib.sha256(b"").hexdigest()
    copy, cut = F.col("_copy"), F.col("_c")
    return iter([
        F.when(copy, F.col("n_words")).otherwise(F.coalesce(cut["n_removed"], F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce(cut["kept_sha256"], F.col("kept_sha256"))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(cut["kept"]).alias("kept_text"),
    ])
