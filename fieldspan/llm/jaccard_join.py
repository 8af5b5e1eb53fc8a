"""N-gram Jaccard join by MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import Hasher, lists, mix, spans, texts
from ._work import keep, small
from .components import components

#: Documents, and n-grams, of a block: what one task holds twice.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1 << 19


def bands_for(threshold: float = 0.8, recall: float = 0.999, most: int = 360) -> tuple[int, int]:
    """(bands, rows): at most `most` hashes, at least `recall` at the threshold, fewest candidates of half the threshold's likeness and below."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            false = sum(1 - (1 - (s / 100) ** rows) ** bands for s in range(1, int(100 * threshold)))
            best = min(best or (false, bands, rows), (false, bands, rows))
    return best[1], best[2]


def gram_sets(hasher: Hasher, buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text (all words, if fewer), and how many; repeats are left in."""
    _, _, h, wo = hasher.words(buf, off)
    words = np.diff(wo)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    owner, place = spans(count)
    start = wo[:-1][owner] + place
    out = np.zeros(len(start), np.uint64)
    long = words[owner] >= n
    out[long] = hasher.grams(h, n)[start[long]]
    for k in range(1, n):
        some = words[owner] == k
        if some.any():
            out[some] = hasher.grams(h, k)[start[some]]
    return out, count


def _sign(n: int, bands: int, rows: int):
    k = bands * rows
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    xor, mul = (seed[:k] >> np.uint64(32)).astype(np.uint32), (seed[k:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    band = mix(np.arange(1, k + 1, dtype=np.uint64))

    def of(col: pa.Array) -> pa.Array:
        hasher, keys, lengths, grams = Hasher(), [], [], []
        for _, buf, off in texts(col):
            g, count = gram_sets(hasher, buf, off, n)
            low = (g >> np.uint64(17)).astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum(count)])
            some = np.flatnonzero(count)
            sig = np.empty((len(some), k), np.uint32)
            for j, i in enumerate(some):
                x, least = low[ends[i] : ends[i + 1]], None
                for a in range(0, len(x), 256):
                    part = ((x[a : a + 256, None] ^ xor) * mul).min(axis=0)
                    least = part if least is None else np.minimum(least, part)
                sig[j] = least
            # The key of a band is of its rows and of its number.
            key = mix((mix(sig.astype(np.uint64) + band) ).reshape(len(some), bands, rows).sum(axis=2, dtype=np.uint64))
            keys.append(key.ravel().view(np.int64))
            lengths.append(np.where(count > 0, bands, 0))
            grams.append(count)
        return pa.StructArray.from_arrays([lists(keys, lengths, pa.int64()), pa.array(np.concatenate(grams) if grams else [], pa.int64())], ["keys", "n_grams"])

    return of


def _gram_bytes(n: int):
    def of(col: pa.Array) -> pa.Array:
        hasher, out = Hasher(), []
        for _, buf, off in texts(col):
            g, count = gram_sets(hasher, buf, off, n)
            ends = np.concatenate([[0], np.cumsum(count)])
            out += [np.unique(g[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array(out, pa.binary())

    return of


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, group: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each of `left`: those of `right`, after it if both are the same rows, whose sets are alike enough.

    By inverted lists: a set is met only by the sets that share an n-gram with it.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[i] for i in right])
    who = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    same = left is right
    for at, i in enumerate(left):
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        owner, place = spans(b - a)
        common = np.bincount(who[a[owner] + place], minlength=len(right))
        hit = common >= threshold * (sizes[i] + sizes[right] - common) - 1e-9
        hit &= (group[right] == group[i]) & (common > 0)
        if same:
            hit[: at + 1] = False
        yield at, np.flatnonzero(hit)


def _verify(threshold: float):
    def of(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        group, block = table.column("_root").to_numpy()[order], table.column("_block").to_numpy()[order]
        views = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table.column("_grams").chunks for x in chunk]
        sets = [views[i] for i in order]
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(left) and len(right):
            for at, found in _links(sets, left, right, group, threshold):
                a = left[at]
                links[a] += len(found)
                links[right[found]] += 1
                for b in right[found]:
                    x, y = find(a), find(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
        top = ids[[find(x) for x in range(len(ids))]] if len(ids) else ids
        return pa.table({"node": pa.array(ids, pa.int64()), "n_links": pa.array(links), "top": pa.array(top, pa.int64())})

    return of


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Links between documents whose sets of word n-grams have a Jaccard similarity of at least threshold.

    docs has doc_id and text. Returns one row for each row of docs: doc_id, class_id (smallest doc_id of all
    documents linked to it directly or through others, equal texts included), text_id (smallest doc_id with
    the same text), n_links (number of different texts that are linked to it directly) and text_md5.

    Bands and rows are chosen for the recall wanted at the threshold. Band hashes are shuffled once for each
    different text. Texts that share a band hash with the smallest text of that band are joined to one
    candidate group, n-gram sets are shuffled once to their group, and all pairs of a group are counted on the
    full sets, in blocks of bounded size: block meets block in a task of its own, and what leaves a task is one
    row a document, never a row a pair. There is no limit on group sizes.

    A text of fewer than n words has one n-gram, all its words. Texts without words (null, empty) are linked to
    nothing but their equals; a null text equals only itself. Rows with a null doc_id are returned without class
    or links. Repeated rows get equal results; rows that share a doc_id but not the text are documents of their
    own, each in the class of its text. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    sign = F.arrow_udf(_sign(n, bands, rows), "keys array<long>, n_grams long")
    signed = docs.select("doc_id", _digest("text").alias("_t"), sign("text").alias("_s")).select("doc_id", "_t", "_s.*")
    signed = keep(signed, "join_signatures")
    # A text is the node of its smallest doc_id, unless that has a smaller text too: then of a negative number of its own.
    first = signed.where("doc_id is not null and _t is not null").groupBy("_t").agg(F.min("doc_id").alias("_rep"))
    first = keep(first, "join_first")
    again = first.groupBy("_rep").agg(F.min("_t").alias("_least"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_rep").alias("_r"), "_least")
    again = keep(again, "join_again")
    if again.limit(1).count():
        other = F.col("_least").isNotNull() & (F.col("_t") != F.col("_least"))
        own = -F.shiftrightunsigned(F.xxhash64("_t", "_rep"), 1) - 1
        first = keep(first.join(again, F.col("_rep") == F.col("_r"), "left").select("_t", "_rep", F.when(other, own).otherwise(F.col("_rep")).alias("node")), "join_nodes")
    else:
        first = first.withColumn("node", F.col("_rep"))
    reps = signed.join(first.withColumnRenamed("_t", "_ft"), (F.col("_t") == F.col("_ft")) & (F.col("doc_id") == F.col("_rep"))).select("doc_id", "_t", "node", "keys", "n_grams")
    # Repeated rows: a node is one text, so any of them will do, and their number is that of the rows.
    reps = reps.dropDuplicates(["node"])

    # Bands with two texts at least; each of these texts is tied to the smallest.
    keyed = reps.select("node", F.explode("keys").alias("_k"))
    shared = keep(keyed.groupBy("_k").agg(F.min("node").alias("v"), F.max("node").alias("_hi")).where("v <> _hi").select("_k", "v"), "join_bands")
    edges = keyed.join(shared, "_k").select(F.col("node").alias("u"), "v").where("u <> v")
    groups = keep(components(edges), "join_groups")

    # Blocks of each group, by documents and by n-grams; groups of one block share tasks.
    size = reps.select("doc_id", "_t", F.col("node").alias("_node"), "n_grams").join(groups, F.col("_node") == F.col("node"))
    total = size.groupBy("root").agg(F.count("*").alias("_n"), F.sum("n_grams").alias("_g"))
    need = F.greatest(F.ceil(F.col("_n") / BLOCK_DOCS), F.ceil(F.col("_g") / BLOCK_GRAMS)).cast("int")
    total = total.select(F.col("root").alias("_root"), need.alias("_blocks"), "_g")
    plan = keep(size.join(total, F.col("root") == F.col("_root")).select("node", F.col("doc_id").alias("_id"), F.col("_t").alias("_it"), "_root", "_blocks", "_g"), "join_plan")
    sums = plan.where("_blocks = 1 and node = _root").agg(F.sum("_g").alias("g"), F.count("*").alias("c")).first()
    bins = max(1, -(-(sums["g"] or 0) // (BLOCK_GRAMS // 4)), (sums["c"] or 0) // (BLOCK_DOCS // 2))
    single = F.col("_blocks") == 1
    plan = plan.withColumn("_block", F.when(single, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("_blocks"))).cast("int"))
    plan = plan.withColumn("_bin", F.when(single, F.pmod(F.xxhash64("_root"), F.lit(bins))).otherwise(-1 - F.xxhash64("_root")).cast("long")).drop("_g")

    # The n-gram sets of these texts, once to each block pair of their group.
    source = docs.select("doc_id", "text").join(small(plan.select("_id", "_it")), (F.col("doc_id") == F.col("_id")) & (_digest("text") == F.col("_it")), "left_semi")
    grams = F.arrow_udf(_gram_bytes(n), "binary")
    grammed = source.select("doc_id", _digest("text").alias("_t"), grams("text").alias("_grams")).dropDuplicates(["doc_id", "_t"])
    cells = grammed.join(plan, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_it"))).withColumn("_o", F.explode(F.expr("sequence(0, _blocks - 1)")))
    cells = cells.select("node", "_grams", "_root", "_block", "_bin", F.least("_block", "_o").alias("_i"), F.greatest("_block", "_o").alias("_j"))
    found = cells.groupBy("_bin", "_i", "_j").applyInArrow(_verify(threshold), "node long, n_links long, top long")
    found = keep(found, "join_found")
    linked = keep(components(found.select(F.col("node").alias("u"), F.col("top").alias("v"))), "join_classes")
    counts = found.groupBy(F.col("node").alias("_cn")).agg(F.sum("n_links").alias("n_links"))

    # The class of a text is the smallest doc_id of its texts.
    named = first.join(linked.withColumnRenamed("node", "_ln"), F.col("node") == F.col("_ln"), "left").join(counts, F.col("node") == F.col("_cn"), "left")
    named = named.select("_t", "_rep", F.coalesce("root", "node").alias("_root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = keep(named, "join_named")
    least = named.groupBy(F.col("_root").alias("_lr")).agg(F.min("_rep").alias("_class"), F.count("*").alias("_n")).where("_n > 1")
    facts = named.join(least, F.col("_root") == F.col("_lr"), "left").select(F.col("_t").alias("_ft"), "_rep", F.coalesce("_class", "_rep").alias("_class"), "n_links")
    out = signed.select("doc_id", "_t").join(keep(facts, "join_facts"), F.col("_t") == F.col("_ft"), "left")
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(known, F.coalesce("_class", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("_rep", "doc_id")).alias("text_id"),
        F.when(known, F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"),
        F.lower(F.hex("_t")).alias("text_md5"),
    )


def without_copies(docs: DataFrame, **join: float) -> DataFrame:
    """docs with one row of each class of jaccard_join: of the smallest doc_id, and of its texts in the class the one of least digest.

    Rows that repeat doc_id and text are one document: one of them stays. Rows with a null doc_id or a null text stay,
    all of them. Rows are told apart by doc_id and text, so a text is never lost because another row has its doc_id.
    """
    classes = keep(jaccard_join(docs, **join).where("doc_id is not null and text_md5 is not null").groupBy("doc_id", "text_md5", "class_id").agg(F.count("*").alias("_n")), "copies")
    own = classes.where("doc_id = class_id").groupBy("class_id").agg(F.min("text_md5").alias("_stays"))
    own = keep(own.select(F.col("class_id").alias("_c"), "_stays"), "copies_first")
    judged = classes.join(own, F.col("class_id") == F.col("_c"), "left")
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("text_md5") == F.col("_stays"))
    judged = judged.select(F.col("doc_id").alias("_id"), F.unhex("text_md5").alias("_it"), stays.alias("_one"), "_n").where("not _one or _n > 1")
    judged = keep(judged, "copies_judged")
    # Rows go through as one struct, so that no column of theirs can clash.
    packed = docs.select(F.struct("*").alias("_all"))
    same = (F.col("_all.doc_id") == F.col("_id")) & (_digest("_all.text") == F.col("_it"))
    rest = packed.join(small(judged.select("_id", "_it")), same, "left_anti").select("_all.*")
    repeated = judged.where("_one").select("_id", "_it")
    if not repeated.limit(1).count():
        return rest
    once = packed.join(small(repeated), same, "left_semi").select("_all", F.col("_all.doc_id").alias("_id"), _digest("_all.text").alias("_it"))
    return rest.unionByName(once.dropDuplicates(["_id", "_it"]).select("_all.*"))
