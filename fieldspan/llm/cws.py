"""Document fingerprints by consistent weighted sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of documents, and coarse ranges whose borders are literals.
RANGE_ROWS, COARSE = 1024, 64
#: Samples of a text; bits of the code of a sample.
SAMPLES, CODE_BITS = 128, 16
#: About so many elements are dealt before it is looked whether every sample has one.
DEAL = 900


def with_samples(df: DataFrame, text: str, out: str, words: int = 5) -> DataFrame:
    """df with column `out`: the weighted samples of a text column, an array of 128 longs, sample number and code.

    Terms are runs of `words` words (all words, if there are fewer), weighted by how often they occur. A term of
    weight w is the elements (term, 0) to (term, w - 1); each sample is the element of least rank of ALL elements
    of the text, so two texts have an equal sample with probability sum(min) / sum(max) of the weights.

    Ranks are those of fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017): in round i = 0, 1, ... 127
    a hash deals each element to one sample, and in round 128 + k every element goes to sample k. An element's rank
    in a sample is the first such round, then the hash. Once each sample has an element, later rounds cannot change
    one and are not run, which is exact: a text takes about max(elements, DEAL) hashes and not 128 for each element.
    """
    t, w, h, g, s, b, e, z = (f"_{out}{x}" for x in "twhgsbez")
    space = r"[\\x20\\x09-\\x0D]+"
    df = df.withColumn(t, F.expr(f"split({text}, '{space}')"))
    df = df.withColumn(w, F.expr(f"filter({t}, x -> x <> '')")).drop(t)
    df = df.withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))")).drop(w)
    run = ", ".join(f"get({h}, i + {k})" for k in range(words))
    df = df.withColumn(g, F.expr(f"if(size({h}) = 0, array(), transform(sequence(0, greatest(size({h}) - {words}, 0)), i -> xxhash64({run})))")).drop(h)
    df = df.withColumn(s, F.expr(f"sort_array({g})")).drop(g)
    df = df.withColumn(b, F.expr(f"filter(transform({s}, (x, i) -> if(i > 0 and get({s}, i - 1) = x, -1, i)), i -> i >= 0)"))
    # The n-th occurrence of a term is an element of its own; without repeats, terms are the elements.
    each = f"transform({b}, (i, j) -> transform(sequence(i, coalesce(get({b}, j + 1), size({s})) - 1), k -> if(k = i, get({s}, k), xxhash64(get({s}, k), k - i))))"
    df = df.withColumn(e, F.expr(f"if(size({b}) = size({s}), {s}, flatten({each}))")).drop(s, b)
    rounds = f"greatest(1, least({2 * SAMPLES}, cast(ceil({DEAL} / size({e})) as int)))"
    # Sample number, round and 48 bits of the hash, of which the last 16 are the code.
    dealt = f"shiftleft(cast(if(i < {SAMPLES}, v & {SAMPLES - 1}, i - {SAMPLES}) as bigint), 56) | shiftleft(cast(i as bigint), 48) | shiftrightunsigned(v, 16)"
    some = f"flatten(transform(sequence(k * {rounds}, least((k + 1) * {rounds}, {2 * SAMPLES}) - 1), i -> transform(transform({e}, x -> xxhash64(x, i)), v -> {dealt})))"
    least = f"transform(array(sort_array(concat(a, {some}))), y -> filter(y, (x, i) -> i = 0 or shiftright(get(y, i - 1), 56) <> shiftright(x, 56)))[0]"
    steps = f"sequence(0, cast(ceil({2 * SAMPLES} / {rounds}) as int) - 1)"
    df = df.withColumn(z, F.expr(f"if(size({e}) = 0, cast(array() as array<bigint>), aggregate({steps}, cast(array() as array<bigint>), (a, k) -> if(size(a) = {SAMPLES}, a, {least})))")).drop(e)
    return df.withColumn(out, F.expr(f"transform({z}, x -> shiftleft(shiftright(x, 56), {CODE_BITS}) | (x & {(1 << CODE_BITS) - 1}))")).drop(z)


def printed(samples: str) -> Column:
    """A fingerprint as text: six hex digits for each sample."""
    return F.expr(f"array_join(transform({samples}, x -> lpad(lower(hex(x)), 6, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of the samples that are equal: an unbiased estimate of the generalised Jaccard similarity."""
    bins = f"size(array_union(transform({a}, x -> shiftright(x, {CODE_BITS})), transform({b}, x -> shiftright(x, {CODE_BITS}))))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / cast({bins} as double))")


def _ranges(docs: DataFrame) -> Column:
    """The range of doc_id that a row is in; ranges are in order, of about RANGE_ROWS rows, and never part equal ids."""
    points = [i / COARSE for i in range(COARSE + 1)]
    got = docs.agg(F.percentile_approx("doc_id", points, 10000).alias("p"), F.count("*").alias("n")).first()
    lows = sorted(set(got["p"] or []))
    fine = max(1, -(-got["n"] // (COARSE * RANGE_ROWS)))
    if got["n"] <= COARSE * RANGE_ROWS:
        lows = lows[:: max(1, COARSE * RANGE_ROWS // max(got["n"], 1))]
    id_ = F.col("doc_id")
    at = F.lit(-1).cast("long")
    for i, low in enumerate(lows):
        high = lows[i + 1] if i + 1 < len(lows) else low + 1
        part = F.floor((id_ - low).cast("double") / max(high - low, 1) * fine)
        at = F.when(id_ >= low, i * (1 << 32) + F.least(part, F.lit(fine - 1))).otherwise(at)
    return F.when(id_.isNull(), F.lit(-2).cast("long")).otherwise(at.cast("long"))


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they and the next document's are.

    docs has doc_id and text. The edited text is the text with its last floor(n_chars / 4) code points replaced
    by the first as many (or all) of the next document, by ascending doc_id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for
    each row of docs.

    Each of the 128 samples is drawn of all terms of a text and their weights (`with_samples`). The likeness of two
    fingerprints is the share of equal samples, and its expectation is the generalised Jaccard similarity, for texts
    of any weights and of any number of terms.

    Texts are shuffled once, by ranges of doc_id of about 1024 rows; the next document is a window over a range,
    which also has the first row of the next range as a guest. All of a text is sampled within its row.

    Null text is empty; texts without words have an empty fingerprint, and two such have likeness 1. Equal texts
    have equal fingerprints. Null doc_ids come first. Rows that repeat a doc_id follow each other in the order of
    a hash of their text. A single row is its own next. An empty table gives an empty result. Other columns are
    ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    where = _ranges(docs.select("doc_id"))
    first = docs.select("doc_id", where.alias("_r")).groupBy("_r").agg(F.min("doc_id").alias("_first"))
    around = Window.orderBy("_r")
    back = F.coalesce(F.lag("_r").over(around), F.max("_r").over(Window.partitionBy()))
    # Every range has some RANGE_ROWS rows, so these are few: a row for each range.
    guests = first.select("_first", back.alias("_to"))
    few = first.count() <= 100_000
    guests = F.broadcast(guests) if few else guests
    guest_rows = base.join(guests, F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text", F.col("_to").alias("_r"), F.lit(True).alias("_guest"))
    rows = base.select("doc_id", "text", where.alias("_r"), F.lit(False).alias("_guest")).union(guest_rows)
    rows = rows.withColumn("_x", F.xxhash64("text"))
    order = Window.partitionBy("_r").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_x")
    n = F.char_length("text")
    rows = rows.withColumn("_next", F.lead("text").over(order))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_q", F.expr("cast(floor(char_length(text) / 4) as int)"))
    rows = rows.withColumn("_edited", F.when(~F.col("_guest"), F.expr("concat(substring(text, 1, char_length(text) - _q), substring(coalesce(_next, text), 1, _q))"))).drop("_next", "_q")
    rows = with_samples(rows, "text", "_a", words).drop("text")
    rows = rows.withColumn("_b", F.lead("_a").over(order)).where("not _guest")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    rows = with_samples(rows, "_edited", "_c", words).drop("_edited")
    rows = rows.withColumn("_b", F.coalesce("_b", "_a"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed("_a").alias("fingerprint"), printed("_c").alias("edited_fingerprint"),
        likeness("_a", "_c").alias("near_edited"), likeness("_a", "_b").alias("near_next"),
    )
