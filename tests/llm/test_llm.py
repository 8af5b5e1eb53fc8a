"""Operators of the training-data subpackage against brute force, and on odd tables."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldspan.llm import queries, warc
from fieldspan.llm.components import components
from fieldspan.llm.cws import fingerprints
from fieldspan.llm.jaccard_join import bands_for, jaccard_join, without_copies
from fieldspan.llm.langid import _count, code_lengths, context_trees, finders, predict_language
from fieldspan.llm.licenses import PHRASES, TEMPLATES, license_scan
from fieldspan.llm.mixing import mix, mixed
from fieldspan.llm.packing import best_fit, pack
from fieldspan.llm.quality import with_quality
from fieldspan.llm.substring import levels, substring_dedup
from fieldspan.llm.topk import sorted_lists, threshold_topk, top_k
from fieldspan.llm.warc import warc_round_trip

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"


@pytest.fixture(scope="module")
def rows(spark):
    words = [f"w{i * i % 97}x{i}" for i in range(400)]
    long = " ".join(words)
    near = " ".join([*words[:200], "other", *words[201:]])
    texts = [long, near, long, None, "", "  \n ", "one two", "ONE", "mit license mit license", "licensed under cc by nc 4.0", "ÄÖ ü ß", "123 456", " ".join(words[100:180] + ["tail"] * 60), "x " * 3000, "x " * 3000]
    out = [(i, t, None if i % 5 == 4 else ("en", "de")[i % 2], None if i % 4 == 3 else f"s{i % 3}", len(t or ""), 0.5, "clash") for i, t in enumerate(texts)]
    out += [out[0], (None, long, "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(out, SCHEMA)


OPERATORS = {
    "jaccard": jaccard_join, "substring": substring_dedup, "language": predict_language, "fingerprints": fingerprints, "packing": best_fit, "licenses": license_scan, "mix": mix,
    "quality": lambda d: with_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_number(name, rows):
    got = OPERATORS[name](rows).collect()
    assert len(got) == (rows.count() if name != "packing" else sum(max(1, -(-len(WORD.findall(r.text or "")) // 4096)) for r in rows.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, rows):
    assert OPERATORS[name](rows.where("false")).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_query_equals_sql(name, spark, sf_dir, compare):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    scored = []
    for v in (np.floor(rng.normal(size=(900, 8)) * 9), np.floor(rng.random((900, 3)) ** 8 * 64), np.ones((300, 4)), np.zeros((60, 2)), np.zeros((50, 0))):
        ids, q = rng.permutation(len(v)), v[:40]
        got = list(threshold_topk(v, sorted_lists(v), ids, q, ids[:40], 20))
        assert [g[0] for g in got] == list(ids[:40])
        for j, (i, rows, score, _, _) in enumerate(got):
            want = sorted((-float(x), int(k)) for x, k in zip(v @ q[j], ids) if k != i)[:20]
            assert [(-s, k) for s, k in zip(score, rows)] == want
        scored.append(np.mean([g[4] for g in got]) / len(v))
    # Few rows are scored where the numbers differ much in size; all are where all scores tie.
    assert scored[1] < 0.5 and scored[2] > 0.9


def test_threshold_algorithm_answers_every_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = top_k(rows).collect()
    n = rows.count()
    # On these isotropic vectors lists end before a bound stops a query: every row but the query's own is scored, once.
    assert got and all(0 < r.depth <= n and r.scored == n - 1 for r in got)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 1.0], "a"), (20, [1.0, 1.0], "a"), (3, None, "a"), (4, [None, 1.0], "a"), (5, [float("nan"), 1.0], "a"), (6, [float("inf"), 1.0], "a"), (7, [0.5, 0.5], "a"), (8, [1.0], "a"), (None, [1.0, 1.0], "a"), (7, [0.5, 0.5], "a")]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).orderBy("query_id", "rank")
    got = [tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()]
    assert got == [(0, 1, 20, 8192), (0, 2, 7, 4096), (20, 1, 0, 8192), (20, 2, 7, 4096)]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def grams(t):
    w = WORD.findall(t or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_jaccard_join_equals_all_pairs(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sets, first = {i: set(grams(t)) for i, t in docs.items()}, {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    reps = sorted(first.values())
    links = {i: {j for j in reps if j != i and sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in reps}
    for r in queries.op2_jaccard_join(spark, sf_dir).collect():
        rep, seen = first[docs[r.doc_id]], set()
        todo = [rep]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        assert (r.text_id, r.n_links, r.class_id) == (rep, len(links[rep]), min(seen))


def test_documents_that_share_an_id_or_a_text(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    b2 = b + " tail"
    rows = [(1, a), (2, a), (2, b), (3, b2), (1, a), (4, ""), (5, ""), (6, None), (6, None), (None, a), (2, b2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_t", F.lit("clash"))
    got = {(r.doc_id, r.text_md5): (r.class_id, r.text_id, r.n_links) for r in jaccard_join(docs).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got[1, md5(a)] == got[2, md5(a)] == (1, 1, 0)
    assert got[2, md5(b)] == (2, 2, 1) and got[2, md5(b2)] == got[3, md5(b2)] == (2, 2, 1)
    assert got[5, md5("")] == (4, 4, 0) and got[6, None] == (6, 6, 0) and got[None, md5(a)] == (None, None, None)
    kept = sorted(((r.doc_id, r.text) for r in without_copies(docs).collect()), key=str)
    assert kept == sorted([(1, a), (2, min(b, b2, key=md5)), (4, ""), (6, None), (6, None), (None, a)], key=str)


def test_groups_larger_than_a_block(spark, monkeypatch):
    from fieldspan.llm import jaccard_join as module

    monkeypatch.setattr(module, "BLOCK_DOCS", 8)
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(base[:-1] + [f"e{i}"])) for i in range(40)], "doc_id long, text string")
    assert {(r.class_id, r.n_links) for r in jaccard_join(docs).collect()} == {(0, 39)}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.6, 0.95)):
        bands, n = bands_for(threshold, recall)
        assert 1 - (1 - threshold**n) ** bands >= recall


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def plain_substring(data, window):
    """(words, words that go, digest of the rest) of each document of a dict of texts, straight from the definition."""
    data = {i: WORD.findall(t or "") for i, t in data.items()}
    starts = {}
    for i, w in data.items():
        for p in range(len(w) - window + 1):
            run = tuple(w[p : p + window])
            starts[run] = min(i, starts.get(run, i))
    out = {}
    for i, w in data.items():
        gone = {k for p in range(len(w) - window + 1) if starts[tuple(w[p : p + window])] < i for k in range(p, p + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [30, 50, 200])
def test_substring_of_odd_rows(rows, window):
    assert levels(window) == {30: [30], 50: [25, 50], 200: [25, 50, 100, 200]}[window]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(rows, window).collect() if r.doc_id is not None}
    assert got == plain_substring({r.doc_id: r.text for r in rows.collect() if r.doc_id is not None}, window)


def test_substring_of_texts_that_share_no_anchor(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{k}w{i}" for i in range(300))) for k in range(3)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(docs, 200).collect()} == {0}


def test_substring_carries_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = substring_dedup(docs).select("doc_id", "n_removed", "kept_text")
    got = substring_dedup(docs, carry=["doc_id", "text", "lang"])
    assert got.columns == ["doc_id", "text", "lang", "n_removed", "kept_text"]
    assert sorted(want.collect(), key=repr) == sorted(got.drop("text", "lang").collect(), key=repr)


def test_language_of_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op5_language_id(spark, sf_dir).collect() if r.held_out]
    assert got and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)


def plain_bits(learned, text):
    """Code length of a text under counts of the learned texts, straight from the definition."""
    counts = collections.defaultdict(collections.Counter)
    for t in learned:
        b = b"   " + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[b[i - k : i]][b[i]] += 1

    def p(ctx, x):
        up = (lambda y: 1 / 256) if not ctx else (lambda y: p(ctx[1:], y))
        seen = counts.get(ctx)
        if not seen:
            return up(x)
        whole = sum(seen.values()) + len(seen)
        return seen[x] / whole if x in seen else up(x) * len(seen) / whole / (1 - sum(up(y) for y in seen))

    b = b"   " + text.encode()
    return -sum(np.log2(p(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def test_code_lengths_equal_the_definition(spark):
    learned = {"aa": ["ab abba baab", "abab"], "bb": ["xyz yxz", "zzz äy"], "cc": ["ab xyz"]}
    rows = [(l, t) for l, ts in learned.items() for t in ts]
    batch = pa.RecordBatch.from_pydict({"lang": [l for l, _ in rows], "text": [t for _, t in rows]})
    got = pa.Table.from_batches(_count([batch])).to_pandas().groupby(["lang", "code"], as_index=False).n.sum()
    langs = sorted(learned)
    trees = context_trees(langs, got.lang.map(langs.index).to_numpy(), got.code.to_numpy(), got.n.to_numpy())
    texts = ["abba", "xyz", "", "quite else", "ä", "ab zz"]
    buf, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    want = [[plain_bits(learned[l], t) for l in langs] for t in texts]
    assert np.allclose(code_lengths(trees, buf, off), want, rtol=1e-5)
    assert np.allclose(code_lengths(trees, buf, off, finders(trees)), want, rtol=1e-5)


def test_language_without_letters(rows):
    got = {r.doc_id: r for r in predict_language(rows).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (3, 4, 5, 11))
    assert got[10].lang_pred != "und" and got[0].lang_pred != "und"


def test_fingerprints_estimate_the_likeness(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got, off = {r.doc_id: r for r in queries.op6_fingerprints(spark, sf_dir).collect()}, []
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = grams(t), grams(edited)
        every = set(a) | set(b)
        if len(every) > 100:
            off.append(got[i].near_edited - sum(min(a[x], b[x]) for x in every) / sum(max(a[x], b[x]) for x in every))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_fingerprints_of_skewed_and_short_texts(spark):
    word = lambda *x: hashlib.md5(repr(x).encode()).hexdigest()[:8]
    want, rows = {}, []
    for k in range(12):
        common = " ".join(word(k, i) for i in range(104))
        a, b = (" ".join([common, *[word(k)] * n]) for n in (904, 454))
        pairs = [(a, b), (" ".join([word(k)] * 40), " ".join([word(k)] * 24)), (" ".join(word(k, i) for i in range(6)), " ".join(word(k, i) for i in range(7)))]
        for j, (x, y) in enumerate(pairs):
            p, q = grams(x), grams(y)
            want.setdefault(j, []).append((len(rows), sum((p & q).values()) / sum((p | q).values())))
            rows += [(len(rows), x), (len(rows) + 1, y)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(r.fingerprint) == 6 * 128 for r in got.values())
    for off in ([got[i].near_next - w for i, w in v] for v in want.values()):
        assert abs(np.mean(off)) < 0.05 and max(map(abs, off)) < 0.2


def test_equal_texts_have_equal_fingerprints(rows):
    got = {r.doc_id: r for r in fingerprints(rows).collect()}
    assert got[0].fingerprint == got[2].fingerprint != got[1].fingerprint
    assert got[13].fingerprint == got[14].fingerprint and got[13].near_next == 1
    assert got[3].fingerprint == got[4].fingerprint == ""


def test_packing_equals_plain_best_fit():
    """Every step of pack() against the rule, by looking at all bins and all sizes still to come."""
    rng, lengths, overhead = np.random.default_rng(3), (64, 256, 1024), 8
    for k in range(12):
        sizes = [int(x) for x in rng.integers(1, (60, 300, 1000)[k % 3], 150)]
        got, bins = pack(sizes, lengths, overhead), []
        left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        while left:
            i = left.pop(0)
            s, (b, offset) = sizes[i], got[i]
            rooms = [c - n for c, n in bins if c - n >= s]
            if rooms:
                assert bins[b][0] - bins[b][1] == min(rooms)
            else:
                assert b == len(bins)
                costs = []
                for c in (c for c in lengths if c >= s):
                    holds = s
                    for j in left:
                        holds += sizes[j] if holds + sizes[j] <= c else 0
                    costs.append(((c + overhead) / holds, c))
                bins.append([min(costs)[1], 0])
            assert offset == bins[b][1]
            bins[b][1] += s


def test_packing_fits_and_downsizes():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 512, 400)] + [512, 4096, 1, 1]
    at, fill = pack(sizes), collections.Counter()
    used = collections.defaultdict(list)
    for s, (b, o) in zip(sizes, at):
        fill[b] += s
        used[b].append((o, o + s))
    assert all(x[1] == y[0] for spans in used.values() for x, y in zip(sorted(spans), sorted(spans)[1:]))
    cost = sum(min(c for c in (512, 1024, 2048, 4096) if c >= n) for n in fill.values())
    assert cost <= 1.03 * sum(sizes)


def test_packing_covers_every_word(spark, sf_dir):
    docs = {r.doc_id: len(WORD.findall(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = collections.defaultdict(list)
    for r in queries.op7_best_fit_packing(spark, sf_dir).collect():
        got[r.doc_id].append((r.start, r.length))
        assert r.bin_id is None or r.bin_offset + r.length <= r.bin_length
    for i, n in docs.items():
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == n


def test_license_places(rows):
    got = {r.doc_id: r for r in license_scan(rows).collect()}
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels, got[8].score) == (4, 2, 0, 2, "mit", 1)
    assert (got[9].n_base, got[9].base_labels, got[9].labels) == (1, "cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0)


def plain_licenses(text, k=4, share=0.8, slack=2):
    """Base places and all labels of a text, straight from the definition: every position against every template."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    at = lambda p, run: words[p : p + len(run)] == run
    places = [(p, lab) for phrase, lab in PHRASES for p in range(len(words)) if at(p, phrase.split())]
    labels, best = {lab for _, lab in places}, 1.0 if places else 0.0
    for lab, template in TEMPLATES:
        t = template.split()
        n = min(k, len(t))
        grams = len(t) - n + 1
        votes = sorted((p - j, p, j) for j in range(grams) for p in range(len(words)) if at(p, t[j : j + n]))
        spans, last = [], None
        for diagonal, p, j in votes:
            if last is None or diagonal - last > slack:
                spans.append([])
            spans[-1].append((p, j))
            last = diagonal
        for span in spans:
            covered = len({j for _, j in span}) / grams
            if max(p for p, _ in span) - min(p for p, _ in span) + 1 <= 1.5 * grams:
                best = max(best, covered)
                labels |= {lab} if covered >= share else set()
    starts = [p for p, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({lab for _, lab in places})), ",".join(sorted(labels)), best


def test_license_scan_equals_the_definition(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    body = [t.split() for _, t in TEMPLATES]
    odd = [" ".join(w) for w in body] + [" ".join(w[: len(w) // 2] + ["extra"] + w[len(w) // 2 :]).upper() for w in body] + [" ".join(w[:-2] + w) for w in body]
    odd += ["CC by-CC_by. cc\u212abY cc by", "\u212aIT license MIT  License gnu general public license", None, "", "mit license " * 500]
    docs += [(10_000_000 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert any(r[5] for r in got.values()) and len(got) == len(docs)
    for i, t in docs:
        assert got[i] == pytest.approx(plain_licenses(t)), t


def test_license_span_with_a_word_put_in(spark):
    text = "redistribution and use in source and binary forms with or without any modification are permitted provided that the following conditions are met"
    assert license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == "bsd"


def test_mix_comes_near_its_targets(spark, sf_dir):
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m"), F.max(F.col("taken") - 3 * F.col("size")).alias("x")).collect():
        assert abs(r.t - r.w) <= r.m and r.x <= 0


def test_mixed_rows_are_as_many_as_copies(rows):
    rows = rows.withColumns({"_h": F.lit("mine"), "hash": F.lit("mine"), "copies": F.lit(-1)})
    plan, out = mix(rows), mixed(rows)
    assert out.columns == rows.columns and {(r._h, r.hash, r.copies) for r in out.collect()} == {("mine", "mine", -1)}
    assert out.count() == plan.agg(F.sum("copies")).first()[0]


def test_warc_of_odd_pages(spark):
    pages = [(1, "u", "same"), (2, None, "same"), (3, "a\r\nb", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n é"), (6, "u", "x" * 3_000_000), (None, "u", "same"), (2, None, "same")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, bytes string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=str)
    assert got == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 36, "response", None), (6, 3_000_000, "response", None), (None, 4, "response", None)], key=str)
    assert warc_round_trip(df.where("false")).collect() == []


def test_warc_files_are_bounded_by_bytes_and_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    monkeypatch.setattr(warc, "LARGE", 100)
    pages = [(i, "u", chr(97 + i % 26) * (3 * i if i % 7 else 400 - i)) for i in range(60)] + [(7, "u", "another"), (60, "u", "z" * 5000)]
    path = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    sizes, seen = [], []
    for data in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect():
        got = list(warc.parse(data["content"]))
        sizes.append((len(got), max((len(block) for _, block in got), default=0)))
        seen += [f["warc-record-id"] for f, _ in got]
    assert all(n <= 10 if big <= 100 else n == 1 for n, big in sizes)
    assert len(seen) == len(set(seen)) == len(pages)


def test_quality_of_labelled_documents(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r.keep, labels[r.doc_id]) for r in queries.op3_quality_classifier(spark, sf_dir).collect() if r.doc_id in labels]
    assert sum(k == bool(q) for k, q in got) >= 0.93 * len(got)
    assert sum(not k for k, q in got if q) <= 0.03 * sum(q for _, q in got)


def test_quality_of_documents_whose_labels_are_hidden(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    truth = {r.doc_id: r.quality for r in labels.where(hidden).collect()}
    got = [(r.quality_view.keep, r.quality_view.score, truth[r.doc_id]) for r in with_quality(docs, labels.where(~hidden)).collect() if r.doc_id in truth]
    assert len(got) > 50 and sum(k == bool(q) for k, _, q in got) >= 0.95 * len(got)
    assert sum(not k for k, _, q in got if q) <= 0.03 * sum(q for _, _, q in got)


def test_quality_of_odd_rows_with_both_labels(rows):
    labels = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 7 == 1, None).otherwise(0).alias("quality"))
    got = with_quality(rows.union(rows.where("doc_id < 3")), labels).collect()
    assert len(got) == rows.count() + 4 and all(0 <= r.quality_view.score <= 1 and r.size == r["size"] for r in got)
    same = collections.defaultdict(set)
    for r in got:
        same[r.doc_id, r.text, r.n_chars].add(r.quality_view)
    assert all(len(v) == 1 for v in same.values())


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, rows):
    """Documents with copies, nulls and repeated rows, and an extra column of another stage's name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = rows.withColumn("doc_id", F.col("doc_id") + 10_000_000).select(*COLUMNS)
    return docs.unionByName(odd).unionByName(docs.where("doc_id % 7 = 0")).withColumn("quality_view", F.lit(1)).withColumn("_id", F.lit(0)).cache()


def bag(rows):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_stage_quality_keeps_what_the_classifier_keeps(spark, sf_dir, corpus):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = bag(dict(cp.STAGES)["quality_classifier"](spark, corpus, sf_dir).collect())
    assert got == bag(with_quality(corpus.select(*COLUMNS), labels).where("quality_view.keep").collect())
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    all_good = [k for k in bag(corpus.collect()).elements() if k[0] in good]
    assert sum(k in got for k in all_good) >= 0.97 * len(all_good)


def test_stage_near_duplicates_equals_brute_force(spark, sf_dir, corpus):
    got = bag(dict(cp.STAGES)["near_duplicates"](spark, corpus, sf_dir).collect())
    data = list(bag(corpus.collect()))
    nodes = sorted({(k[0], k[1]) for k in data if k[0] is not None and k[1] is not None})
    sets = {t: set(grams(t)) for _, t in nodes}
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            a, b = sets[x[1]], sets[y[1]]
            if x[1] == y[1] or (a & b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                one, two = find(x), find(y)
                root[max(one, two)] = min(one, two)
    want = collections.Counter({k: n if k[0] is None or k[1] is None else 1 for k, n in bag(corpus.collect()).items() if k[0] is None or k[1] is None or find(k[:2])[0] == k[0]})
    assert got == want


def test_stage_repeated_passages_equals_brute_force(spark, sf_dir, corpus):
    got = bag(dict(cp.STAGES)["repeated_passages"](spark, corpus, sf_dir).collect())
    plain = plain_substring({r.doc_id: r.text for r in corpus.collect() if r.doc_id is not None}, 50)
    want, sizes = collections.Counter(), collections.Counter()
    for k, n in bag(corpus.collect()).items():
        words, gone, _ = plain.get(k[0], (0, 0, ""))
        if not gone:
            want[k] += n
        elif gone < words:
            sizes[k[0], words - gone] += n
    cut = {k: n for k, n in got.items() if k not in want}
    assert {k: n for k, n in got.items() if k in want} == want
    assert collections.Counter({}) + sum((collections.Counter({(k[0], len(k[1].split(" "))): n}) for k, n in cut.items()), collections.Counter()) == sizes
    assert all(hashlib.sha256(k[1].encode()).hexdigest() == plain[k[0]][2] and k[4] == len(k[1]) for k in cut)


def test_stage_source_mixing_equals_sql(spark, sf_dir, corpus):
    got = bag(dict(cp.STAGES)["source_mixing"](spark, corpus, sf_dir).collect())
    con = duckdb.connect()
    con.register("documents", corpus.select(*COLUMNS).toArrow())
    copies = queries.ORACLE_SQL["op10_mixing"].replace("SELECT doc_id, size, source_size, target,", "SELECT doc_id, text, lang, source, n_chars,").replace("(size * least(3,", "(least(3,").replace("SELECT doc_id, source, coalesce", "SELECT doc_id, text, lang, n_chars, source, coalesce")
    want = collections.Counter()
    for *k, n in con.execute(copies).fetchall():
        want[tuple(k)] += n
    assert got == +want


def test_stage_packing_packs_every_row(spark, sf_dir, corpus):
    got = collections.Counter()
    bins = collections.defaultdict(list)
    for r in dict(cp.STAGES)["packing"](spark, corpus, sf_dir).collect():
        got[r.doc_id] += r.length
        if r.bin_id is not None:
            bins[r.bin_id, r.bin_length].append((r.bin_offset, r.bin_offset + r.length))
    want = collections.Counter()
    for r in corpus.collect():
        want[r.doc_id] += len(WORD.findall(r.text or ""))
    assert got == want and len({b for b, _ in bins}) == len(bins)
    for (_, size), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and size == min(c for c in (512, 1024, 2048, 4096) if c >= spans[-1][1])


def test_stages_of_an_empty_table(spark, sf_dir, corpus):
    for name, stage in cp.STAGES:
        assert stage(spark, corpus.where("false"), sf_dir).collect() == [], name


def test_pipeline_runs_its_stages_in_order(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "repeated_passages", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(cp.STAGES) - 1:
            docs = spark.createDataFrame(out.collect(), out.schema)
    want = collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in out.collect())
    assert want and collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in cp.run(spark, sf_dir).collect()) == want
