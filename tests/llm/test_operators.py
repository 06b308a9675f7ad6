"""The operators against plain Python on small tables: the given ones, and odd cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from telemill.llm import language, lines, mixing, neighbours, pii, quality, segmentation, simhash, substrings, warc
from telemill.llm.common import connected_components
from telemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, kept string, node int, copy int"
PASSAGE = " ".join(f"w{i}" for i in range(40))
ODD = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "en", "a"),
    (4, "one", "en", "a"),
    (4, "one", "en", "a"),
    (5, "one two three four five six. " * 3000, "en", "b"),
    (6, PASSAGE + " tail", "de", None),
    (7, "head " + PASSAGE, "de", "b"),
    (7, "head " + PASSAGE, "de", "b"),
    (None, PASSAGE, "de", "b"),
    (8, "naïve façade 日本語 😀 mail a.b@c-d.org, +1 (555) 010-9999 and 4111 1111 1111 1111 at 10.0.0.256 or 0.10.0.1", "fr", "c"),
    (9, "First line of many words that is shared by both texts.\nOnly here, and not elsewhere at all.\n\nLast.", "en", "c"),
    (10, "Another start of it, quite unlike.\nFirst line of many words that is shared by both texts.\nEnd.", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, lang, source, len(t or ""), "x", "y", 1, 2) for d, t, lang, source in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return (text or "").encode().split()


# --- SimHash ---------------------------------------------------------------------


def plain_simhash(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    k = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, a in prints:
        for e, b in prints:
            if d < e and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in prints}


def test_simhash(spark, documents, odd, empty):
    for docs in (documents, odd):
        found = simhash.near_duplicates(docs).collect()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((r.fp & (1 << 64) - 1) for r in found) == sorted(plain_simhash(t) for _, t in rows)
        want = plain_components([(d, plain_simhash(t)) for d, t in rows if d is not None])
        assert all(want[r.doc_id] == r.component_id for r in found if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.drop_near_duplicates(odd).collect()]
    assert 2 not in kept and 3 not in kept and kept.count(1) == 1


def test_crowded_buckets_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))} | set(rng.integers(1 << 62, size=40).tolist())
    prints = spark.createDataFrame([(int(p),) for p in near], "fp bigint")
    want = {(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 2}
    for bucket in (1, 5, 4096):
        assert {tuple(r) for r in simhash.near_pairs(prints, bucket=bucket).collect()} == want
    assert {tuple(r) for r in simhash.near_pairs(prints, 3, 2).collect()} == {
        (a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 3
    }


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101)], "a bigint, b bigint")
    found = dict(connected_components(links).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- personal data -----------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    def n(m):
        return re.sub("[^0-9]", "", m)

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(n(m)) <= 19 and luhn(n(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in rules.items()}


def test_base_spans(spark, documents, odd, empty):
    tricky = [
        "a@b.c_d@e.f", "x@y z@w.v.", "1.2.3.4.5.6.7.8", "0.0.0.0 00.1.2.3 256.1.1.1", "+1-2-3-4-5-6-7-8-9+1(2)3 45678901",
        "4" * 30000, "1 " * 5000, "a" * 50000 + "@", "5500-0000-0000-0004 5500 0000 0000 0005", "ß😀 a@b.co 😀 +49 30 1234567",
        " ".join(["10.1.2.3"] * 900),
    ]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string")
    for docs in (documents, odd, extra):
        found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
        for r in docs.collect():
            got = {k: [tuple(s) for s in found[r.doc_id][k]] for k in pii.BASE}
            assert got == plain_spans(r.text), r.text[:80]
    assert pii.find_personal_data(empty).count() == 0


def test_added_spans_and_redaction(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        token = "".join(rng.choice(list("0123456789abcdef"), 40))
        rows.append((i, f'some words token = "{token}" and more, call +1 (555) 010-{1000 + i} or write to u{i}@mail.example'))
    rows += [(1000 + i, "Clean words only, in the year 2024, version 1.2.3 and no more.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_personal_data(docs)
    for r in found.collect():
        assert [s.kind for s in r.added] == (["secret"] if r.doc_id < 1000 else [])
    clean = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert clean[5] == "some words [redacted] and more, call [redacted] or write to [redacted]"
    assert clean[1005] == rows[305][1]


# --- lines -------------------------------------------------------------------------


def test_patience_keeps_order():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([], [1]) == [] and lines.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 8, 12).tolist(), rng.integers(0, 8, 12).tolist()
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def plain_line_dedup(rows):
    split = {}
    for d, t in rows:
        if d is not None:
            split[d] = [x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n") if words(x)]
    first, heads = {}, []
    for d in sorted(split):
        if split[d] and first.setdefault(tuple(split[d]), d) == d:
            heads.append(d)
    holders = {}
    for d in heads:
        for x in set(split[d]):
            holders.setdefault(x, []).append(d)
    limit = lines.RARE_FLOOR + lines.RARE_SHARE * len(heads)
    gone = {d: set() for d in split}
    for d in sorted(split):
        earlier = {holders[x][0] for x in split[d] if d in heads and 1 < len(holders[x]) <= limit and holders[x][0] < d}
        if split[d] and d not in heads:
            earlier = {first[tuple(split[d])]}
        for e in earlier:
            code = {x: i for i, x in enumerate({*split[e], *split[d]})}
            a, b = ([code[x] for x in split[k]] for k in (e, d))
            gone[d].update(lines.common_blocks(a, b, [len(words(x)) for x in split[d]], lines.MIN_WORDS))
    return gone


def test_line_dedup(documents, odd, empty):
    for docs in (documents, odd):
        want = plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
        for r in lines.dedup_lines(docs).collect():
            assert r.n_removed == len(want.get(r.doc_id, ()))
    found = {r.doc_id: r for r in lines.dedup_lines(odd).collect()}
    assert found[10].kept_text == "Another start of it, quite unlike.\nEnd."
    assert found[9].kept_text == ODD[11][1] and found[1].kept_text is None
    assert lines.dedup_lines(empty).count() == 0


# --- language ------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    names, weights = language.train([("a", "abcabc" * 20), ("b", "xyzzy " * 20)], epochs=3)
    windows = rng.integers(97, 123, (4, 12)).astype(np.uint8)

    def loss(w):
        return -np.log(language.probabilities(language.forward(w, windows))[:, 1].astype(np.float64)).sum()

    keep = {}
    error = language.probabilities(language.forward(weights, windows, keep))
    error[:, 1] -= 1
    grads = language.backward(weights, windows, keep, error)
    for name, at in (("u", (0, 3, 2)), ("u", (1, 17, 1)), ("c", (1, 2, 0)), ("o", (0, 1, 3)), ("x", (1, 5, int(windows[0, 0]))), ("b", (1, 0))):
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in "ab")
        up[name][at] += 0.02
        down[name][at] -= 0.02
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 0.04, rel=0.02, abs=0.01)


def test_language_on_held_out_documents(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.97
    rows = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.identify(empty).count() == 0


# --- mixing ----------------------------------------------------------------------------


def test_mixing(spark, documents, odd, empty):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "small").alias("source")
    )
    copies = mixing.mix_sources(docs, {"big": 1, "small": 2, None: 1}).groupBy("source").count()
    got = {r["source"]: r["count"] for r in copies.collect()}
    assert got["big"] == pytest.approx(5000, rel=0.06) and got["small"] == pytest.approx(10000, rel=0.06)
    assert got[None] == pytest.approx(5000, rel=0.06)
    per_doc = Counter(mixing.mix_sources(docs, {"big": 1}, 6667).groupBy("doc_id").count().agg(F.collect_list("count")).first()[0])
    for k in (1, 2, 3):
        assert per_doc[k] / 6667 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.02)
    many = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, source string")
    assert mixing.mix_sources(many, {"a": 1}, 5000).count() == pytest.approx(5000, rel=0.08)
    assert mixing.mix_sources(empty).count() == 0
    assert collected(mixing.mix_sources(odd)) == collected(mixing.mix_sources(odd))
    whole = mixing.mix_sources(documents, keep=documents.columns)
    assert whole.select("kept_row.*").columns == documents.columns


# --- WARC -------------------------------------------------------------------------------


def test_audit_finds_exactly_the_differences(spark):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", f"<p>{i}</p>é") for i in range(700)] + [(5, "http://x/5", f"v{i}") for i in range(600)] + [(None, None, None)] * 3,
        "page_id bigint, url string, html string",
    )
    laid = warc.warc_layout(pages)
    assert laid.select(warc.parse_record(F.col("record")).alias("p")).where("p.url = 'http://x/7'").first().p.payload.decode() == "<p>7</p>é"
    assert laid.groupBy("file").count().agg(F.max("count")).first()[0] < 2 * warc.RECORDS
    leaves = warc.leaves(laid)
    assert warc.audit(leaves, leaves).count() == 0
    bad = F.when(F.col("page_id") == 300, F.lit(b"?")).otherwise(F.col("record"))
    other = laid.withColumn("record", bad).where("page_id IS NULL OR page_id <> 301")
    found = warc.audit(warc.leaves(laid.where("page_id IS NULL OR page_id <> 699")), warc.leaves(other)).collect()
    assert sorted((r.file, r.slot, r.kind) for r in found) == [
        ("pages-1-0", 44, "changed"), ("pages-1-0", 45, "missing"), ("pages-2-0", 187, "extra"),
    ]
    offsets = warc.with_offsets(laid).where("file = 'pages-2-0'").orderBy("offset").collect()
    assert all(a.offset + a.length == b.offset for a, b in zip(offsets, offsets[1:]))
    none = leaves.limit(0)
    assert warc.audit(none, none).count() == 0


# --- neighbours ----------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[50:200] = vectors[50]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(vectors)]
    rows += [(900, None, "z"), (901, [0.0] * 8, "z"), (902, [1.0] * 7 + [math.nan], "z"), (903, [1.0] * 7 + [None], "z"), (7, vectors[7].tolist(), "z"), (None, vectors[9].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 25 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    wide = vectors.astype(np.float64)
    for q in range(0, 400, 25):
        d = neighbours.exact_distances(wide, wide[q])
        assert got[q] == sorted((float(d[i]), i) for i in range(400) if i != q)[:10]
    assert set(got) == set(range(0, 400, 25))
    few = neighbours.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert [r.rank for r in few.collect()] == [1, 2]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


# --- quality ---------------------------------------------------------------------------------


def test_quality(documents, odd, empty):
    for docs in (documents, odd):
        rows = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
        for r in docs.collect():
            w = words(r.text)
            windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
            split = [x for x in (r.text or "").split("\n") if words(x)]
            got = rows[r.doc_id]
            assert (got.n_words, got.n_repeat_words) == (len(w), len(covered))
            assert got.word_chars == sum(len(x.decode()) for x in w)
            assert got.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
            assert got.n_dup_lines == len(split) - len(set(split))
            assert got.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality.clean_lines(empty).count() == 0


@pytest.mark.parametrize(
    "line, passes",
    [
        ("A sentence of plain words, as texts have them.", True),
        ("Home | News | Sports | About | Contact", False),
        ("THIS IS ALL CAPITALS!! REALLY!!", False),
        ("one### two$$$ three%%% four&&&", False),
        ("Please read our Privacy Policy", False),
        ("Menu", False),
        ("Yes.", True),
        ("¿Qué tal está usted hoy en día?", True),
    ],
)
def test_line_rules(spark, line, passes):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_passes(F.col("x"))).first()[0] is passes


# --- segmentations ------------------------------------------------------------------------------


def test_segmentations_are_distinct_and_decode(odd, empty, documents):
    rows = segmentation.encode_samples(odd, samples=3)
    found = rows.collect()
    assert all(r.round_trip for r in found)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert by_doc[1] == [()] and by_doc[2] == [()]
    assert len(set(by_doc[9])) == 3 and len(by_doc[4]) % 2 == 0
    texts = {(r.doc_id, r.rank): r.text for r in segmentation.decode(rows.where("doc_id IN (5, 8, 9)")).collect()}
    assert texts[8, 0] == ODD[10][1] and texts[5, 1] == ODD[5][1]
    assert segmentation.encode_samples(empty).count() == 0
    assert segmentation.encode_samples(documents).where("NOT round_trip").count() == 0


def test_sampling_follows_the_model():
    with open(segmentation.MODEL, "rb") as f:
        lattices = segmentation.Units(segmentation.Pieces(f.read(), sharpness=0.5))
    n, first, weighted, prob = 6000, Counter(), Counter(), {}
    for start in range(0, n, 500):
        for found in segmentation.sample_segmentations(["the no"] * 500, list(range(start, start + 500)), lattices, 2):
            first[tuple(found[0][0])] += 1
            for ids, log_prob, inclusion in found:
                prob[tuple(ids)] = math.exp(log_prob)
                weighted[tuple(ids)] += math.exp(log_prob) / inclusion
    assert len(first) > 3
    for ids, p in prob.items():
        assert first[ids] / n == pytest.approx(p, abs=4 * math.sqrt(p / n) + 1e-3)
        assert weighted[ids] / n == pytest.approx(p, abs=6 * math.sqrt(p / n) + 2e-3)


# --- repeated passages ------------------------------------------------------------------------------


def plain_repeats(rows):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = {k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(documents, odd, empty):
    for docs in (documents, odd):
        want = plain_repeats([(r.doc_id, r.text) for r in docs.collect()])
        found = substrings.remove_repeats(docs).collect()
        assert len(found) == docs.count()
        for r in found:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert substrings.remove_repeats(empty).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
