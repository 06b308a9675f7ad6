"""Hard negatives, packing and collocations against plain Python on small tables, odd cases included."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemill.llm import collocations, hard_negatives, packing

SCHEMA = "doc_id bigint, text string, lang string, f int, p string, part int, id string"
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n ", "en"),
    (4, "one", "en"),
    (4, "one", "en"),
    (5, "The big dog; the BIG dog, the big dog.\nthe big\tdog the  big cat" * 40, "en"),
    (None, "der große Hund. der große Hund", "de"),
    (7, "x" * 5000, "de"),
    (8, "日本語 😀 <|endoftext|>   \x1c á", None),
    (9, "a b a b a b a b", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, lang, 1, "x", 2, "y") for d, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing -------------------------------------------------------------------


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(rows, texts, capacity):
    ids = whole_ids(texts)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    left = Counter()
    for r in rows:
        assert r.offset == 0 and r.length <= capacity and r.length & (r.length - 1) == 0
        left[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for (doc_id, _), own in zip(texts_with_ids(texts), ids):
        start = 0
        for length in packing.binary_lengths(len(own), capacity):
            piece = np.array(own[start : start + length], "<u4").tobytes()
            left[doc_id, start, length, zlib.crc32(piece), len(own)] -= 1
            start += length
        assert start == len(own)
    assert not any(left.values())


def texts_with_ids(texts):
    return zip(texts_with_ids.ids, texts)


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_packing_of_odd_rows(odd, capacity):
    texts_with_ids.ids = [d for d, *_ in ODD]
    rows = packing.pack(odd, capacity=capacity).collect()
    check_packing(rows, [t for _, t, _ in ODD], capacity)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(odd.repartition(3), capacity=capacity, with_ids=False, ranks=None).count() == len(rows)


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    texts_with_ids.ids = [r.doc_id for r in texts]
    check_packing(packing.pack(docs, with_ids=False).collect(), [r.text for r in texts], 2048)


def test_packing_of_nothing(empty):
    assert packing.pack(empty).collect() == []
    with pytest.raises(ValueError):
        packing.pack(empty, capacity=100)


def test_plain_and_unusual_texts_get_the_same_ids():
    encoder, slow = packing.Encoder(), packing.Encoder(ranks=None)
    rng = np.random.default_rng(1)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x221), *range(0x2010, 0x2028), 0x20AC]]
    for _ in range(400):
        text = "".join(rng.choice(plain, 60, p=None)) + " they'll  don't\n\n 12 3 " + "ab " * 3
        assert encoder.ids(text).tolist() == slow.ids(text).tolist()
        assert not packing._UNUSUAL.search(text)


# --- collocations --------------------------------------------------------------


def brute_collocations(rows, longest, min_count, absorbed, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i : i + size]))
                    counts[key] = counts.get(key, 0) + 1
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    found = {}
    for (lang, p), a in often.items():
        holders = [
            f
            for (other, q), f in often.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ]
        if any(100 * f >= absorbed * a for f in holders):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("known_words", [1000, 3, 0])
@pytest.mark.parametrize("longest, min_count, absorbed", [(5, 2, 100), (3, 1, 60), (2, 2, 100)])
def test_collocations_of_odd_rows(odd, known_words, longest, min_count, absorbed):
    found = collocations.collocations(odd.repartition(3), longest, min_count, absorbed, 7, known_words)
    assert sorted(map(tuple, found.collect())) == brute_collocations(ODD, longest, min_count, absorbed, 7)


def test_collocations_across_batches(odd, monkeypatch):
    """Counts do not depend on when a task hands on what it holds."""
    monkeypatch.setattr(collocations, "FLUSH", 3)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 2)
    found = collocations.collocations(odd, min_count=2)
    assert sorted(map(tuple, found.collect())) == brute_collocations(ODD, 5, 2, 100, 2000)


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).collect() == []


def test_scores_pass_64_bits(spark):
    big = 3 * 10**12 + 1
    cuts = [{"k": 1, "l": big, "r": big + 2}, {"k": 2, "l": big - 1, "r": big + 5}]
    schema = "lang string, phrase string, a bigint, n bigint, cuts array<struct<k:int,l:bigint,r:bigint>>"
    row = collocations._scored(spark.createDataFrame([("en", "x y z", big - 7, big * 1000, cuts)], schema)).first()
    best = min((1000 * (big - 7) * big * 1000 // (c["l"] * c["r"]), c["k"]) for c in cuts)
    assert row.score == best[0] and row.l == cuts[best[1] - 1]["l"]


# --- hard negatives ------------------------------------------------------------

VECTORS = "vec_id bigint, label int, embedding array<double>, id int, row string, v int"


def brute_negatives(rows, every, positives, negatives, low, high):
    one = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        one[vec_id] = min(one.get(vec_id, (label, v)), (label, v))
    codes = {i: (label, [math.floor(x * 256) if abs(x) < 1e15 else int(x) * 256 for x in v]) for i, (label, v) in one.items()}
    out = []
    clamp = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    for a in sorted(codes):
        if a % every:
            continue
        label, own = codes[a]
        scored = [
            (-clamp(sum(x * y for x, y in zip(own, v))), i, other) for i, (other, v) in codes.items() if i != a and len(v) == len(own)
        ]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            left = sorted((s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p)
            for rank, (s, i) in enumerate(left[:negatives], 1):
                out.append((a, positive, rank, i, -p, -s))
    return sorted(out)


def random_vectors(seed, count, size, step):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    found = []
    for i in range(count):
        v = centres[i % 4] * 0.7 + rng.normal(size=size)
        found.append((i, int(rng.integers(0, 3)), [float(x) for x in np.round(v / step) * step]))
    return found


@pytest.mark.parametrize("size, step", [(20, 1e-6), (3, 0.5), (1, 1.0)])
def test_hard_negatives(spark, monkeypatch, size, step):
    monkeypatch.setattr(hard_negatives, "TILE", 7)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 31)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    rows = random_vectors(size, 300, size, step)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(4)
    found = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    expected = brute_negatives(rows, 5, 5, 10, 30, 90)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 500


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [9.0, 9.0]), (10, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]),
        (2, 1, None), (3, 1, []), (4, 1, [1.0, None]), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [1.0, 2.0, 3.0]), (8, 1, [2.0, 2.0]),
        (9, 2, [0.5, 1.0]), (11, 2, [0.5, 1.0]), (12, 3, [1e300, 1.0]), (20, 3, [1e300, 0.5]), (13, 2, [5e299, 1.0]), (30, 1, [0.0, 0.0]),
        (14, 2, [0.0, 1.0]), (40, 2, [-1.0, -2.0]), (50, 7, [1.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    expected = brute_negatives(rows, 10, 5, 10, 30, 90)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 10
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).collect() == []


def test_summaries_bound_scores():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(40, 23)), np.ones((3, 23)), np.zeros((1, 23))])
    ids = list(range(len(vectors)))
    block = hard_negatives.Block(ids, ids, vectors, 256, [])
    exact = block.scores(slice(0, len(ids)), block, np.arange(len(ids)))
    spans = []
    for level in range(2):
        low, high = block.bounds(slice(0, len(ids)), block, np.arange(len(ids)), level)
        assert (low <= exact).all() and (exact <= high).all()
        spans.append((high - low).sum())
    assert spans[1] < spans[0]
