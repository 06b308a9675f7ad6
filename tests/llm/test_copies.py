"""Near copies against a comparison of all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from telemill.llm import copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = (text or "").lower().encode().split()
    n = min(copies.SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_kept(rows):
    """The row kept of each component, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] | sets[j]
            if not both or len(sets[i] & sets[j]) >= copies.SIMILARITY * len(both):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted(min(d for d, _ in g) for g in groups.values())


def planted(rng, n_groups=150):
    """Documents of 200 words, each with a copy in which words all over the text are replaced."""
    rows, pairs = [], []
    for _ in range(n_groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        copy = list(base)
        for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            copy[at] = f"v{rng.integers(0, 10**9)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append(len(a & b) / len(a | b))
    return rows, pairs


def test_stage_drops_copies_of_similarity_08_and_more(spark):
    rows, pairs = planted(np.random.default_rng(1))
    assert sum(0.8 <= p < 0.85 for p in pairs) > 10 and sum(p < 0.8 for p in pairs) > 10
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], SCHEMA).repartition(7)
    found = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == plain_kept(rows)


def test_chains_and_buckets_of_several_components(spark):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in range(120)]
    rows = []
    for d in range(150):  # around one text, most pairs of them less than 0.8 alike
        text = list(base)
        for at in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            text[at] = f"v{rng.integers(0, 40)}"
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = copies.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in found) == plain_kept(rows)


def test_bands_miss_next_to_nothing():
    rng = np.random.default_rng(3)
    missed, factors = 0, copies.permutations()
    for _ in range(300):  # sets of 450 with 400 in common: 0.8
        a, b, c = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 50, 50))
        missed += not (copies.band_keys(np.append(a, b), factors) == copies.band_keys(np.append(a, c), factors)).any()
    assert missed == 0
    assert copies.jaccard(np.unique(np.append(a, b)), np.unique(np.append(a, c))) == pytest.approx(0.8)


def test_one_row_of_each_group_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 3 + [(4, text), (4, text), (5, text + " x"), (None, "no id here at all"), (None, "no id here at all"), (None, None)]
    found = copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [("4", text), ("None", "no id here at all"), ("None", "None")]
    assert sorted((str(r.doc_id), str(r.text)) for r in found) == sorted(want)


def compared(spark, monkeypatch, n):
    """Pairs compared by their whole sets, for n texts of 80 words, 6 of them replaced in each."""
    rng = np.random.default_rng(n)
    base = [f"w{x}" for x in rng.integers(0, 5000, 80)]
    rows = []
    for d in range(n):
        words = list(base)
        for at in rng.choice(80, 6, replace=False):
            words[at] = f"v{rng.integers(0, 10**9)}"
        rows.append((d, " ".join(words), "en", "a", 0))
    counts, similar = [], copies._similar

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(copies, "_similar", counting)
    kept = copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).count()
    monkeypatch.setattr(copies, "_similar", similar)
    assert kept == len(plain_kept([(d, t) for d, t, *_ in rows]))
    return sum(counts)


def test_pairs_compared_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    assert compared(spark, monkeypatch, 600) <= 2 * compared(spark, monkeypatch, 300) + 20


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for size in (3, 40, 500, 5000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for change in (0, size // 10, size // 3, size):
            b = np.concatenate([a[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)])
            x, y = (copies.parity_sketch(np.unique(s)).view(np.uint64) for s in (a, b))
            apart = sum(int(v).bit_count() for v in (x ^ y))
            assert apart <= len(np.setxor1d(a, b))


def test_columns_with_clashing_names(spark):
    schema = "doc_id bigint, text string, k int, head_id int, head_k int, print int, kept_row int, own_id int, row int"
    text = "one two three four five six seven"
    rows = [(1, text, 111, 1, 2, 3, 4, 5, 6), (2, text, 222, 1, 2, 3, 4, 5, 6), (3, "else", 333, 1, 2, 3, 4, 5, 6), (3, "else", 333, 1, 2, 3, 4, 5, 6)]
    found = copies.drop_near_copies(spark.createDataFrame(rows, schema))
    assert found.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, found.collect())) == [rows[0], rows[2]]
