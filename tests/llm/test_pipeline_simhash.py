"""The near-copy stage of the pipeline links what SimHash links, beside the shingle sets."""

import numpy as np

import corpus_pipeline
from telemill.llm import copies
from tests.llm.test_copies import SCHEMA, shingles
from tests.llm.test_operators import plain_simhash


def plain_kept(rows):
    """The smallest id of each component, by all pairs of rows: two bits or fewer apart, or 0.8 alike."""
    sets, prints = [shingles(t) for _, t in rows], [plain_simhash(t) for _, t in rows]
    root, kinds = list(range(len(rows))), {"bits": 0, "sets": 0, "both": 0}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] | sets[j]
            bits = (prints[i] ^ prints[j]).bit_count() <= 2
            alike = not both or len(sets[i] & sets[j]) >= copies.SIMILARITY * len(both)
            if bits or alike:
                kinds["both" if bits and alike else "bits" if bits else "sets"] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values()), kinds


def test_stage_links_fingerprints_within_two_bits(spark):
    rng = np.random.default_rng(4)
    texts = []
    for group in range(12):
        refrain = " ".join(f"g{group}x{i}" for i in range(9))
        for _ in range(6):  # one refrain many times over, and other words that make the sets differ
            texts.append(f"{refrain} " * 60 + " ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(5, 60))))
        base = [f"b{x}" for x in rng.integers(0, 10**6, 150)]
        for n in (0, 1, 3):
            words = list(base)
            for at in rng.choice(150, n, replace=False):
                words[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
        texts.append(texts[-1].upper() if group % 2 else f"{refrain} {refrain}")
    texts += ["", None, " \n", "one", "two"]
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts))
    want, kinds = plain_kept(rows)
    assert min(kinds.values()) >= 10
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()) == want


def test_rows_of_one_set_with_several_fingerprints(spark):
    line = " ".join(f"w{i}" for i in range(7))
    texts = [f"{line} " * n + f"end{m}" for n in (1, 2, 30) for m in (0, 1)] + [f"{line} " * n for n in (2, 3, 40)]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    found = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == plain_kept(rows)[0]
