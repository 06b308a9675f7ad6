"""Line dedup against alignments with all earlier documents."""

import numpy as np

from telemill.llm import lines


def plain(texts):
    """Numbers of the lines that go, by aligning each document with every earlier one."""
    gone = []
    for d, text in enumerate(texts):
        here = text.split("\n")
        out = set()
        for e in range(d):
            code = {x: i for i, x in enumerate({*here, *texts[e].split("\n")})}
            a, b = ([code[x] for x in t] for t in (texts[e].split("\n"), here))
            out.update(lines.common_blocks(a, b, [len(x.split()) for x in here], lines.MIN_WORDS))
        gone.append(out)
    return gone


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: set(r.gone) for r in lines.removed_lines(docs).collect()}
    return [found.get(i, set()) for i in range(len(texts))]


def test_runs_have_the_same_key_wherever_they_stand():
    rng = np.random.default_rng(5)
    hashes, words = rng.integers(-(1 << 63), 1 << 63, 30), rng.integers(1, 12, 30)
    keys = {}
    cuts = np.arange(0, 30 * 20 + 1, 30)
    for row, start, stop, key in zip(*lines.windows(np.tile(hashes, 20), np.tile(words, 20), cuts, 10)):
        keys.setdefault((start, stop), set()).add(key)
    assert all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(keys) > 30


def test_blocks_that_only_later_holders_share(spark):
    one, two, long = "a b c d e f", "g h i j k l", " ".join(f"z{i}" for i in range(12))
    texts = [f"{one}\nalone in first", f"{two}\nalone in second", f"x third\n{one}\n{two}\ny", f"u\nv fourth\n{one}\n{two}"]
    texts += [f"m\n{long}\nn\n{long}\no", f"p\nq {long} r\n{long}\ns", f"t\n{long}\nw w"]
    found = removed(spark, texts)
    assert found == plain(texts)
    assert found[3] == {2, 3} and found[6] == {1}


def test_random_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"p{k}" for _ in range(rng.integers(1, 12))) for k in range(25)]
    texts = ["\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(2, 12))) for _ in range(150)]
    assert removed(spark, texts) == plain(texts)


def test_passage_that_a_third_of_all_documents_share(spark):
    passage = " ".join(f"s{i}" for i in range(14))
    texts = [f"own {d}\n{passage}\nend {d}" if d % 3 == 0 else f"own {d}\nelse {d}" for d in range(600)]
    assert removed(spark, texts) == [{1} if d % 3 == 0 and d else set() for d in range(600)]
