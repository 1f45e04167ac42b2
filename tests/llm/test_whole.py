"""The whole job on inputs where a shortcut would leave a part of it out."""

import numpy as np
import pyarrow as pa

from wayfold.llm import neardup, sharding


def _brute(texts):
    """The smallest number of each text's component, by all pairs that share a shingle."""
    sets = neardup.shingle_sets(pa.array(texts))
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(word, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(word))])
    n = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, w in enumerate(np.split(word, np.cumsum(n)[:-1])):
        both = np.bincount(np.concatenate([of[order[edges[k] : edges[k + 1]]] for k in w]), minlength=len(sets))
        for j in np.flatnonzero(100 * both >= 75 * (n[i] + n - both)):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_op9_large_group_with_weak_links(spark):
    rng = np.random.default_rng(7)

    def changed(words, k):
        w = list(words)
        for at in rng.choice(np.arange(5, len(w) - 5, 5), k, replace=False):
            w[at] = f"e{rng.integers(1 << 40)}"
        return w

    # x is just below a link with all of the group but y, which has one of its changes.
    base = [f"b{k}" for k in range(200)]
    texts = [changed(base, 1) for _ in range(1800)]
    for _ in range(150):
        x = changed(base, 6)
        at = next(k for k in range(200) if x[k] != base[k])
        texts += [x, [*base[:at], x[at], *base[at + 1 :]]]
    texts = [" ".join(texts[i]) for i in rng.permutation(len(texts))]
    want = _brute(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def _components(spark, texts):
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def test_op9_links_under_a_shared_passage(spark):
    # 2,400 texts of one passage and own words (0.74 to each other) and 200 that each link to one of them.
    rng = np.random.default_rng(11)
    passage = [f"b{k}" for k in range(220)]
    own = [[f"o{i}_{k}" for k in range(38)] for i in range(2400)]
    texts = [" ".join(passage + o) for o in own] + [" ".join(passage + own[12 * i][:4] + [f"x{i}_{k}" for k in range(34)]) for i in range(200)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    want = _brute(texts)
    assert sum(w != i for i, w in enumerate(want)) == 200
    assert _components(spark, texts) == want


def test_op9_all_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    docs = sorted((r.doc_id, r.text) for r in docs)
    texts = [t or "" for _, t in docs]
    some = [i for i, t in enumerate(texts) if t.split()]
    want = list(range(len(texts)))
    for i, w in zip(some, _brute([texts[i] for i in some]), strict=True):
        want[i] = some[w]
    assert _components(spark, texts) == want


def test_op7_large_groups_in_as_few_shards_as_hold_them(spark):
    sizes = {"a": 600, "b": 220, "c": 200, "d": 140}  # of 1,800 rows in 8 shards of 225
    texts = [t for t, n in sizes.items() for _ in range(n)] + [f"{i % 40}" for i in range(320)] + [f"alone {i}" for i in range(320)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shards = {t: {got[i] for i, x in rows if x == t} for t in sizes}
    assert {t: len(s) for t, s in shards.items()} == {"a": 3, "b": 1, "c": 1, "d": 1}
    assert sorted(np.bincount(list(got.values())).tolist()) == [225] * 8
