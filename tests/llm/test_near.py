"""Near copies where very many documents share most of their text, against brute force."""

import numpy as np
import pytest

from clausewright.llm import near
from clausewright.llm.common import components, written


def template(n, shared=804, own=110, inner=28, seed=1):
    """``n`` documents of one template; every two neighbours share some words more, which makes them similar, all others are not quite."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        pair = [f"p{i // 2}x{k}" for k in range(inner)]
        rows.append(" ".join(base + pair + [f"o{i}x{k}" for k in range(own - inner)]))
    order = rng.permutation(n)
    return [(int(i), rows[i]) for i in order]


def similar(rows):
    """All pairs at 0.8, by a matrix of texts and shingles."""
    sets = {i: near.shingles(t) for i, t in rows}
    ids, every = sorted(sets), np.unique(np.concatenate(list(sets.values())))
    has = np.zeros((len(ids), len(every)), np.float32)
    for k, i in enumerate(ids):
        has[k, np.searchsorted(every, sets[i])] = 1
    common, size = has @ has.T, has.sum(axis=1)
    good = (9 * common >= 4 * (size[:, None] + size[None, :])) & (size[:, None] > 0)
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(good, 1)))}


@pytest.mark.parametrize("n", [64, 300, 800])
def test_pairs_within_a_template_are_found(spark, n):
    rows = template(n)
    want = similar(rows)
    assert want == {(2 * i, 2 * i + 1) for i in range(n // 2)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = written(near.signatures(docs), "test-signatures")
    node = {r.node: r.doc_id for r in table.collect()}
    assert {tuple(sorted((node[r.a], node[r.b]))) for r in near.links(docs, table).collect()} == want


@pytest.mark.parametrize("dense", [0, 3, 32])
def test_large_groups_of_several_kinds(spark, dense):
    """A large group that is similar throughout, a template that isn't, sizes that differ, and bridges between groups."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(vocabulary, 300))
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.integers(0, 290, 2).tolist():
            copy[at : at + 3] = list(rng.choice(vocabulary, 3))
        texts.append(copy[: int(rng.integers(250, 301))])
    texts += [t.split() for _, t in template(40, 200, 26, 8)]
    texts += [base[40:] + list(rng.choice(vocabulary, 45)), base[:255] + list(rng.choice(vocabulary, 12)), ["one", "two"], ["one", "two"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    table = written(near.signatures(docs), "test-signatures")
    node = {r.doc_id: r.node for r in table.collect()}
    found = {r.node: r.component for r in components(near.links(docs, table, dense)).collect()}
    parent = {n: n for n in node.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar(rows):
        parent[root(node[a])] = root(node[b])
    groups = lambda of: sorted(sorted(i for i in node if of(node[i]) == c) for c in {of(n) for n in node.values()})
    assert groups(lambda n: found.get(n, n)) == groups(root)


def test_prefix_pairs_are_complete(spark):
    """The join on rare shingles alone reaches every similar pair."""
    rows = template(30, 200, 26, 8) + [(100 + i, t) for i, (_, t) in enumerate(template(30, 230, 27, 8, 2))]
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(600)]
    for i in range(60):
        base = words[5 * i : 5 * i + 200]
        rows.append((200 + i, " ".join(base[: int(rng.integers(150, 200))])))
    sets = [(i, [int(x) - (1 << 64) if x >> 63 else int(x) for x in near.shingles(t).tolist()]) for i, t in rows]
    own = spark.createDataFrame(sets, "node bigint, hashes array<bigint>")
    alone = spark.createDataFrame([(i, i) for i, _ in rows], "node bigint, component bigint")
    asked = near.prefix_pairs(own, alone)
    got = {(r.a, r.b) for r in near.verified(asked, own).collect()}
    assert got == similar(rows) and asked.count() < len(rows) ** 2 / 4
