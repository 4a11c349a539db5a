"""Null, repeated and string ids in the operators whose other tests have whole numbers, and the forest against a recursive walk."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import fingerprints, mixing, packing, quality, rules, sharding, toxicity


@pytest.fixture(scope="module", params=["long", "string"])
def odd(request, edges):
    """edges with ids that are null, shared or strings; old is the id before."""
    new = F.when(F.col("doc_id") % 6 == 0, None).when(F.col("doc_id") % 5 == 1, 5).otherwise(F.col("doc_id"))
    new = new if request.param == "long" else F.concat(F.lit("ü-"), new)
    return edges.select(F.col("doc_id").alias("old"), new.alias("doc_id"), "text", "lang", "source", "n_chars").cache()


def ids(odd):
    return {r["old"]: r["doc_id"] for r in odd.select("old", "doc_id").collect()}


def renamed(plain, odd, values):
    """Rows of a result on whole-number ids, with the ids of odd."""
    name = ids(odd)
    return Counter((name[r["doc_id"]], *(r[v] for v in values)) for r in plain.collect())


def as_rows(df, values):
    return Counter(tuple(r) for r in df.select("doc_id", *values).collect())


def test_row_results_do_not_depend_on_ids(odd, edges, labels):
    marks = quality.fit_on(edges, labels)
    values = ("score", "predicted")
    assert as_rows(quality.score(odd, marks), values) == renamed(quality.score(edges, marks), odd, values)
    weights = toxicity.fit_on(edges, labels)
    assert as_rows(toxicity.score(odd, weights), values) == renamed(toxicity.score(edges, weights), odd, values)
    x = np.random.default_rng(3).random((40, 4))
    forest = rules.fit(x, np.arange(40) % 5 > 0, trees=5)
    values = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert as_rows(rules.judge(odd, forest), values) == renamed(rules.judge(edges, forest), odd, values)


def test_mix_of_odd_ids(odd):
    rows = mixing.mix(odd).collect()
    assert Counter(r["old"] for r in rows) == Counter(list(ids(odd)))
    target, taken = {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    assert all(abs(n - target[s]) <= 0.5 + 1e-9 for s, n in taken.items())
    assert Counter((r["old"], r["taken"]) for r in rows) == Counter((r["old"], r["taken"]) for r in mixing.mix(odd.repartition(5)).collect())


def test_shards_of_odd_ids(odd, edges):
    got = sharding.shard(odd)
    assert as_rows(got, ("size", "text_crc32")) == renamed(sharding.shard(edges), odd, ("size", "text_crc32"))
    slots = defaultdict(list)
    for r in got.collect():
        assert 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints_of_odd_ids(odd, edges):
    got = fingerprints.fingerprints(odd, 3)
    assert as_rows(got, ("n_chars", "fingerprint")) == renamed(fingerprints.fingerprints(edges, 3), odd, ("n_chars", "fingerprint"))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.collect())


def test_packing_of_odd_ids(odd, edges):
    got = packing.pack(odd, window=256)
    assert as_rows(got, ("start", "length", "ids_crc32", "doc_tokens")) == renamed(packing.pack(edges, window=256), odd, ("start", "length", "ids_crc32", "doc_tokens"))
    for _, g in got.toPandas().sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


@pytest.mark.parametrize("seed", range(4))
def test_forest_equals_a_recursive_walk(seed):
    """Path lengths of a grown tree's leaves: each point walked by itself, and each leaf's depth plus the mean path of the points that lie there."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(200, 3)), 1)
    feature, cut, left, path = rules.grow(x, np.random.default_rng(seed + 9), 7)

    def walk(point, node=0, depth=0):
        if feature[node] < 0:
            return node, depth
        return walk(point, left[node] + int(point[feature[node]] >= cut[node]), depth + 1)

    ends = [walk(p) for p in x]
    held = Counter(node for node, _ in ends)
    for node, depth in ends:
        n = held[node]
        harmonic = np.log(n - 1) + 0.5772156649 if n > 2 else 0
        assert path[node] == pytest.approx(depth + (2 * harmonic - 2 * (n - 1) / n if n > 2 else float(n == 2)))
        assert depth <= 7 and (depth == 7 or n == 1 or len({tuple(p) for p, (e, _) in zip(x, ends) if e == node}) == 1)
    forest = rules.Forest(*(np.array([v]) for v in (feature, cut, left, path)), points=200)
    want = [2.0 ** (-path[node] / float(rules.mean_path(200))) for node, _ in ends]
    assert forest.scores(x) == pytest.approx(want)
