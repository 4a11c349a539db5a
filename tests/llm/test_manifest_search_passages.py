"""The Merkle manifest, ranked search and substring dedup against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lattica.llm import merkle, passages, queries, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(level):
    """Root, and for each leaf its (sibling or None, whether it comes before) by levels."""
    at, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append((level[j] if j < len(level) else None, j < i))
            at[k] = i // 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    """Per row (leaf, subroot, root, proof, folded root), as a list in any order."""
    def leaf(r, more=0):
        return H(*[framed(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in merkle.FIELDS])

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    held, subroots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, paths = plain_tree([leaf(r) for r in own])
        subroots.append(root)
        held.append((own, paths))
    if not held:
        return []
    root, tops = plain_tree(subroots)
    out = []
    for (own, paths), subroot, top in zip(held, subroots, tops):
        for r, path in zip(own, paths):
            x = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for sib, before in path + top:
                x = H(sib, x) if before else H(x, sib or "")
            out.append((r["doc_id"], leaf(r), subroot, root, H("".join(s or "" for s, _ in path + top)), x, x == root))
    return out


@pytest.mark.parametrize("table", ["edges", "repeated"])
def test_manifest_is_the_plain_tree(table, request):
    docs = request.getfixturevalue(table)
    got = Counter(map(tuple, merkle.verify(docs, merkle.tampered()).collect()))
    assert got == Counter(plain_manifest([r.asDict() for r in docs.collect()]))


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
@pytest.mark.parametrize("n", [1, 2, 5, 8, 17])
def test_manifest_at_any_block_size(spark, n, bits):
    rows = [(k if k % 6 else None, f"t{k}", ["en", None, "", "é", "z"][k % 5] if n > 5 else "en", "s", k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(docs, bits=bits).collect()
    want = {r[1]: r for r in plain_manifest([r.asDict() for r in docs.collect()])}
    assert {r["leaf"]: (r["subroot"], r["root"]) for r in out} == {k: v[2:4] for k, v in want.items()}
    for r in out:
        x = r["leaf"]
        for step in r["path"]:
            x = H(step["sib"], x) if step["before"] else H(x, step["sib"] or "")
        assert x == r["root"]


def test_manifest_of_nothing_and_of_string_ids(nothing, edges):
    assert merkle.verify(nothing, merkle.tampered()).count() == 0
    text = edges.withColumn("doc_id", merkle.F.concat(merkle.F.lit("id"), "doc_id"))
    assert {r["verified"] for r in merkle.verify(text, merkle.tampered()).collect()} == {True, False}


def plain_search(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, length = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        if item is not None:
            asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for (doc, c), n in zip(counted, lengths):
            m = 25 + 75 * n * n_docs // length if length else 0
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "w1 w2 w3 W4, w5"), (2, "w1 w2 w3 w9 w9 w9"), (3, None), (4, "..."), (5, "é 漢字 one TWO"), (5, "é 漢字 one TWO"), (6, "nowhere"), (7, "w1 w2"), (7, "w2 w3"), (None, "w1"), (8, " ".join(f"w{k % 390}" for k in range(1500))), (9, "line\nother a")]


@pytest.mark.parametrize("table", ["edges", "repeated"])
@pytest.mark.parametrize("block", [search.BLOCK, 40])
def test_search_is_the_plain_ranking(spark, table, block, request):
    docs = request.getfixturevalue(table)
    docs = docs.withColumn("doc_id", search.F.when(search.F.col("doc_id") % 9 != 8, search.F.col("doc_id")))
    got = Counter(map(tuple, search.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block=block).collect()))
    assert got == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)


def test_search_of_nothing_and_with_string_ids(spark, nothing, edges):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(nothing, items).count() == search.search(edges, none).count() == search.search(nothing, none).count() == 0
    named = edges.withColumn("doc_id", search.F.concat(search.F.lit("d"), "doc_id"))
    got = search.search(named, items.withColumn("item_id", search.F.col("item_id").cast("string"))).collect()
    assert {r["item_id"] for r in got} >= {"1", "2", "7", "8"}


def test_search_keeps_ties_by_id_in_parts(spark):
    docs = spark.createDataFrame([(k, "alpha beta" if k % 3 else "gamma") for k in range(3000, 0, -1)], "doc_id long, text string").repartition(7)
    got = search.search(docs, spark.createDataFrame([(1, "alpha"), (2, "gamma delta")], "item_id int, text string")).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == 1] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == 2] == [3 * k for k in range(1, 11)]


def test_shared_sums_give_each_piece_its_operands_once():
    rng = np.random.default_rng(3)
    holds = rng.random((60, 25)) < 0.3
    holds[:8] = rng.random(25) < 0.7  # a set that many pieces share
    sums, left = search.share(holds)
    inside = [{k} for k in range(60)]
    for a, b in sums:
        assert not inside[a] & inside[b]
        inside.append(inside[a] | inside[b])
    for p in range(25):
        parts = [inside[k] for k in np.flatnonzero(left[:, p])]
        assert sum(map(len, parts)) == len(set().union(*parts)) == holds[:, p].sum()
        assert set().union(*parts) == set(np.flatnonzero(holds[:, p]))
    additions = len(sums) + int(np.maximum(left.sum(0) - 1, 0).sum())
    assert additions < np.maximum(holds.sum(0) - 1, 0).sum() * 0.7
    pairs = left.astype(int) @ left.astype(int).T
    assert len(sums) == 60 or np.triu(pairs, 1).max() < 2  # nothing shared is left, unless the table is full


def plain_dedup(texts, window):
    """(n_words, kept words) by comparing all windows as tuples."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def passages_corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    common = [[word() for _ in range(rng.randrange(10, 90))] for _ in range(6)]
    texts = [None, "", " \n ", "x " * 200, "x " * 34, "x " * 35, "a b " * 60]
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(common)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 60))]
            cut = rng.randrange(len(part))
            part = part[cut:] if rng.random() < 0.3 else part[:cut] if rng.random() < 0.3 else part
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edited"
            parts += part
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize("window", [9, 12, 35])
@pytest.mark.parametrize("blocks", [1, 7, None])
def test_dedup_is_the_plain_one(spark, window, blocks):
    for seed in (1, 2):
        texts = passages_corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r for r in passages.dedup(docs, window, blocks).collect()}
        assert len(got) == len(texts)
        for k, (n, kept) in enumerate(plain_dedup(texts, window)):
            assert (got[k]["n_words"], got[k]["kept"]) == (n, " ".join(kept)), (seed, k)
            assert n - sum(s["end"] - s["start"] for s in got[k]["removed"]) == len(kept)


@pytest.mark.parametrize("table", ["edges", "repeated"])
def test_dedup_of_awkward_tables(table, request):
    docs = request.getfixturevalue(table).withColumn("doc_id", passages.F.when(passages.F.col("doc_id") != 3, passages.F.concat(passages.F.lit("d"), "doc_id")))
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (n, kept) in zip(rows, plain_dedup([r["text"] for r in rows], 35)))
    assert Counter(map(tuple, passages.digest(passages.dedup(docs)).collect())) == want


def test_dedup_of_nothing(nothing):
    assert passages.dedup(nothing).count() == 0


def test_dedup_when_the_maps_pass_everything(spark, monkeypatch):
    """The maps only thin out: with all bits set the rows are the same."""
    docs = spark.createDataFrame(list(enumerate(passages_corpus(5))), "doc_id long, text string")
    want = sorted(passages.digest(passages.dedup(docs)).collect(), key=lambda r: r["doc_id"])
    full = np.full(1 << (passages.BITS - 6), ~np.uint64(0))
    monkeypatch.setattr(passages, "maps", lambda found: (full, full))
    assert sorted(passages.digest(passages.dedup(docs)).collect(), key=lambda r: r["doc_id"]) == want


@pytest.mark.parametrize("name", ["op12_shared_search", "op13_merkle_manifest"])
def test_sql_gives_the_same_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    assert Counter(map(tuple, got.collect())) == Counter(db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_whole_table_of_passages(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (n, kept) in zip(rows, plain_dedup([r["text"] for r in rows], 35))}
    assert set(map(tuple, queries.QUERIES["op11_phrase_automata"](spark, sf).collect())) == want
