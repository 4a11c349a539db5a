"""The pipeline stage by stage on awkward documents."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lattica.llm import ngram_join, packing, quality
from lattica.llm.common import words_of


@pytest.fixture(scope="module")
def folder(spark, edges, labels, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    edges.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scans", "source_mixing", "packing"]


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        before, after = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in out.collect())
        assert set(after) <= set(before)
        if name == "ngram_jaccard_join":
            groups = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
            assert set(after) == set(groups.values())
        if name == "secret_scans":
            assert after == before
            for r in out.collect():
                assert not re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", r["text"] or "")
                assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
                if r["text"] != texts[r["doc_id"]]:
                    assert "[SECRET]" in r["text"]
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = pipeline.pack_windows(spark, docs, folder).toPandas()
    words = packing.word_ids(packing.default_vocabulary())
    want = sum(len(words.of((r["text"] or "").replace("\n", " "))) // 4 + 1 for r in docs.collect())
    assert packed.length.sum() == want


def test_deduplicate_keeps_one_row_of_a_group(spark):
    """Near copies whose ids are null or shared are one group like others; the row with the least id stays."""
    def near(name):
        return [" ".join(f"{name}x{j}" if j == k else f"{name}{j}" for j in range(60)) for k in (0, 1)]

    a, b, c = near("a"), near("b"), near("c")
    rows = [(None, a[0]), (None, a[1]), (3, b[0]), (3, b[1]), (None, c[0]), (9, c[1]), (3, "alone"), (None, None), (4, "alone too"), (4, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.deduplicate(spark, docs, "").collect())
    assert set(got.values()) == {1} and len(got) == 6
    assert sum((None, x) in got for x in a) == 1 and sum((3, x) in got for x in b) == 1
    assert {(9, c[1]), (3, "alone"), (None, None), (4, "alone too")} <= set(got)


def test_empty_tables(spark, tmp_path, edges, labels):
    none = edges.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


SECRETS = [re.compile(x) for x in (r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})""", r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}")]


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}


def plain_pipeline(rows, model):
    """All five stages in plain Python, on rows (doc_id, text, source) with distinct ids -> Counter of (doc_id, tokens of a copy)."""
    kept = []
    for r in rows:
        x = quality.pool(words_of(r[1]), model.vectors)
        if round(float(model.network.probabilities(x[None].astype(float))[0]), 9) >= 0.7:
            kept.append(r)
    sets = [shingles_of(t) for _, t, _ in kept]
    group = list(range(len(kept)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    kept = [min(kept[k] for k in range(len(kept)) if group[k] == g) for g in sorted(set(group))]
    masked = []
    for doc, text, source in kept:
        spans = sorted(m.span() for rx in SECRETS for m in rx.finditer(text or ""))
        at, new = 0, ""
        for a, b in spans:
            new += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        masked.append((doc, new + text[at:] if spans else text, source))
    size = {doc: len((text or "").split()) for doc, text, _ in masked}
    sums = defaultdict(int)
    for doc, _, source in masked:
        sums[source] += size[doc]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target = sum(sums.values()), {}
    while True:  # clamp what passes its cap, share the rest anew
        rest = [s for s in order if s not in target]
        left = total - sum(target.values())
        shares = {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        over = [s for s in rest if shares[s] > 3 * sums[s]]
        if not over:
            target |= shares
            break
        target |= {s: 3 * sums[s] for s in over}
    copies = Counter()
    for s in order:
        budget = int(float(target[s]) + 0.5)
        whole = budget // sums[s] if sums[s] else 0
        left = budget - whole * sums[s]
        mine = sorted((hashlib.md5(f"mix-1:{doc}".encode()).hexdigest(), size[doc], doc) for doc, _, x in masked if x == s)
        for _, n, doc in mine:
            part = max(0, min(n, left))
            left -= part
            copies[doc] = whole + (part > 0 and 2 * part >= n)
    tokenizer = packing.WordIds(packing.default_vocabulary()).tokenizer
    tokens = {doc: len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1 for doc, text, _ in masked}
    return Counter({(doc, tokens[doc]): n for doc, n in copies.items() if n})


def test_run_equals_plain_python(spark, tmp_path):
    """run() on a small table with junk, exact and near copies, secrets and a hot source, against all five stages in plain Python."""
    rng, rows, marks = random.Random(5), [], []
    good, bad = [f"word{k}" for k in range(60)], [f"#{k}$$" for k in range(60)]
    for k in range(160):
        junk = k % 5 == 0
        text = " ".join(rng.choice(bad if junk else good) for _ in range(rng.randrange(30, 90)))
        if k % 4 == 1:
            text += f" token = abcdefgh{k} and AKIA{'Z' * 16}"
        rows.append((1000 - k, text, None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 4}"))
        marks.append((1000 - k, int(not junk)))
    near = [(k, " ".join(["edited", *t.split()[1:]]), "copies") for k, (_, t, _) in enumerate(rows[1:40:3])]
    rows += near + [(100 + k, t, "copies") for k, (_, t, _) in enumerate(rows[1:60:7])]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit_on(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(rows, model)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    kept = {r["doc_id"] for r in pipeline.classify(spark, docs, str(tmp_path)).collect()}
    assert {d for d, good in marks if good} <= kept and not {d for d, good in marks if not good} & kept
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in want.items())
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_stages_carry_other_columns(spark, folder):
    """Columns with the names and other types of a stage's own come back as they were, on the rows that stay; null and shared ids too."""
    kinds = {"score": "string", "predicted": "string", "blob": "int", "spans": "string", "size": "int", "source_size": "string", "target": "string", "taken": "int", "repeats": "string", "_key": "int", "_id": "string", "_rest": "string", "_salt": "int", "_bucket": "int", "_copy": "string", "a.b": "int"}
    F = pipeline.F
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id > 20").withColumn("doc_id", F.lit(21).cast("long")))
    extra = {c: F.concat(F.lit("9"), F.coalesce("doc_id", F.lit(7)).cast("string")).cast(t).alias(c) for c, t in kinds.items()}
    docs = docs.select("*", *extra.values())
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        for r in out.collect():
            value = f"9{7 if r['doc_id'] is None else r['doc_id']}"
            assert all(str(r[c]) == value for c in kinds)
