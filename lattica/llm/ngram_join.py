"""N-gram Jaccard join by prefix trees: links of at least `percent` percent, without emitting the pairs of a group.

Sets of five-word shingles get one global order (frequent shingles last). Two sets that link share a shingle in their prefixes, so
prefixes are dealt out by shingle. Equal sets are one set from the start. Of the sets under a shingle, each is first verified against
one pivot; sets that are connected by then need no further comparison. Of what is left across components, a shingle with many sets is
descended like the tree: sets that link share a next shingle too, so they are dealt by two, three and four shingles, and only small groups
(and, at the end, blocks of bounded size) are paired. A verifying task stores the sets beside one pivot in their global order, as a trie:
neighbours share their common beginning and its overlap, and a branch is left as soon as the remaining lengths can't reach the overlap wanted.

Words and shingles are compared by 64-bit hashes, and documents count as equal sets by 64 bits over their sorted shingle hashes: two of n
different sets meet by chance with a probability of about n * n / 2 ** 65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import marked, passes
from .common import FOLDED, PRIME, field, in_python, mix64, release, stash, text_portions

SHINGLE = 5
PERCENT = 80


def text_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each text: ascending distinct 64-bit shingle hashes of the whole text, five words each; fewer words are one shingle.
    Null and empty texts have the empty set."""
    for at, words, bounds in text_portions(column, FOLDED):
        keys = np.full(max(0, len(words) - SHINGLE + 1), SHINGLE, np.uint64)
        for j in range(SHINGLE):
            keys *= PRIME
            keys += words[j : j + len(keys)]
        bounds = bounds.tolist()
        for k, (low, high) in enumerate(zip(bounds, bounds[1:]), at):
            n = high - low
            if n >= SHINGLE:
                own = np.sort(keys[low : high - SHINGLE + 1])
                yield k, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                one = np.array([n], np.uint64)
                for h in words[low:high]:
                    one = one * PRIME + h
                yield k, mix64(one)
            else:
                yield k, np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return next(text_sets(pa.array([text], pa.string())))[1]


def set_hash(keys: np.ndarray) -> int:
    """64 bits for a whole set of ascending keys; 0 only for the empty set."""
    if not len(keys):
        return 0
    return int.from_bytes(blake2b(keys.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of which one is shared with every set that links: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def wanted(n: int, m: int, percent: int = PERCENT) -> int:
    """Least overlap of linking sets of n and m: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def ordered(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    level = cell_of(keys, levels)
    return keys[np.argsort(level, kind="stable")] if level.any() else keys


def parity(keys: np.ndarray) -> bytes:
    """One bit for each of at least len(keys) cells (a power of two), whether an odd number of keys fall in it."""
    m = 1 << max(6, (len(keys) - 1).bit_length())
    odd = np.bincount((keys & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int = PERCENT) -> bool:
    """Whether the parities allow a link: sets that differ in d keys differ in at most d cells, and linking sets differ in no more than
    n + m - 2 * wanted keys. The longer parity is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * wanted(n, m, percent)


def _sets(column, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(hash, keys) of the sets that this task meets for the first time: copies cost a task one set."""
    for _, keys in text_sets(column):
        if (sig := set_hash(keys)) and sig not in seen:
            seen.add(sig)
            yield sig, keys


def sized(docs: DataFrame, bits: int) -> DataFrame:
    """One pass for (id, n_shingles, sig, odd, key) of every row, odd the parity of its set, and for counts of shingle hashes in 2 ** bits cells: rows of the latter have a
    chunk number and compressed counts instead. A set is counted once a task."""
    chunks = 1 << max(0, bits - 14)
    names = ["id", "n_shingles", "sig", "odd", "key", "chunk", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cells, held, n = set(), np.zeros(1 << bits, np.uint32), [], 0
        id_type = None

        def add() -> None:
            nonlocal held, n
            if held:
                np.add.at(cells, np.concatenate(held), np.uint32(1))
            held, n = [], 0

        for batch in batches:
            id_type = batch.column(0).type
            sizes, sigs, odds = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for k, keys in text_sets(batch.column(1)):
                sizes[k], sigs[k] = len(keys), set_hash(keys)
                odds.append(parity(keys))
                if sigs[k] and int(sigs[k]) not in seen:
                    seen.add(int(sigs[k]))
                    held.append((keys >> np.uint64(64 - bits)).astype(np.int64))
                    n += len(keys)
                    if n > 1 << 18:
                        add()
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sigs), pa.array(odds, pa.binary()), batch.column(2), *none], names)
        add()
        if seen:
            parts = cells.reshape(chunks, -1)
            for k in range(0, chunks, 64):
                some = [(c, p) for c, p in enumerate(parts[k : k + 64], k) if p.any()]
                none = pa.nulls(len(some), id_type), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([*none, pa.array([c for c, _ in some], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in some], pa.binary())], names)

    return in_python(docs.select("id", "text", "key"), run, f"{field(docs, 'id')}, n_shingles long, sig long, odd binary, key long, chunk int, cells binary")


def frequency_levels(counted: DataFrame, bits: int, mean: float) -> np.ndarray:
    """One byte for each cell of shingle hashes: 0 up to five deviations (of a chance count) above the mean, then one more per doubling
    of the excess. Chunks of cells are summed apart from each other; 2 ** bits bytes reach the driver."""
    chunks = 1 << max(0, bits - 14)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(cells.as_py()), np.uint32)
                sums[chunk] = sums[chunk] + part if chunk in sums else part.astype(np.int64)
        if sums:
            beyond = [np.maximum(s - mean, 0) / (5 * np.sqrt(mean)) for s in sums.values()]
            level = [np.where(b > 1, 1 + np.floor(np.log2(np.maximum(b, 1))), 0).astype(np.uint8).tobytes() for b in beyond]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(level, pa.binary())], ["chunk", "levels"])

    rows = counted.filter("chunk is not null").select("chunk", "cells").repartition("chunk")
    rows = in_python(rows, add, "chunk int, levels binary")
    out = np.zeros((chunks, (1 << bits) // chunks), np.uint8)
    for r in rows.collect():
        out[r["chunk"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def cell_of(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The frequency level of each key."""
    return levels[(keys >> np.uint64(64 - int(len(levels)).bit_length() + 1)).astype(np.int64)]


def shared_tokens(docs: DataFrame, levels) -> DataFrame:
    """(token, sig, n, pos) of each prefix shingle that at least two different sets have in their prefixes; pos is its place in the set.

    Rare shingles are dealt by shingle; rows come sorted and are passed on as they stream by: a set waits only until a second one follows.
    Shingles in frequent cells (one of them may be in any share of the sets) are taken as shared and dealt by shingle and set, to drop copies.
    A row travels as three numbers: place holds n, pos and whether the shingle is frequent."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sigs, places = [], [], []
            for sig, keys in _sets(batch.column(0), seen):
                prefix = ordered(keys, levels.value)[: prefix_length(len(keys))]
                tokens.append(prefix.view(np.int64))
                sigs.append(np.full(len(prefix), sig, np.int64))
                places.append((len(keys) << 32) + 2 * np.arange(len(prefix), dtype=np.int64) + (cell_of(prefix, levels.value) > 0))
            if tokens:
                columns = np.concatenate(tokens), np.concatenate(sigs), np.concatenate(places)
                for at in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], ["token", "sig", "place"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 3
        passed = False  # whether the row in tail went out already
        for batch in batches:
            token, sig, place = (np.concatenate([t, c.to_numpy(zero_copy_only=False)]) for t, c in zip(tail, batch.columns))
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            copy = same & (sig[1:] == sig[:-1])
            fresh = np.concatenate([[True], ~copy])
            if len(tail[0]):
                fresh[0] = not passed
            # with another set on either side under the same token, or frequent anyway
            other = same & ~copy
            left, right = np.concatenate([[False], other]), np.concatenate([other, [False]])
            if passed and len(tail[0]):
                left[0] = True
            # a repeated row has its neighbours beyond its copies: carry both ways over runs
            run = np.cumsum(np.concatenate([[True], ~copy])) - 1
            linked = np.bincount(run, left | right | (place % 2 == 1), run[-1] + 1) > 0
            out = fresh & linked[run]
            passed = bool(linked[run[-1]])
            if out.any():
                n, pos = (place[out] >> 32).astype(np.int32), ((place[out] & 0xFFFFFFFF) >> 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(sig[out]), pa.array(n), pa.array(pos)], ["token", "sig", "n", "pos"])
            tail = [token[-1:], sig[-1:], place[-1:]]

    rows = in_python(docs.select("text"), emit, "token long, sig long, place long")
    deal = F.when(F.col("place") % 2 == 1, F.xxhash64("token", "sig")).otherwise(F.col("token"))
    return in_python(rows.repartition(deal).sortWithinPartitions("token", "sig"), shared, "token long, sig long, n int, pos int")


def stored_sets(docs: DataFrame, slim: DataFrame, sigs: DataFrame, levels) -> DataFrame:
    """(sig, keys) of the distinct sets in sigs(sig), in the global order, eight bytes a key. One document of each set is read again, by its id, or by
    its key where all rows of the set lack an id. Bit maps of a fixed size, of these documents and of the sets, drop the other rows in the
    scan, so that no text is dealt out at any size; what they pass in excess goes when sets meet sigs."""
    least = slim.filter("sig != 0").groupBy("sig").agg(F.min("id").alias("id"), F.min("key").alias("key")).join(sigs, "sig", "left_semi")
    place = F.when(F.col("id").isNull(), F.col("key")).otherwise(F.xxhash64("id"))
    wanted_rows = stash(least.select(place.alias("place"), "sig"))
    shared = docs.sparkSession.sparkContext.broadcast((marked(wanted_rows, F.col("place")), marked(wanted_rows, F.col("sig"))))
    release(wanted_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows, sets = shared.value
        for batch in batches:
            texts = batch.column(1).filter(pa.array(passes(rows, batch.column(0).to_numpy())))
            found = [(sig, keys) for sig, keys in _sets(texts, seen)]
            kept = passes(sets, np.array([sig for sig, _ in found], np.int64)) if found else []
            out = [(sig, ordered(keys, levels.value).astype("<u8").tobytes()) for (sig, keys), keep in zip(found, kept) if keep]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary()))], ["sig", "keys"])

    made = in_python(docs.select(place.alias("place"), "text"), run, "sig long, keys binary").dropDuplicates(["sig"])
    return stash(made.join(sigs, "sig", "left_semi"))


def plausible(edges: DataFrame, odds: DataFrame) -> DataFrame:
    """edges(a, b) without those that the parities rule out, with the size m of b: what remains is nearly all links."""
    left = odds.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = odds.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns[2:]]
            keep = np.array([may_link(n, x, m, y) for n, x, m, y in zip(*c)], bool)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4)], ["a", "b", "m"])

    rows = edges.join(left, "a").join(right, "b").select("a", "b", "na", "oa", "nb", "ob")
    return in_python(rows, run, "a long, b long, m long")


def walk(pivot: np.ndarray, members: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> list[int]:
    """Sigs of the members that link with the pivot. members: (sig, keys in global order), sorted by keys: a trie in depth-first order.

    upto[d] is the overlap of the current path's first d shingles with the pivot; a member takes over the part of the path it
    shares with the one before it. A branch is left where even all remaining shingles would not reach the overlap wanted."""
    inside, size = np.sort(pivot), len(pivot)
    path, upto, known, found = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0, []
    for sig, keys in members:
        n = len(keys)
        need = wanted(size, n, percent)
        if need > min(size, n):
            continue
        common = min(len(path), n)
        differ = np.flatnonzero(path[:common] != keys[:common])
        at = min(known, int(differ[0]) if len(differ) else common)
        overlap = np.empty(n + 1, np.int64)
        overlap[: at + 1] = upto[: at + 1]
        while at < n and overlap[at] + min(n - at, size - overlap[at]) >= need:
            step = keys[at : at + 128]
            place = np.minimum(np.searchsorted(inside, step), size - 1)
            overlap[at + 1 : at + 1 + len(step)] = overlap[at] + np.cumsum(inside[place] == step)
            at += len(step)
        if at == n and overlap[n] >= need:
            found.append(sig)
        path, upto, known = keys, overlap, at
    return found


#: Members, and shingles of them, that are verified against one pivot in one trie; more are dealt to several.
TRIE, TRIE_KEYS = 512, 1 << 18


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges(a, b, m), distinct, m the size of b -> those that link. Each trie holds about TRIE members or TRIE_KEYS shingles of a pivot a."""
    need = F.greatest(F.count("*") / TRIE, F.sum("m") / TRIE_KEYS)
    shares = stash(edges.groupBy("a").agg(F.ceil(need).cast("int").alias("parts")))
    dealt = edges.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    members = dealt.join(sets, dealt["b"] == sets["sig"]).select("a", "part", F.lit(1).alias("role"), "sig", "keys")
    heads = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = heads.join(sets, heads["a"] == sets["sig"]).select("a", "part", F.lit(0).alias("role"), "sig", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, members = None, None, []

        def finish() -> list[int]:
            members.sort(key=lambda x: x[1].astype(">u8").tobytes())
            return walk(pivot, members) if pivot is not None else []

        for batch in batches:
            out = []
            for a, part, role, sig, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, part) != now:
                    out += [(now[0], b) for b in finish()] if now else []
                    now, pivot, members = (a, part), None, []
                keys = np.frombuffer(keys, "<u8")
                if role:
                    members.append((sig, keys))
                else:
                    pivot = keys
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if now:
            last = finish()
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(last), pa.int64()), pa.array(last, pa.int64())], ["a", "b"])

    rows = pivots.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    out = stash(in_python(rows, run, "a long, b long"))
    release(shares)
    return out


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label), label the least node that links reach. Labels spread to neighbours, then jump to
    their label's label, so that rounds grow with the logarithm of a chain; each round is written out. Both sides of each join are
    plain exchanges, which Spark splits where one node has many links."""
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.lit(-1).cast("long").alias("old"), F.least("node", "label").alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = now.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stash(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        release(now)
        if not new.filter("label != old").limit(1).count():
            release(both)
            return new.select("node", "label")
        now = new


#: Shingles with more sets than this get further rounds of pivots, then the descent.
CROWD = 32
#: A row of the descent (made in Python, dealt out and counted) costs about as much as so many pairs that a join makes and drops.
STEP_COST = 256
#: Shingles by which a crowded group is dealt at most. Up to four are safe: sets that link with fewer common shingles are equal.
DEEPEST = 4


def may_reach(n: str, i: str, m: str, j: str, before: int = 0, percent: int = PERCENT):
    """Sets of n and m that share `before` shingles, and then the one at places i and j, can share n - i and m - j more at most; whether the
    overlap wanted is within that. A pair that links passes under its first common shingles."""
    need = F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent} - {before}")
    return (F.col(n) - F.col(i) >= need) & (F.col(m) - F.col(j) >= need)


def _several(rows: DataFrame) -> DataFrame:
    """rows(token, .., comp) of the tokens that several components share. One key may hold any share of the rows: the counts are written first,
    so that the join has plain exchanges on both sides, which Spark splits."""
    open_ = stash(rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token"))
    out = stash(rows.join(open_, "token", "left_semi"))
    release(open_)
    return out


def _labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """groups with comp: the component so far, at first the set itself; then only shingles that several components share."""
    if labels is None:
        return groups.withColumn("comp", F.col("sig"))
    rows = stash(groups.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("token", "sig", "n", "pos", "rank", F.coalesce("label", "sig").alias("comp")))
    out = _several(rows)
    release(rows)
    return out


def pivot_edges(rows: DataFrame, seed: int) -> DataFrame:
    """Each set against the pivot it shares most shingles with. Pivots: first the sets most of whose prefix is shared (others are edits of such), in later rounds by a seeded hash."""
    first = -F.col("rank") if seed == 0 else F.xxhash64("sig", F.lit(seed))
    best = F.min(F.struct(first.alias("first"), F.col("sig").alias("pivot"), F.col("n").alias("m"), F.col("pos").alias("mpos"), F.col("comp").alias("pcomp")))
    pivots = stash(rows.groupBy("token").agg(best.alias("p")).select("token", "p.pivot", "p.m", "p.mpos", "p.pcomp"))
    edges = rows.join(pivots, "token").filter((F.col("comp") != F.col("pcomp")) & may_reach("n", "pos", "m", "mpos"))
    votes = edges.groupBy("sig", "pivot").agg(F.count("*").alias("votes"))
    out = stash(votes.groupBy("sig").agg(F.max(F.struct("votes", "pivot")).alias("v")).select(F.col("v.pivot").alias("a"), F.col("sig").alias("b")))
    release(pivots)
    return out


def deeper(rows: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """Rows of sets that have `depth` shingles in common, the last at pos -> rows by one shingle more.

    Two sets that link share wanted(n, m) shingles, so the next common one lies within the first prefix_length(n) + depth places of
    each. The new token is a hash of the old one and that shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sigs, sizes, places, comps = [], [], [], [], []
            for token, sig, n, pos, comp, keys in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(keys, "<u8")[pos + 1 : prefix_length(n) + depth]
                with np.errstate(over="ignore"):
                    tokens.append(mix64(part ^ mix64(np.array([token], np.int64).view(np.uint64) + np.uint64(depth))).view(np.int64))
                sigs.append(np.full(len(part), sig, np.int64))
                sizes.append(np.full(len(part), n, np.int32))
                places.append(np.arange(pos + 1, pos + 1 + len(part), dtype=np.int32))
                comps.append(np.full(len(part), comp, np.int64))
            if tokens:
                columns = [np.concatenate(c) for c in (tokens, sigs, sizes, places, comps)]
                for at in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], ["token", "sig", "n", "pos", "comp"])

    return in_python(rows.join(sets, "sig").select("token", "sig", "n", "pos", "comp", "keys"), run, "token long, sig long, n int, pos int, comp long")


def paired(rows: DataFrame, sizes: DataFrame, crowd: int, depth: int) -> DataFrame:
    """All pairs (a, b) of rows under one token and in different components under which they can still link. Groups of more than crowd
    rows are dealt to blocks: a row meets one block of at most about crowd others a task."""
    blocks = rows.join(sizes, "token").withColumn("blocks", F.ceil(F.col("sets") / crowd).cast("int"))
    left = blocks.select("token", F.col("sig").alias("a"), "n", F.col("pos").alias("i"), F.col("comp").alias("ca"), F.pmod(F.xxhash64("sig"), "blocks").cast("int").alias("block"))
    right = blocks.select("token", F.col("sig").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("comp").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, ["token", "block"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_reach("n", "i", "m", "j", depth - 1))
    return pairs.select("a", "b")


def cross_edges(rows: DataFrame, sets_of, crowd: int) -> DataFrame:
    """Pairs of sets in different components that share a prefix shingle under which they can still link, once each; sets_of(sigs): their
    stored sets. Shingles with more than crowd sets are descended before their sets are paired, where that makes fewer rows than pairs."""
    rows = rows.select("token", "sig", "n", "pos", "comp")
    edges, sets = None, None
    for depth in range(1, DEEPEST + 1):
        steps = F.sum(F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + depth - F.col("pos"))
        deep = (F.count("*") > crowd) & (F.count("*") * (F.count("*") - 1) > 2 * STEP_COST * steps) & F.lit(depth < DEEPEST)
        sizes = stash(rows.groupBy("token").agg(F.count("*").alias("sets"), deep.alias("deep")))
        new = stash(paired(rows, sizes.filter(~F.col("deep")).select("token", "sets"), crowd, depth))
        edges = new if edges is None else edges.unionByName(new)
        crowded = sizes.filter("deep").select("token")
        if not crowded.limit(1).count():
            release(sizes)
            break
        full = rows.join(crowded, "token", "left_semi")
        sets = sets or sets_of(full.select("sig").distinct())
        made = stash(deeper(full, sets, depth))
        rows = _several(made)
        release(made, sizes)
    release(sets)
    return edges.distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, max_bits: int = 22, crowd: int = CROWD) -> DataFrame:
    """id, n_shingles, component_id: the least id that links reach, of every row.

    Documents link from a Jaccard similarity of 0.8 on. Null and empty texts have no shingles and are their own component; texts of
    under five words link with equal ones only. Repeated rows, and rows with one id, are kept each. Rows without an id link like
    others; component_id is null where no row of a component has an id. Ids may be of any type that has an order. Empty table: no rows.
    Columns of docs other than the two are not read. rounds, max_bits and crowd change the work only.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("text")))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(length, 1) / 64)), 14, max_bits))
    counted = stash(sized(docs, bits))
    slim = stash(counted.filter("chunk is null").select("id", "n_shingles", "sig", "odd", "key"))
    alike = slim.filter("sig != 0").groupBy("sig").agg(F.min("id").alias("least"))
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(counted, bits, max((slim.agg(F.sum("n_shingles")).first()[0] or 0) / (1 << bits), 1.0)))
    release(counted)
    found = links(docs, slim, levels, rounds, crowd)
    if found is not None:
        labels = components(found).withColumnRenamed("node", "sig")
        named = stash(alike.join(labels, "sig", "left").select("sig", F.coalesce("label", "sig").alias("label"), "least"))
        least = stash(named.groupBy("label").agg(F.min("least").alias("component")))
        alike = named.join(least, "label").select("sig", F.col("component").alias("least"))
    alike = stash(alike)  # plain exchanges on both sides of the join back: Spark splits the rows of many copies
    out = slim.drop("odd", "key").join(alike, "sig", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"))


def links(docs: DataFrame, slim: DataFrame, levels, rounds: int, crowd: int) -> DataFrame | None:
    """Verified links (a, b) between set hashes that connect all that link; None if no sets share a prefix shingle."""
    raw = stash(shared_tokens(docs, levels))
    full = F.expr(f"max(n) - ceil(max(n) * {PERCENT} / 100) + 1")
    shared = stash(raw.groupBy("sig").agg((F.count("*") / full).alias("rank")))
    if not shared.limit(1).count():
        release(raw, shared)
        return None
    once = slim.filter("sig != 0").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("odd").alias("odd"))  # copies merge before they are dealt
    odds = stash(once.join(shared.select("sig"), "sig", "left_semi"))
    groups = stash(raw.join(shared, "sig"))
    crowded = stash(groups.groupBy("token").agg(F.count("*").alias("sets")).filter(F.col("sets") > crowd).select("token"))
    crowds = stash(groups.join(crowded, "token", "left_semi"))
    release(raw, shared, crowded)

    def sets_of(sigs: DataFrame) -> DataFrame:
        return stored_sets(docs, slim, sigs, levels)

    found, labels = None, None
    for k in range(rounds + 1):
        rows = _labelled(crowds if 0 < k < rounds else groups, labels)
        edges = cross_edges(rows, sets_of, crowd) if k == rounds else pivot_edges(rows, k)
        edges, made = stash(plausible(edges, odds)), edges
        release(rows, made)
        if not edges.limit(1).count():
            continue
        sets = sets_of(edges.select(F.col("a").alias("sig")).union(edges.select("b")).distinct())
        new = verified(edges, sets)
        release(edges, sets)
        found = new if found is None else found.unionByName(new)
        labels = components(found) if k < rounds else None
    release(groups, crowds, odds)
    return found


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON b.shingle = a.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
