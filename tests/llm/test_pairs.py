"""Near-duplicates, suffix-array dedup and nearest neighbours against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from twinlens.llm import ann, induced_sort, near_dup, suffix_dedup
from twinlens.llm.common import utf8

SCHEMA = "doc_id long, text string, anchor string, text_key string, root string"
ODD = [None, "", " \t\n", "one", "ONE", "two words", "é é é"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "a", "k", "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingle_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def components(texts, words, percent):
    sets, up = [shingle_set(t, words) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sets


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80)])
def test_groups_are_the_components_of_all_links(spark, words, percent):
    rng = random.Random(words)
    texts = list(ODD)
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 9)):
            # chains: each copy changes the one before, so that ends of a group are no longer alike
            texts.append(" ".join(base))
            if rng.random() < 0.6:
                base[rng.randrange(len(base))] = "new" + str(rng.random())
    want, sets = components(texts, words, percent)
    rows = near_dup.near_duplicates(frame(spark, texts), words, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]])


@pytest.mark.parametrize("block", [1, 6_000, 1_000_000])
def test_large_groups_are_compared_in_blocks(spark, monkeypatch, block):
    """Near copies of one text, of which many are no links: with blocks of one member, of a few, and of all."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        own = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 2, 4, 6])):
            own[k] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    want, _ = components(texts, 2, 80)
    assert 3 < len(set(want)) < 60
    rows = near_dup.near_duplicates(frame(spark, texts), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))


def test_texts_without_a_common_word_are_never_linked(spark):
    """Words that polynomial hashes take for equal: a sequence of Thue and Morse, and its complement."""
    word = "A"
    while len(word) < 2048:
        word += word.translate(str.maketrans("AB", "BA"))
    other = word.translate(str.maketrans("AB", "BA"))
    rows = near_dup.near_duplicates(frame(spark, [word, other, f"{word} x y", f"{other} x y"]), 2, 80).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows)


def test_near_duplicates_of_repeated_rows_null_ids_and_nothing(spark):
    rows = near_dup.near_duplicates(frame(spark, ["a b c", "a b c", "a b c", "a b c"], [3, 3, None, 1])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for n, shift in ((100, 10), (1000, 200), (6, 1)):
        a, b = np.sort(pool[:n]), np.sort(pool[shift : n + shift])
        s = near_dup.super_min_hash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 512)
        assert (s[0] == s[1]).mean() == pytest.approx((n - shift) / (n + shift), abs=0.08)
    # texts that are cut into parts have the same signature as alone
    whole = near_dup.super_min_hash(np.arange(9000, dtype=np.uint64), np.array([0, 9000]), 64)
    both = near_dup.super_min_hash(np.concatenate([np.arange(9000, dtype=np.uint64), np.arange(5, dtype=np.uint64)]), np.array([0, 9000, 9005]), 64)
    assert (whole[0] == both[0]).all()


def test_union_find_joins_a_long_chain(spark):
    edges = [((i, 0), (i + 1, 0)) for i in range(60)] + [((100, 0), (101, 0))]
    kind = "struct<doc_id:long,text_key:long>"
    links = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(7)
    roots = {r["member"]["doc_id"]: r["root"]["doc_id"] for r in near_dup.union_find(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}


def sorted_suffixes(symbols, cap):
    ends = [i for i, s in enumerate(symbols) if s == 0]

    def key(i):
        j = next(e for e in ends if e >= i)
        return (*((x, 0) for x in symbols[i:j]), (0, j))

    order = sorted(range(len(symbols)), key=key)
    lcp = [0]
    for a, b in zip(map(key, order), map(key, order[1:])):
        lcp.append(min(cap, next(k for k in range(len(a) + 1) if k >= min(len(a), len(b)) or a[k] != b[k])))
    return order, lcp


@pytest.mark.parametrize(("waiting", "chunk", "alphabet"), [(1 << 22, 1 << 16, 2048), (7, 3, 2048), (1 << 22, 5, 1)])
def test_induced_order_and_common_prefixes(monkeypatch, waiting, chunk, alphabet):
    """Also with queues that spill at once and chunks of a few entries, and with ranks doubled in place of recursion."""
    for name, value in (("WAITING", waiting), ("CHUNK", chunk), ("ALPHABET", alphabet)):
        monkeypatch.setattr(induced_sort, name, value)
    rng = random.Random(0)
    for _ in range(150):
        symbols = [s for _ in range(rng.randint(1, 5)) for s in [*(rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 14))), 0]]
        for cap in (3, 100):
            got = np.concatenate(list(induced_sort.suffixes(np.array(symbols, np.uint16), 8, cap)))
            order, lcp = sorted_suffixes(symbols, cap)
            if cap == 100:
                assert got["at"].tolist() == order
            assert got["lcp"].tolist() == lcp or cap == 3


def removed(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        m = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                m[s : s + length] = b"\1" * length
            seen.add(w)
        out.append((b, m))
    return out


@pytest.mark.parametrize("length", [10, 100])
def test_suffix_dedup_against_all_windows(spark, length):
    rng = random.Random(length)
    bits = ["".join(rng.choice("ab é日 ") for _ in range(rng.randint(1, 2 * length))) for _ in range(12)]
    texts = [*ODD, "x" * 5 * length, "y" * 3 * length, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(60)], "ab" * 3 * length]
    want = removed(texts, length)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # groups then go across batches
    try:
        rows = suffix_dedup.dedup(frame(spark, texts).repartition(3), length).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == len(texts)
    for r in rows:
        body, mask = want[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == hashlib.sha256(bytes(c for c, m in zip(body, mask, strict=True) if not m)).hexdigest()
        starts = [k for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1])]
        assert (r["n_bytes"], r["n_removed"], [s["start"] for s in r["spans"]]) == (len(body), sum(mask), starts)


def test_anchors_do_not_meet_by_chance():
    """Of 300,000 anchors, half a hash would have some 10 in common."""
    data = np.random.default_rng(0).integers(0, 256, 12_000_000, dtype=np.uint8)
    _, _, _, anchor, _ = suffix_dedup.window_runs(data, np.array([0, len(data)]), 100)
    anchors = np.unique(anchor)
    assert len(anchors) == len(anchor) > 250_000 and len(np.unique(anchors & 0xFFFFFFFF)) < len(anchors)


def test_hot_anchors_are_split(spark, monkeypatch):
    """A sentence with other text around it in each document: every run under its anchor is of its own kind."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, passage = some(70), some(130)
    texts = [some(90) + shared + some(90) for _ in range(300)] + [some(50) + passage + some(60) for _ in range(60)]
    texts += [t[20:200] + some(40) for t in texts[:80]] + texts[5:9] + ["z" * 400]
    want, limit = removed(texts, 100), 8 << 10
    sizes, shards = [], suffix_dedup.shard_suffixes

    def measured(reps, *rest):
        sizes.extend(r[1] for r in reps.selectExpr("anchor", "n + 100 as size").groupBy("anchor").sum("size").collect())
        return shards(reps, *rest)

    monkeypatch.setattr(suffix_dedup, "shard_suffixes", measured)
    rows = suffix_dedup.dedup(frame(spark, texts).repartition(5), 100, limit).collect()
    assert sizes and max(sizes) <= limit
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in rows} == {k: (sum(m), bytes(c for c, x in zip(b, m, strict=True) if not x)) for k, (b, m) in enumerate(want)}


@pytest.mark.parametrize("hot", [1, 300])
def test_windows_by_hash_against_all_windows(spark, hot):
    rng = random.Random(hot)
    bits = ["".join(rng.choice("ab é日 ") for _ in range(rng.randint(1, 20))) for _ in range(12)]
    texts = [*ODD, "x" * 50, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(60)], "ab" * 30]
    rows = suffix_dedup.dedup(frame(spark, texts + texts[9:12], [*range(len(texts)), 9, 10, 11]).repartition(3), 10, hot).collect()
    want = removed(texts, 10)
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert (r["n_removed"], r["kept"]) == (sum(want[r["doc_id"]][1]), bytes(c for c, m in zip(*want[r["doc_id"]], strict=True) if not m))


def test_suffix_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    text = "a sentence that is long enough"
    rows = suffix_dedup.dedup(frame(spark, [text, text, text, text], [3, 3, None, 1]), 10).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (1, 30), (3, 30), (3, 30)]
    assert suffix_dedup.dedup(frame(spark, [text, text], [2, 2]), 10).agg({"n_removed": "sum"}).first()[0] == 0
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def exact(x, ids, asked, k):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in asked:
        i = list(ids).index(q)
        score = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
        keep = ids != q
        top = np.lexsort((ids[keep], -score[keep]))[:k]
        out[q] = list(zip(ids[keep][top].tolist(), score[keep][top].tolist()))
    assert len(u) == len(x)
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_neighbours_and_recall(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) + (rng.integers(0, 12, (1500, 1)) * 7 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] if kind == "clusters" else 0)
    if kind == "copies":
        x[200:900] = x[7]
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")
    rows = ann.neighbours(df, every=50, k=5, list_rows=64).collect()
    want = exact(x, ids, [i for i in range(1500) if i % 50 == 0], 5)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    scores = {q: dict(v) for q, v in want.items()}
    assert all(s == pytest.approx(scores[q][i], abs=1e-12) for q, v in got.items() for i, s in v if i in scores[q])
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    if kind == "copies":
        assert sum(got[q] == want[q] or [i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want) >= 0.8 * len(want)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.5]), (7, [1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.neighbours(df.where("vec_id is null")).count() == 0 and ann.neighbours(df.limit(0)).count() == 0


def test_a_query_is_not_repeated_for_each_of_its_lists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 6)).astype(np.float32).astype(float)
    x[700:] = x[0]  # a hot list, cut into blocks
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    vectors = ann.usable(df)
    index = ann.fit(vectors, list_rows=20)
    index.ratio, index.width = 1e9, len(index.centroids)  # every list is searched
    assert index.width > 50
    lists, kept = ann.postings(vectors, index), []

    def counted(df, name="table"):
        kept.append(df.count())
        return df

    monkeypatch.setattr(ann, "stored", counted)
    asked = vectors.where("vec_id % 3 = 0")
    got = ann.search(index, lists, asked, 5, block_rows=100, block_queries=150)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: [i for i, _ in v] for q, v in exact(x, np.arange(1200), range(0, 1200, 3), 5).items()}
    assert max(kept, default=0) <= 400 * 20


def test_blocks_of_lists():
    cut = ann.Layout.of(np.array([0, 3, 4, 25, 0, 6, 6]), 10)
    assert cut.first.tolist() == [0, 0, 0, 1, 3, 4, 5] and cut.parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    assert cut.low.tolist() == [0, 3, 3, 3, 5, 6] and cut.high.tolist() == [3, 4, 4, 5, 6, 7]


def test_walk_is_a_beam_search():
    rng = np.random.default_rng(8)
    unit = lambda n: ann.unit(rng.standard_normal((n, 12)))
    c, q = unit(150), unit(20)
    graph = np.argsort(-(c @ c.T), axis=1)[:, :6]
    graph[:, -1] = (np.arange(150) + 1) % 150
    index = ann.Index(c, graph, np.array([0, 70]), 0.15, 2)
    for width in (1, 4, 30, 150):
        seen = index.walk(q, width)
        for i in range(len(q)):
            known, done = {0, 70}, set()
            while True:
                limit = sorted((float(q[i] @ c[x]) for x in known), reverse=True)[:width]
                now = [x for x in known - done if len(limit) < width or float(q[i] @ c[x]) >= limit[-1] - 1e-12]
                if not now:
                    break
                done |= set(now)
                known |= {int(y) for x in now for y in graph[x]}
            assert set(np.flatnonzero(np.isfinite(seen[i]))) == known
            assert np.allclose([seen[i, x] for x in known], [q[i] @ c[x] for x in known])


def test_shingles_of_odd_texts():
    names, bounds = near_dup.shingles(*utf8(pa.array([*ODD, "A b a B a b"])), 2)
    assert np.diff(bounds).tolist() == [0, 0, 0, 1, 1, 1, 1, 2]
    assert names[bounds[3]] == names[bounds[4]]
