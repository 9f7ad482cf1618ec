"""SimHash groups, phrases and the Merkle manifest against plain second computations."""

import itertools
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from twinlens.llm import components, merkle, phrases, simhash
from twinlens.llm.common import utf8

ODD = [None, "", " \t\n", "one", "ONE", "two words", "é é é é", "a b c d", "A  B\tC\nD"]


# SimHash


def fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    width = min(words, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids, distance):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    first = {}
    for k, i in enumerate(ids):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return [first.get(find(k)) for k in range(len(prints))]


def texts_of(rng, n):
    out = list(ODD)
    for _ in range(n):
        base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(base))
            base[rng.randrange(len(base))] = "new" + str(rng.random())
    return out


@pytest.mark.parametrize(("words", "homes"), [(4, 4096), (5, 2)])
def test_simhash_groups_are_the_components_of_all_links(spark, monkeypatch, words, homes):
    """Also with anchors that are cut into parts."""
    monkeypatch.setattr(simhash.links, "__defaults__", (4, homes))
    texts = texts_of(random.Random(words), 40)
    ids = [None if k in (7, 30) else 500 - k for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", k, "r") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, fp string, home long, root string")
    rows = simhash.near_duplicates(df.repartition(5), words).collect()
    prints = [fingerprint(t, words) for t in texts]
    want = Counter(zip(ids, [f"{p:016x}" for p in prints], groups(prints, ids, 4)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})


def test_fingerprints_do_not_depend_on_how_many_hashes_are_held(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    texts = texts_of(random.Random(2), 10)
    assert simhash.fingerprints(*utf8(pa.array(texts)), 3).tolist() == [fingerprint(t, 3) for t in texts]


@pytest.mark.parametrize("blocks", [simhash.FINE, simhash.FINER])
def test_every_close_pair_meets_at_a_home(spark, blocks):
    """Any four bits may differ: one of the two is at home where the other one comes."""
    assert sum(b.differ + 1 for b in blocks) >= simhash.DISTANCE + 1 and sum(b.bits for b in blocks) == 64
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    close = [(c, c ^ sum(1 << b for b in rng.sample(range(64), k))) for c in centre for k in (1, 2, 3, 4, 4, 4, 4)]
    prints = np.array(sorted({x for p in close for x in p}), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    cells = {}
    for r in simhash.covered(df, blocks).collect():
        cells.setdefault(r["cell"], []).append((r["fp"] % 2**64, r["home"]))
    met = {(a, b) for members in cells.values() for a, home in members if home for b, _ in members}
    assert all((a, b) in met and (b, a) in met for a, b in close)


@pytest.mark.parametrize("block", [*simhash.FINE, *simhash.FINER[:1]])
def test_codes_are_perfect(block):
    """Every syndrome has one lightest pattern, within the covering radius."""
    ways = block.ways()
    assert len(ways) == (1 << (block.generator.bit_length() - 1))
    for s, way in enumerate(ways):
        weights = [int(w).bit_count() for w in way]
        assert weights == sorted(weights) and weights[0] <= block.radius and weights.count(weights[0]) == 1 or s == 0 and weights[0] == 0
        assert (block.syndromes(way) == s).all()


def test_simhash_of_nothing_and_of_a_very_long_text(spark):
    schema = "doc_id string, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000 + "x" * 500_000
    rows = simhash.near_duplicates(spark.createDataFrame([("b", long), ("a", long.upper()), ("c", "alone in here now")], schema), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {"b": "a", "a": "a", "c": "c"}
    assert {r["fingerprint"] for r in rows if r["doc_id"] != "c"} == {f"{fingerprint(long, 4):016x}"}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(80)] + [(1000, 1000 + i) for i in range(200)] + [(-5, -9), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(6)
    roots = {r["member"]: r["root"] for r in components.components(df).collect()}
    assert roots == {**{i: 0 for i in range(1, 81)}, **{1000 + i: 1000 for i in range(1, 200)}, -5: -9}


# phrases


def mined(rows, least, top, inside):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= least:
                cuts = [(10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                longer = [f[t] for t in f if len(t) > len(g) and f[t] >= least and g in (t[:2], t[1:])] if len(g) == 2 else []
                if all(100 * x < inside * a for x in longer):
                    found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def prose(rng, n):
    words = [rng.choice(["al", "be", "ga", "dé", "日", "x-y", "It's"]) + str(rng.randint(0, 9)) for _ in range(40)]
    fixed = [[rng.choice(words) for _ in range(rng.randint(2, 4))] for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(fixed) if rng.random() < 0.4 else [rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(60)]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(10, 2000, 2_000_000), (3, 5, 2_000_000), (3, 7, 10), (1, 3, 40)])
def test_phrases_against_all_counts(spark, monkeypatch, least, top, block):
    """Few rows wanted, so that several rounds of thresholds are taken, and frontiers in several blocks."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "STEP", 1 if top < 2000 else 256)
    rng = random.Random(top)
    rows = [(lang, t) for lang in ("en", "de", None, "und") for t in prose(rng, 12)] + [(None, t) for t in ODD] + [("fr", None), ("fr", "..,"), ("en", "a. b! c? d")]
    df = spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, score int, phrase string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, top, 50).collect())
    assert got == mined(rows, least, top, 50)


def test_phrases_without_a_list_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS", 1)
    rows = [("en", t) for t in prose(random.Random(3), 10)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 4).collect())
    assert got == mined(rows, 4, 2000, 50)


def test_words_that_share_a_name_get_new_ones(spark, monkeypatch):
    """With short names two words meet; the seed goes on until none do."""
    seeds = []
    made = phrases.count_words

    def counted(docs, seed):
        seeds.append(seed)
        return made(docs, seed) if seed > 43 else made(docs, seed).withColumn("name", F.lit(1).cast("long"))

    monkeypatch.setattr(phrases, "count_words", counted)
    rows = [("en", t) for t in prose(random.Random(4), 6)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 4).collect())
    assert seeds == [42, 43, 44] and got == mined(rows, 4, 2000, 50)


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [(None, "")], [("en", "once only")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


# the manifest


def postorder(n):
    """(level, index) of the nodes of a tree of ``n`` leaves in completion order, by walking it."""

    def walk(level, index):
        if level:
            for child in range(index * 16, min(index * 16 + 16, -(-n // 16 ** (level - 1)))):
                yield from walk(level - 1, child)
        yield level, index

    h = 0
    while 16**h < n:
        h += 1
    return list(walk(h, 0))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 256, 257, 300, 4096, 4097, 5000, 4096 * 16 + 1])
def test_positions_are_those_of_a_walk(n):
    assert [merkle.position(level, index, n) for level, index in postorder(n)] == list(range(len(postorder(n))))


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, siblings (before, after) of each leaf)"""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            paths[k].append(("".join(leaves[first:i]), "".join(leaves[i + 1 : first + 16])))
            at[k] = i // 16
        leaves = [h(*leaves[i : i + 16]) for i in range(0, len(leaves), 16)]
    return leaves[0], paths


def manifested(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(part, r))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[s] = tree([leaf(r) for r in by[s]])
    root, paths = tree([below[s][0] for s in names])
    out = []
    for s, upper in zip(names, paths, strict=True):
        for r, path in zip(by[s], below[s][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            up = leaf((*r[:4], None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if bad else leaf(r)
            for before, after in path + upper:
                up = h(before, up, after)
            out.append((r[0], leaf(r), below[s][0], root, h(*(b + a for b, a in path + upper)), up, up == root))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def made(spark, rows, levels=3):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], f"{COLUMNS}, tree string, idx int").repartition(4)
    given = [F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    out = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, given, levels)
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_a_plain_one(spark, levels):
    """Also with small blocks, so that trees take several rounds of builders."""
    rng = random.Random(levels)
    some = lambda: rng.choice([None, "", "Ab", "é日", "x" * 40])
    sizes = {"hot": 700, None: 18, "": 17, "one": 1, "é": 16, "b": 33, **{f"s{k}": 2 for k in range(40)}}
    ids = iter(rng.sample(range(-500, 5000), sum(sizes.values())))
    rows = [(next(ids), s, some(), rng.choice([None, 0, -3, 10**12]), some()) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "hot", None, None, None), (None, None, "a", 1, "B"), rows[3], rows[3], (rows[5][0], "hot", "zz", 1, "Q")]
    rng.shuffle(rows)
    assert made(spark, rows, levels) == Counter(manifested(rows))


def test_small_manifests(spark):
    assert not made(spark, [])
    for rows in ([(1, None, None, None, None)], [(1, "a", "b", 2, "C"), (2, "b", None, None, "")], [(7, "a", "b", 2, "C")] * 20):
        assert made(spark, rows) == Counter(manifested(rows))


def test_log_holds_every_node_once(spark):
    leaves = [("a", 300, i, h(str(i))) for i in range(300)] + [("b", 1, 0, h("b"))]
    log = merkle.append_log(spark.createDataFrame(leaves, "tree string, n long, idx long, digest string"), 1).collect()
    at = {}
    for r in log:
        for k, d in enumerate(r["nodes"]):
            assert (r["tree"], r["pos"] + k) not in at
            at[r["tree"], r["pos"] + k] = d
    assert sorted(at) == [("a", k) for k in range(300 + 19 + 2 + 1)] + [("b", 0)]
    assert at["a", 321] == tree([x[3] for x in leaves[:300]])[0] and at["b", 0] == h("b")
