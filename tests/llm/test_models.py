"""Language, quality, toxicity and tokenizer operators: odd inputs, brute force and held-out accuracy on the small tables."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinlens.llm import boosting, language_id, pieces, quality, toxicity
from twinlens.llm.common import Hasher, per_text, text_slices, utf8

SCHEMA = "doc_id long, text string, lang string, score string, ids string, n_ids string, worst string"
ODD = [None, "", " ", "\n\n", "a", "7", "!?.", "é", "日本", "word " * 40_000, "x" * 50_000]


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, "s", "i", "n", "w") for i, t, g in zip(ids, texts, langs, strict=True)], SCHEMA)


def test_utf8_and_slices():
    column = pa.array(["ab", None, "", "é", "cde"])
    data, bounds = utf8(column.slice(1))
    assert bytes(data) == "écde".encode() and bounds.tolist() == [0, 0, 0, 2, 5]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert [len(b) - 1 for _, _, b in text_slices([batch], "text", 3)] == [3, 1, 1]
    assert [x.num_rows for x, _, _ in text_slices([batch.slice(0, 0)], "text")] == []
    assert per_text(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3])).tolist() == [0, 3, 0, 3]


def test_hashes_do_not_depend_on_the_place():
    a, b = np.frombuffer(b"xx word yy", np.uint8), np.frombuffer(b"word", np.uint8)
    assert Hasher(a).of(np.array([3]), np.array([7])) == Hasher(b).of(np.array([0]), np.array([4]))


def test_language_of_odd_texts(spark):
    train = frame(spark, ["the cat and the dog and the house"] * 30 + ["der hund und die katze und das haus"] * 20, langs=["en"] * 30 + ["de"] * 20)
    model = language_id.learn(train)
    rows = language_id.identify(frame(spark, [*ODD, "and the dog", "und die katze"], [None, *range(1, len(ODD) + 2)]), model).collect()
    got = [(r["lang_pred"], r["score"]) for r in rows]
    assert [g[0] for g in got[:4]] == ["und"] * 4 and got[5] == ("und", 0.0) and got[6] == ("und", 0.0)
    assert got[-2][0] == "en" and got[-1][0] == "de" and got[4][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got) and rows[0]["ids"] == "i"
    assert language_id.identify(frame(spark, []), model).count() == 0
    none = language_id.learn(train.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(train, none).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(8)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(150)]
    some = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    # the later ones are rarer
    langs = [k for k in range(150) for _ in range(2 + (150 - k) // 50)]
    model = language_id.learn(frame(spark, [some(k, 40) for k in langs], langs=[f"l{k}" for k in langs]))
    assert len(model.names) == 150 and model.slots.shape[0] == 3
    rows = language_id.identify(frame(spark, [some(k, 20) for k in range(150)]), model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']}" and r["score"] > 0.5 for r in rows)


def test_filter_has_few_false_positives(spark):
    model = language_id.learn(frame(spark, ["the cat and the dog and the house " * 5] * 5))
    data = np.frombuffer(b" the cat and ", np.uint8)
    codes, _ = language_id.grams(data, np.array([0, len(data)]))
    assert (model.languages_of(codes) == 1).all()
    other = np.random.default_rng(0).integers(0, 1 << 32, 100_000, dtype=np.uint32)
    assert model.languages_of(other).mean() < 0.01


@pytest.mark.parametrize(("name", "truth", "least"), [("op1_language_id", "lang", 0.98), ("op2_quality", "quality", 0.9), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, truth, least):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = entry.queries()[name](spark, sf)
    assert rows.count() == docs.count()
    known = docs.select("doc_id", "lang") if truth == "lang" else spark.read.parquet(f"{sf}/labels.parquet")
    held = rows.where("held_out").join(known.select("doc_id", truth), "doc_id")
    right = F.col("lang_pred" if truth == "lang" else "predicted") == F.col(truth)
    assert held.select(F.avg(right.cast("double"))).first()[0] >= least
    parts = 4 if truth == "lang" else 5
    assert rows.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == (2 if parts == 4 else 0))).count() == 0


def test_statistics_of_odd_texts():
    data, bounds = utf8(pa.array([*ODD[:9], "Aa bb bb\nCC! x\n\nCC! x"]))
    values = quality.statistics(data, bounds)
    assert np.isfinite(values).all() and not values[0].any() and not values[1].any()
    by = dict(zip(quality.NAMES, values[-1], strict=True))
    assert by["words"] == pytest.approx(math.log1p(7)) and by["lines"] == pytest.approx(math.log1p(3))
    assert by["repeated_lines"] == pytest.approx(1 / 3) and by["distinct_words"] == pytest.approx(4 / 7) and by["top_word"] == pytest.approx(2 / 7)


def test_scores_of_odd_texts_and_labels(spark):
    docs = frame(spark, [*ODD, *["good prose here."] * 40, *["BAD!! ###"] * 40])
    n = len(ODD)
    labels = spark.createDataFrame([(i, int(i < n + 40), int(i >= n + 40)) for i in range(n, n + 80)] + [(3, None, None), (None, 1, 1), (9999, 0, 0), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.learn(docs, labels, label)
        rows = {r["doc_id"]: r for r in module.score(docs, model).collect()}
        assert len(rows) == n + 80 and all(0 <= r["score"] <= 1 for r in rows.values())
        low, high = (rows[n + 79], rows[n]) if label == "quality" else (rows[n], rows[n + 79])
        assert low["score"] < 0.3 < 0.5 < high["score"] and high["predicted"] == 1 and low["predicted"] == 0
        assert module.score(docs.limit(0), model).count() == 0
        empty = module.learn(docs, labels.limit(0), label)
        assert module.score(docs, empty).count() == n + 80


def test_toxic_sentence_is_located(spark):
    clean = [f"Some plain words number w{k}. Another one here." for k in range(60)]
    bad = [f"Some plain words w{k}. You utter scoundrel! Another one here." for k in range(60)]
    docs = frame(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    found = toxicity.sentences(docs, model).collect()
    assert {r["doc_id"] for r in found} == set(range(60, 120)) and {r["sentence"] for r in found} == {" You utter scoundrel!"}
    worst = toxicity.score(docs, model).where("doc_id = 60").first()["worst"]
    assert bad[0].encode()[worst["start"] : worst["end"]] == b" You utter scoundrel!"


def test_noisy_or_gradient():
    rng = np.random.default_rng(0)
    key, sentences, texts, y = rng.integers(0, 5, 30), np.array([0, 4, 10, 10, 19, 30]), np.array([0, 2, 3, 5]), np.array([1, 0, 1])

    def loss(w, b):
        p = 1 / (1 + np.exp(-(b + per_text(w[key], sentences))))
        whole = toxicity.noisy_or(p, texts)
        assert whole == pytest.approx([1 - np.prod(1 - p[a:c]) for a, c in zip(texts[:-1], texts[1:], strict=True)])
        return -np.mean(y * np.log(whole) + (1 - y) * np.log(1 - whole))

    before = loss(np.zeros(5), -6.0)
    model = toxicity.fit(key, sentences, texts, y, epochs=60)
    assert loss(model.weight[:5], model.bias) < before


def test_boosted_trees_match_a_slow_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    bounds = boosting.edges(x)
    forest = boosting.fit(boosting.binned(x, bounds), y, trees=40, depth=3)
    bins = boosting.binned(x, bounds)
    slow = []
    for row in bins:
        m = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if row[f[node]] <= t[node] else 2)
            m += v[node - len(f)]
        slow.append(m)
    assert forest.margin(bins) == pytest.approx(np.array(slow))
    assert ((forest.probability(bins) > 0.5) == y).mean() > 0.95


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load("/opt/tokenizers/piece_bpe_32k.model")


def best_score(v, word):
    table = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k == v.NORMAL}
    best = [0.0]
    for j in range(1, len(word) + 1):
        options = [best[i] + table[word[i:j]] for i in range(max(0, j - v.longest), j) if word[i:j] in table]
        if word[j - 1] not in table:
            options.append(best[j - 1] + v.unknown)
        best.append(max(options))
    return best[-1]


def test_pieces_are_the_best_ones(vocabulary):
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("abetinghoursé日𝒳\x01") for _ in range(rng.randint(1, 18))) for _ in range(500)] + ["▁▁▁the", "▁" + "ab" * 700]
    by_piece = {p: i for i, p in enumerate(vocabulary.pieces)}
    assert by_piece["▁the"]
    for word, ids in zip(words, vocabulary.encode_words(words), strict=True):
        known = sum(vocabulary.scores[i] for i in ids if vocabulary.kinds[i] == vocabulary.NORMAL)
        unknown = sum(c not in by_piece or vocabulary.kinds[by_piece[c]] != vocabulary.NORMAL for c in word)
        assert known + unknown * vocabulary.unknown == best_score(vocabulary, word)
        assert vocabulary.decode(ids) == word.replace("▁", " ")[1:]


def test_round_trip_and_the_librarys_decoder(spark, vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    rng = random.Random(4)
    texts = [*ODD, *["".join(rng.choice("ab é日\x01  \n\t𝒳The ing.") for _ in range(rng.randint(0, 60))) for _ in range(200)], "a ▁ b"]
    rows = pieces.encode(frame(spark, texts), vocabulary, check=True).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["same"] and (r["ids"] is None) == (text is None) and r["n_ids"] == len(r["ids"] or [])
        if text:
            assert library.decode(r["ids"]) == text.replace("▁", " ")
    back = pieces.decode(pieces.encode(frame(spark, texts), vocabulary), vocabulary).collect()
    assert [r["text"] for r in back] == [None if t is None else t.replace("▁", " ") for t in texts]
    assert pieces.decode(spark.createDataFrame([([315, None, -1, 99999],)], "ids array<int>"), vocabulary).first()["text"] == vocabulary.decode(np.array([315]))


@pytest.mark.parametrize("window", [1, 5, 64])
def test_long_words_are_worked_through_in_windows(vocabulary, monkeypatch, window):
    rng = random.Random(window)
    words = ["▁" + "".join(rng.choice("theinganda日é\x01") for _ in range(n)) for n in (1, 4, 5, 6, 63, 64, 65, 300) for _ in range(3)]
    whole = vocabulary.encode_words(words)
    monkeypatch.setattr(pieces, "WINDOW", window)
    assert all((a == b).all() for a, b in zip(whole, vocabulary.encode_words(words), strict=True))


def test_a_very_long_word(spark, vocabulary):
    text = "thequickbrownfox" * 12_500
    row = pieces.encode(frame(spark, [text]), vocabulary, check=True).first()
    assert row["same"] and vocabulary.decode(np.array(row["ids"])) == text


def test_texts_stay_with_the_workers(spark, vocabulary):
    texts = [None, "", "a b", "the ▁ word\x01"]
    whole = pieces.encode(frame(spark, texts), vocabulary, check=True)
    short = pieces.encode(frame(spark, texts), vocabulary, check=True, texts=False)
    assert short.columns == [c for c in whole.columns if c != "text"]
    assert short.collect() == whole.drop("text").collect()


def test_ids_are_compared_in_bounded_memory(vocabulary):
    texts = ["the word of a day " * 50] * 3000 + ["▁ x", "", None]
    data, bounds = pieces.marked(pa.array(texts))
    encoder = pieces.Encoder(vocabulary)
    ids, ends = encoder.encode(data, bounds)
    wrong = ids.copy()
    wrong[ends[7]] = 5
    tracemalloc.start()
    assert encoder.same(ids, ends, data, bounds).all()
    assert np.flatnonzero(~encoder.same(wrong, ends, data, bounds)).tolist() == [7]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 2_500_000 and peak < 2 * len(data)


def test_a_model_with_marks_inside_pieces_is_refused(monkeypatch):
    import sentencepiece

    class Model:
        def __init__(self, model_file):
            self.pieces = ["<unk>", "▁a", "a▁b"]

        get_piece_size = lambda self: 3
        is_byte = is_control = is_unused = lambda self, i: False
        is_unknown = lambda self, i: i == 0
        get_score = lambda self, i: -1.0
        id_to_piece = lambda self, i: self.pieces[i]

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="mark"):
        pieces.load("any")
