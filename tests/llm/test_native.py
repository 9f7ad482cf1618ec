"""The operators that are DataFrame operations alone, against brute force on small and odd inputs."""

import random
import re

import pytest

from twinlens.llm import pii
from twinlens.llm.decontamination import contamination, proximity
from twinlens.llm.line_dedup import _blank, dedup_lines

SCHEMA = "doc_id long, text string, shift int, place string, item string, n_removed string"
ODD = [None, "", " \n\t", "\n\n\n", "a", "é… x", "word " * 3000]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "p", "q", "z") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def pii_texts():
    rng = random.Random(3)
    bits = ["a@b.c", "a@b.c%x@y.zz", "x@y@z.de", "b.@c.d", "a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.0001", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 ", "5500000000000004",
            "+1 (555) 555-0101", "+49 30 1234567", "+1+2", "+123456789012345678", "é", "𝒳", " ", "\n", "9", "- ", "12 34", "[at]", "me [at] x [dot] org", "token = \"0a1b2c3d4e5f60718293a4b5\"", "call: 555 123 4567", ".", "@", "@@", "-"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["1" * 20000, "a" * 30000, "a." * 9000 + "@b" + ".c" * 9000, "1." * 9000, "a@b.co " * 300]


def test_base_spans_of_personal_data(spark):
    texts = [*ODD, *pii_texts()]
    rows = pii.find(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [(s["kind"], s["s"], s["e"]) for s in r["spans"] if s["base"]]
        want = base_spans(texts[r["doc_id"]])
        assert got == sorted(want, key=lambda x: (pii.BASE.index(x[0]), x[1])), texts[r["doc_id"]][:200]
        own = [s for s in r["spans"] if not s["base"]]
        assert not any(s <= o["s"] and o["e"] <= e for o in own for _, s, e in got)


def test_personal_data_beyond_the_base(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'all of it token = "{key()}" and so on' for _ in range(200)] + [f"see {key()} here" for _ in range(12)] + ["plain words only"] * 50
    rows = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}
    assert all(any(s["kind"] == "secret" for s in rows[i]) for i in range(212))
    assert not any(rows[i] for i in range(212, 262))
    left = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert left[200] == "see <secret> here" and left[230] == "plain words only"


def test_few_cued_among_many_alike(spark):
    """What has a cue of its own is found, however many strings of its format have none."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    cued = [f"so token = {key()} it is" for _ in range(5)] + [f"phone: {number()} it is" for _ in range(5)] + ["write to me [at] host [dot] org it is"] * 3
    texts = cued + [f"commit {key()} it is" for _ in range(150)] + [f"paid {number()} it is" for _ in range(150)] + ["we look at them. They go"] * 100
    rows = {r["doc_id"]: [(s["kind"], s["s"], s["e"]) for s in r["spans"]] for r in pii.find(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        kind, mark = ("secret", "= ") if k < 5 else ("number", ": ") if k < 10 else ("spelled", " to ")
        start = text.find(mark) + len(mark)
        assert rows[k] == ([(kind, start, len(text) - 6)] if k < len(cued) else []), text


def test_personal_data_without_rows(spark):
    assert pii.find(frame(spark, [])).count() == 0
    assert [r["spans"] for r in pii.find(frame(spark, [None, "", "none"], [None, None, 3])).collect()] == [[], [], []]


def brute_lines(texts, min_chars):
    seqs = []
    for t in texts:
        parts = (t or "").split("\n") if t is not None else []
        seqs.append([(k, p) for k, p in enumerate(parts) if p.strip(" \t\r\f\v")])
    gone = [set() for _ in texts]
    first = {}
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                first.setdefault(tuple(p for _, p in seq[a:b]), (d, a))
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                run = tuple(p for _, p in seq[a:b])
                if sum(map(len, run)) >= min_chars and first[run] < (d, a):
                    gone[d] |= {k for k, _ in seq[a:b]}
    return gone


@pytest.mark.parametrize("min_chars", [1, 7, 40])
def test_line_dedup_against_all_runs(spark, min_chars):
    rng = random.Random(min_chars)
    texts = [*ODD[:6]] + ["\n".join(rng.choice(["a", "bb", "", "ccc", "dddd d", "a long line of this text", "x" * 45]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = dedup_lines(frame(spark, texts), min_chars).collect()
    want = brute_lines(texts, min_chars)
    assert len(rows) == len(texts)
    for r in rows:
        text, gone = texts[r["doc_id"]], want[r["doc_id"]]
        assert set(r["removed_at"]) == gone and r["n_removed"] == len(gone)
        assert r["text"] == (None if text is None else "\n".join(p for k, p in enumerate(text.split("\n")) if k not in gone))
        assert r["shift"] == 1 and r["item"] == "q"


def test_line_dedup_with_repeated_rows_and_null_ids(spark):
    line = "one line that is long enough to count as a run"
    rows = dedup_lines(frame(spark, [line, line, line, "z\n" + line], [5, 5, None, 7])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in rows) == [(-1, line), (5, ""), (5, ""), (7, "z")]
    assert dedup_lines(frame(spark, [])).count() == 0


def test_blank_lines_are_told_by_their_first_characters(spark):
    blank, other = ["", " ", "\t \r\f\v", " " * 500], ["a", " \t.", "\x00", "\xa0", " \x1c ", "é ", "\u2028", "\x85"]
    rows = spark.createDataFrame([(t,) for t in blank + other], "c string")
    assert [r[0] for r in rows.select(_blank(rows["c"])).collect()] == [True] * len(blank) + [False] * len(other)
    # no line is rewritten as a whole to look at it
    assert "translate" not in dedup_lines(frame(spark, blank + other))._jdf.queryExecution().optimizedPlan().toString()


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(texts, items, window):
    split = lambda t: re.findall(WORD, (t or "").translate(AZ))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for item, body in items:
            x = split(body)
            m = min(window, len(x))
            for s in range(len(x) - m + 1 if x else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[s : s + m]:
                        hit |= set(range(p, p + m))
                        ids.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_contamination_against_all_windows(spark):
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["The", "of", "É", "x1", "q", "rare", "End."]) for _ in range(n))
    items = [(k, some(rng.randint(0, 9))) for k in range(30)] + [(10, None), (None, "only once there"), (100, ""), (3, "É é"), (200, "rare " * 8)]
    texts = [*ODD, *[some(rng.randint(0, 60)) for _ in range(60)], "so ONLY, once there. " * 3, "rare " * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(frame(spark, texts), bench, 4).collect()
    want = brute_contamination(texts, items, 4)
    assert len(rows) == len(texts)
    by_key = {(r["doc_id"]): (r["n_words"], r["n_hit"], r["items"]) for r in rows}
    assert [by_key[i] for i in range(len(texts))] == want


def test_contamination_of_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = frame(spark, ["x a b c d e f g h i j", "x a b c d e f g h i j", None], [4, 4, None])
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(docs, bench).collect()) == [(0, 0, 0), (11, 10, 1), (11, 10, 1)]
    assert [r["n_hit"] for r in contamination(docs, bench.limit(0)).collect()] == [0, 0, 0]
    assert contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = frame(spark, ["gamma x alpha y beta", "alpha beta", "alpha " + "x " * 30 + "beta gamma", "alpha beta gamma"])
    assert sorted(r["doc_id"] for r in proximity(docs, bench, window=3, slack=5).collect()) == [0, 3]


def test_redaction_of_overlaps(spark):
    text = "mail a@b.co or +1 (555) 555-0101!"
    (row,) = pii.redact(frame(spark, [text])).collect()
    assert row["text"] == "mail <email> or <phone>!"
