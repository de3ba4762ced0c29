"""Exact copies, ranked search and hard negatives on small tables, against plain versions."""

import collections
import hashlib
import math
import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import llm_cases as cases
from ledgerlift.llm import exact, lexical, negatives

ROWS = cases.documents()
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").encode().translate(cases.LETTERS)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, extra=True).cache()


# exact copies


def copies(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    best = lambda ids: max(ids, key=lambda i: (i is not None, i))
    return sorted((str((i, best(g), len(g), hashlib.sha256(t).hexdigest())) for t, g in groups.items() for i in g))


@pytest.mark.parametrize("bits", [64, 5])
def test_copies_are_found_whatever_digests_clash(docs, bits):
    out = exact.find_copies(docs, bits=bits)
    got = out.collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == copies(ROWS)
    stay = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(stay) == {r.text_sha256 for r in got} and set(stay.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert out.columns.count("kept") == 1 and "lang" in out.columns and "text" not in out.columns


def test_clashes_are_told_apart(spark):
    # with so few digests nearly every list of digests is another text's, too
    rows = [(i, f"text {i % 40}. " * 90, None, None, None) for i in range(120)]
    got = exact.find_copies(cases.frame(spark, rows), bits=2).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 80 + i % 40, 3) for i in range(120)}


def test_rows_that_stay_come_whole(spark, docs):
    got = exact.without_copies(docs).collect()
    assert sorted(low(r.text) for r in got) == sorted({low(t) for _, t, *_ in ROWS})
    assert exact.without_copies(docs).columns == docs.columns
    assert exact.find_copies(cases.frame(spark, [])).count() == 0
    assert exact.without_copies(cases.frame(spark, [])).count() == 0


def test_chunks_follow_the_content(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     .é語𝄞"))
    text = "".join(rng.choice(letters, 60_000))
    rows = [(0, text), (1, "a new start " + text), (2, "x" * 10_000), (3, ""), (4, "short")]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", exact.chunks(F.col("t"))).collect())
    assert all("".join(got[i]) == t for i, t in rows)
    assert len(got[0]) > 50 and len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])
    assert max(map(len, got[2])) <= exact.MOST and got[3] == [] and got[4] == ["short"]


def test_a_copy_in_a_third_of_all_rows(spark):
    rows = [(i, "Hot text. " * 200 if i % 3 == 0 else f"text {i}", None, None, None) for i in range(3000)]
    got = exact.find_copies(cases.frame(spark, rows)).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {2997} and sum(r.kept for r in got) == 1


# ranked search


def ranking(docs, items, most):
    held = [(i, collections.Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in items:
        asked = set(TERM.findall(low(text)))
        scores = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in asked if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i))
        out[item] = [(i, -s) for s, _, i in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most]]
    return out


ITEMS = [(1, "w1 W2 w3 w3 w17 w200 w399"), (2, None), (3, "..."), (4, "σας İ ß x"), (5, "w5"), (6, " ".join(f"w{i}" for i in range(400))),
         (7, "nothing of these"), (5, "w5"), (8, "text words own")]


def found(spark, docs, items, most=50):
    items = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit("clash"))
    out = collections.defaultdict(list)
    for r in sorted(lexical.search(docs, items, most).collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


@pytest.mark.parametrize("most, block_terms", [(50, 50_000), (5, 3), (1, 300)])
def test_search_ranks_as_the_plain_version(spark, docs, monkeypatch, most, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    want = ranking([r[:2] for r in ROWS], ITEMS, most)
    assert found(spark, docs, ITEMS, most) == {k: v for k, v in want.items() if v}


def test_search_breaks_ties_by_id(spark):
    rows = [(i, "same words here" if i % 2 else "other", None, None, None) for i in range(300, 0, -1)]
    got = found(spark, cases.frame(spark, rows), [(1, "words")], 20)
    assert [i for i, _ in got[1]] == list(range(1, 41, 2))


def test_search_takes_empty_tables(spark, docs):
    assert found(spark, docs, []) == {}
    assert found(spark, cases.frame(spark, []), ITEMS) == {}
    assert found(spark, cases.frame(spark, [(1, None, None, None, None)]), ITEMS) == {}


def test_terms_of_a_long_text_come_in_slices(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_BYTES", 7)
    text = "Ab1 é-ÀB\x00c\x7fd ___ zz" * 50 + "long" * 30
    parts = list(lexical.terms(text.encode()))
    assert len(parts) > 20 and [t for p in parts for t in p] == TERM.findall(low(text))
    assert list(lexical.terms(b"")) == []


def test_limited_accumulators_lose_nothing():
    rng = np.random.default_rng(11)
    closed = 0
    for _ in range(300):
        size, vocabulary, most = int(rng.integers(1, 60)), int(rng.integers(1, 12)), int(rng.integers(1, 8))
        held = rng.random((size, vocabulary)) < rng.random(vocabulary) ** 2
        share = rng.integers(0, 4, (size, vocabulary)) * rng.integers(1, 50, vocabulary) ** 2
        doc, ids = np.nonzero(held)
        block = lexical.Block(ids.astype(np.int32), doc, share[doc, ids].astype(np.int64), size)
        order = np.argsort(held.sum(0), kind="stable")
        total = (held * share).sum(1)
        least = int(rng.choice([1, 1, total.max() // 2 + 1]))
        got, score = block.search(order, most, least)
        assert (score == total[got]).all()
        good = sorted(-total[total >= least])[:most]
        ties = [i for i in np.flatnonzero(total >= least) if good and total[i] >= -good[-1]]
        assert sorted(got) == ties
        closed += len(ties) < np.count_nonzero(total)
    assert closed > 50


# hard negatives


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist(), int(rng.integers(0, 3))) for i in range(1, 161)]
    rows += [(200, [0.5, 0.25, 0.0, 1.0], 1), (201, [0.5, 0.25, 0.0, 1.0], 1), (202, [0.5, 0.25, 0.0, 0.7], 2), (203, [0.5, 0.25, 0.0, 0.7], 2)]
    rows += [(250, [0.0] * 4, 1), (300, None, 1), (310, [1.0, None, 0.0, 0.0], 1), (320, [1.0, float("nan"), 0.0, 0.0], 1),
             (330, [1.0, float("inf"), 0.0, 0.0], 1), (340, [1.0, 2.0], 1), (350, [], 1), (400, [1.0] * 4, None), (None, [1.0] * 4, 1),
             (450, [-1.0] * 4, 9), (50, rows[49][1], rows[49][2])]
    return rows


def mined(rows, step, positives=5, most=3):
    good = {i: (l, np.floor(256 * np.array(v)).astype(int)) for i, v, l in rows
            if i is not None and l is not None and v is not None and len(v) == 4
            and not any(x is None or not math.isfinite(x) for x in v)}
    out = []
    for a, (l, v) in good.items():
        if a % step:
            continue
        scores = sorted((-int(v @ w), i, k) for i, (k, w) in good.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == l][:positives]:
            inside = [x for x in scores if x[2] != l and 50 * -s <= 100 * -x[0] <= 95 * -s][:most]
            out += [(a, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(inside)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int"


def mine(spark, rows, step=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))
    out = negatives.mine(df, F.col("vec_id") % step == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block", [4096, 9])
def test_negatives_are_those_of_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    want = mined(vectors(), 10)
    assert len(want) > 50 and mine(spark, vectors()) == want


def test_negatives_with_other_sizes_and_copies(spark):
    rows = [(i, v if i is None or i % 3 else [0.5, 0.5, 0.5, 0.5], l) for i, v, l in vectors()]  # many equal vectors
    assert mine(spark, rows, positives=2, most=7) == mined(rows, 10, 2, 7)


def test_negatives_of_little(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(10, [1.0], 1)]) == []
    assert mine(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert mine(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.95], 2), (13, [0.5], 2)]) == [(10, 11, 1, 12, 65536, 62208), (10, 11, 2, 13, 65536, 32768)]


def test_products_are_exact():
    a, b = np.array([[3.0, -5.0], [2.0**40, 1.0]]), np.array([[7.0, 2.0], [2.0**40, 3.0], [1e300, 0.0]])
    assert negatives.products(a[:1], b[:1]).tolist() == [[11]]
    top = negatives.LONGEST
    assert negatives.products(a, b).tolist() == [[11, 3 * 2**40 - 15, top], [7 * 2**40 + 2, top, top]]
    assert negatives.products(np.array([[2.0**31, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**61 + 1]]


def test_near_copies_are_confirmed_in_pieces():
    import pyarrow as pa

    from ledgerlift.llm import minhash

    n = 2 * minhash.AT_ONCE + 5
    text = "one two three four five six seven eight nine ten"
    other = [text if i % 3 else "nothing of this is said above at all" for i in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([text] * n), pa.array(other)], names=["a", "b", "text_a", "text_b"])
    out = list(minhash._confirm(minhash.SHINGLE)(iter([batch])))
    assert len(out) == 3 and max(b.num_rows for b in out) <= minhash.AT_ONCE
    assert [i for b in out for i in b.column(1).to_pylist()] == [i for i in range(n) if i % 3]
