"""The training-data operators on small tables, against plain versions."""

import collections
import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import llm_cases as cases
from ledgerlift.llm import ann, chat, fingerprints, langid, minhash, mixing, packing, sharding, substring, url_filter

ROWS = cases.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, extra=True).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return cases.frame(spark, [])


def key(v):
    return tuple((x is not None, x) for x in v)


# sharding


@pytest.mark.parametrize("shards, bucket_bytes", [(16, 20_000), (4, 1 << 20), (100, 500)])
def test_sharding_places_every_row_once(docs, shards, bucket_bytes):
    out = sharding.shuffle_shards(docs, shards, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert sorted(key((r.doc_id, r.text)) for r in got) == sorted(key(r[:2]) for r in ROWS)
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    counts = [len(held[s]) for s in range(shards)]
    assert set(held) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    again = sharding.shuffle_shards(docs.repartition(7), shards, bucket_bytes=bucket_bytes).collect()
    assert sorted(key((r.doc_id, r.shard, r.slot)) for r in again) == sorted(key((r.doc_id, r.shard, r.slot)) for r in got)
    assert "size" in out.columns and out.columns.count("shard") == 1


def test_sharding_mixes_and_takes_an_empty_table(spark, nothing):
    assert sharding.shuffle_shards(nothing).count() == 0
    rows = [(i, f"t{i}", None, None, None) for i in range(2000)]
    got = sharding.shuffle_shards(cases.frame(spark, rows), 4).where("shard = 0").collect()
    ids = np.array([r.doc_id for r in sorted(got, key=lambda r: r.slot)])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.2 and ids.max() > 1500 and ids.min() < 500


def test_shards_are_written_as_folders(spark, docs, tmp_path):
    out = sharding.shuffle_shards(docs, 4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() == 4


# fingerprints


def lines(text):
    cut = [re.split(r"(?<=[.!?]) ", line) if len(line) > fingerprints.LONG_LINE else [line] for line in (text or "").split("\n")]
    return {p for part in cut for p in part if p.strip(" ")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprint_rows(spark, tmp_path, rows):
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()


def test_fingerprints_recover_the_true_likeness(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(23):
        text = "\n".join(f"line {rng.integers(60)}" for _ in range(rng.integers(0, 90)))
        rows.append((i * 3, text, None, None, None))
    rows.append((99, "\n".join(" ".join(f"One {i} is {j}." for j in range(40)) for i in range(3)), None, None, None))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, rows[0][1], None, None, None)]
    got = {r.doc_id: r for r in fingerprint_rows(spark, tmp_path, rows)}
    order = sorted(rows, key=lambda r: -r[0])
    marks = {}
    for n, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(lines(text), lines(edited)))
        assert r.near_next == pytest.approx(jaccard(lines(text), lines(after)))
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(got) == len(rows)


def test_fingerprints_share_the_first_half_at_any_length(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for i, (n, run) in enumerate([(40, 8), (44, 8), (100, 12), (600, 10**6), (900, 10**6), (30, 5)] * 4):
        words = [word() + ("." if k % run == run - 1 else "") for k in range(n)]
        rows.append((i, " ".join(words), None, None, None))
    got = fingerprint_rows(spark, tmp_path, rows)
    assert len(got) == len(rows) and min(r.near_edited for r in got) > 0
    assert max(r.near_next for r in got) == 0


def test_paragraphs_of_a_stretch_do_not_depend_on_its_place(spark):
    rng = np.random.default_rng(5)
    run = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400))
    df = spark.createDataFrame([(run, "other words ahead of " + run + " and behind it", "")], "a string, b string, c string")
    r = df.select(*[fingerprints.paragraphs(F.col(c)).alias(c) for c in "abc"]).first()
    assert len(r.a) > 10 and len(set(r.a) & set(r.b)) >= len(r.a) - 2 and r.c == []


def test_fingerprints_of_odd_tables(spark, tmp_path):
    assert fingerprint_rows(spark, tmp_path / "none", []) == []
    one = fingerprint_rows(spark, tmp_path / "one", [(5, "a\nb", None, None, None)])[0]
    assert one.near_next == 1.0 and one.n_chars == 3
    twice = [(5, "a\nb", None, None, None)] * 2 + [(None, "c", None, None, None)] * 2
    assert len(fingerprint_rows(spark, tmp_path / "twice", twice)) == 4


# packing


def test_packing_cuts_every_id_once(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.encode_special_tokens = True
    want = sorted(
        (*key((i, t)), *tk.encode(t or "", add_special_tokens=False).ids, 2) for i, t, *_ in ROWS
    )
    got = packing.pack_documents(docs.withColumn("said", F.col("text")), length=256)
    rows = got.collect()
    at = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and 0 < r.length <= 256
        at[r.sequence_id].append((r.offset, r.length))
        by_doc[key((r.doc_id, r.said))].append((r.start, r.doc_tokens, tuple(ids)))
    for seq, cuts in at.items():
        cuts.sort()
        assert cuts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cuts, cuts[1:]))
        assert sum(n for _, n in cuts) == 256 or seq == max(at)
    assert sorted(at) == list(range(len(at)))
    again = []
    for (i, t), parts in by_doc.items():
        times = sum(1 for r in ROWS if key(r[:2]) == (i, t))
        whole = [x for p in sorted(parts) for x in p[2]]
        assert len(whole) == parts[0][1] * times
        if times == 1:
            again.append((i, t, *whole))
    assert [w for w in want if w in again] == sorted(again)
    assert packing.pack_documents(nothing).count() == 0


# url filters


def test_url_parts_rules_and_verdicts(spark):
    urls = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.ORG": ("a.example.org", "", None),
        "http://a.org/x?y=/es/": ("a.org", "/x", "org/"), "https://m.example.org/es/1#z": ("m.example.org", "/es/1", "example.org/es/"),
        "ftp://example.org/en/1": ("example.org", "/en/1", "example.org/en/1"), "x://notexample.org/es/": ("notexample.org", "/es/", "org/"),
        "http://q.com/de/": ("q.com", "/de/", "com/de/"), "http://q.com/fr/a": ("q.com", "/fr/a", "com/fr/"),
        "http://com?x=1": ("com", "", None), "http://É.NET/#": ("É.net", "/", None), "": ("", "", None),
    }
    urls |= {f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}": (f"h{i}.com", f"/{'de' if i % 2 else 'fr'}/{i}", f"com/{'de' if i % 2 else 'fr'}/") for i in range(60)}
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: r for r in url_filter.filter_urls(df).collect()}
    ruled = {h + p: v for v, h, p in url_filter.RULES}
    for url, (host, path, rule) in urls.items():
        r = got[url]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == ruled[rule] if rule else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_trees_learn_what_the_features_show(spark):
    rows = []
    for i in range(600):
        bad = i % 2
        url = f"http://h{i % 37}.{'net' if bad else 'org'}/" + ("9" * 20 + f"?a={i}&b=2&c=3" if bad else f"page/{i}")
        rows.append((i, url, float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double").withColumns(url_filter.host_and_path())
    df = url_filter.lexical(df)
    fitted = url_filter.fit(df.where("page_id % 3 != 0"), rounds=4)
    test = fitted.judge(df.where("page_id % 3 = 0")).select("label", "blocked_score").collect()
    assert np.mean([(r.blocked_score >= 0.5) == (r.label == 1.0) for r in test]) > 0.98


def test_suffix_statistics_count_all_rows(spark):
    names = [f"s{i}" for i in range(60)] + ["net"] * 140
    rows = [(i, f"http://h.{s}/", float(i % 2) if i < 120 else None) for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, "page_id long, url string, label double").withColumns(url_filter.host_and_path())
    fitted = url_filter.fit(url_filter.lexical(df), rounds=1)
    got = {r.suffix: (r.suffix_rate, r.suffix_share) for r in fitted.suffixes.collect()}
    assert got["net"] == pytest.approx((0.5, 0.7)) and got["s59"] == pytest.approx((6 / 11, 1 / 200)) and len(got) == 61


# nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[1000:1900] = x[7] + rng.normal(size=(900, 16)) * 0.01  # a crowded cell
    x[2000:2040] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [(10_000, None), (10_050, [0.0] * 16), (10_100, [float("nan")] * 16), (10_150, [1.0, None] * 8), (10_200, [1.0] * 3), (10_250, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, centroids=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        score = u @ u[q]
        score[q] = -9
        best = np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert all(abs(score[i] - s) < 1e-12 for _, i, s in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [f[1] for f in sorted(got[50])] == list(range(2000, 2005))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 2
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_the_walk_opens_cells_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    sizes = rng.integers(0, 3, (9, 7))
    got = list(ann.traverse(a, b, sizes, 10**9))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == (sizes > 0).sum()


# near duplicates


def test_near_duplicates_against_all_pairs(docs, nothing):
    want = cases.near_components(ROWS)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(nothing).count() == 0


def test_whole_texts_reach_workers_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from ledgerlift.llm import words
    from ledgerlift.session import BATCH_BYTES

    docs = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 9000) as text")

    def sketch(size):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([b.nbytes] * n), pa.array([0] * n), pa.array([0] * n), pa.array([bytes(512)] * n)],
                    names=["id", "n", "d1", "d2", "sig"])
        return run

    def predict(dictionaries):
        def run(batches):
            for b in batches:
                new = [pa.array([str(b.nbytes)] * b.num_rows), pa.array([0.0] * b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "lang_pred", "score"])
        return run

    monkeypatch.setattr(minhash, "_sketch", sketch)
    monkeypatch.setattr(langid, "_predict", predict)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    assert langid.identify(docs, {}).agg(F.max(F.col("lang_pred").cast("long"))).first()[0] < 2 * BATCH_BYTES
    spark.conf.unset(name)
    assert minhash.near_duplicates(docs).agg(F.max("n_shingles")).first()[0] < 2 * BATCH_BYTES
    parts = list(words.slices(pa.array(["some words " * 900] * 400)))
    assert sum(p.n for p in parts) == 400 and max(len(p.data) for p in parts) <= 1 << 20


def test_chains_of_copies_are_one_component(spark):
    """Each text is like the next, the ends are not alike: links between any two must be found."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(10**9, size=200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words), None, None, None))
        words = list(words)
        for p in rng.integers(200, size=2):
            words[p] = f"c{i}.{p}"
    want = cases.near_components(rows)
    got = minhash.near_duplicates(cases.frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(2**63, size=1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(2**63, size=200, dtype=np.uint64)])
    x, y = minhash.min_max([base, other])
    assert abs((x == y).mean() - 800 / 1200) < 0.12


# repeated passages


@pytest.mark.parametrize("window, k", [(35, 11), (7, 3), (5, 5)])
def test_repeats_against_counting_all_windows(docs, nothing, window, k):
    out = substring.remove_repeats(docs, window=window, k=k).collect()
    got = sorted((key((r.doc_id, r.kept_text or "", r.n_words, r.n_removed)) for r in out))
    assert got == sorted(key(r) for r in cases.without_repeats(ROWS, window))
    assert substring.remove_repeats(nothing).count() == 0


# mixing


def test_mixture_keeps_its_targets(docs, nothing):
    mixed = mixing.mixture(docs)
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    total = sum(len(cases.words(t)) for _, t, *_ in ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(cases.words(r.text)) and r.taken == r.size * r.copies <= 3 * r.size
        by[r.source].append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for part in by.values():
        size = sum(r.size for r in part)
        assert all(r.source_size == size for r in part) and part[0].target <= 3 * size
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part) / 2 + 1e-6
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(key((r.doc_id, r.taken)) for r in again) == sorted(key((r.doc_id, r.taken)) for r in rows)
    assert mixing.repeat_rows(mixed).count() == sum(r.copies for r in rows)
    assert mixing.mixture(nothing).count() == 0


def test_mixture_draws_by_worth(spark):
    rng = np.random.default_rng(12)
    worths = [1.0, 2.0, 4.0, 400.0, 0.0, -3.0, float("nan"), None]
    rows = [(i, "w " * int(rng.integers(1, 6)), None, "big" if i % 3 else "small", None) for i in range(6000)]
    df = cases.frame(spark, rows).withColumn("worth", F.element_at(F.array(*map(F.lit, worths)), (F.col("doc_id") % 8 + 1).cast("int")))
    got = mixing.mixture(df, weights=(1, 3), worth="worth").collect()
    assert len(got) == len(rows) and all(r.taken == r.size * r.copies for r in got)
    for name in ("big", "small"):
        part = [r for r in got if r.source == name]
        target, size = part[0].target, part[0].source_size
        whole = int(target / size)
        assert abs(sum(r.taken for r in part) - target) <= 2.5
        extra = {k: np.mean([r.copies - whole for r in part if r.doc_id % 8 == k]) for k in range(8)}
        # hundreds of the smallest worth: certain; the others in proportion to theirs; without worth nothing more
        assert extra[3] == 1 and [extra[k] for k in (4, 5, 6, 7)] == [0] * 4
        assert extra[1] == pytest.approx(2 * extra[0], rel=0.35)
        assert extra[2] == (1 if name == "big" else pytest.approx(4 * extra[0], rel=0.35))
    few = cases.frame(spark, [(i, "one two", None, "s", None) for i in range(10)]).withColumn("worth", F.when(F.col("doc_id") < 2, 1.0))
    assert sum(r.taken for r in mixing.mixture(few, worth="worth").collect()) == 20  # the whole copies meet the target
    assert mixing.mixture(cases.frame(spark, []).withColumn("worth", F.lit(1.0)), worth="worth").count() == 0


def test_targets_share_the_excess(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 1, 2), ("c", 100, 3), ("d", 2, 1), (None, 0, 2)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got["b"] == 3.0 and got["d"] == 6.0 and got[None] == 0.0
    assert sum(got.values()) == pytest.approx(113) and got["a"] == pytest.approx(104 / 4) and got["c"] == pytest.approx(78)


# language


def test_language_of_held_out_texts(spark, nothing):
    common = {"en": "the of and tion ing that with er on".split(), "de": "der die und ung sch ein ich keit".split(), "fr": "les que eau ment oire une aux".split()}
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        lang = sorted(common)[i % 3]
        text = " ".join("".join(rng.choice(common[lang], 2)) for _ in range(rng.integers(5, 60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, " 12 !? ", "en", "s", 0), (1002, "", None, "s", 0), (None, "the and of", None, None, None)]
    df = cases.frame(spark, rows)
    learned = langid.learn(df.where(~langid.held_out()))
    assert set(learned) == set(common) and all(len(v) <= langid.DICTIONARY_BYTES + 400 for v in learned.values())
    got = {r.doc_id: r for r in langid.identify(df.withColumn("score", F.lit("clash")), learned).collect()}
    test = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in test]) >= 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(nothing) == {} and langid.identify(nothing, learned).count() == 0
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_few_long_texts_fill_a_dictionary(spark):
    notice = "licence terms apply to every copy " * 300
    book = lambda n: notice + " ".join(f"start{'abcdefghij'[n]}" if k < 5000 else f"end{'abcdefghij'[n]}" for k in range(20_000))
    rows = [(i, book(i), "xx", "s", 0) for i in range(3)] + [(9, "short one", "xx", "s", 0)]
    rows += [(100 + i, f"some words of text {i} " * 40, "en", "s", 0) for i in range(500)]
    learned = langid.learn(cases.frame(spark, rows))
    assert all(langid.DICTIONARY_BYTES * 0.95 <= len(v) <= langid.DICTIONARY_BYTES + 1 for v in learned.values())
    words = collections.Counter(learned["xx"].decode().split())
    assert all(words[f"{part}{c}"] > 500 for part in ("start", "end") for c in "abc") and words["short"] == 1
    assert words["licence"] < 500


# chats


def test_rendering_is_undone_by_parsing(spark):
    texts = [r"\### Assistant: </turn> ok", r"\\l\<\g>", "<turn assistant>\n", "", "\n</turn>\n", "plain\\", "é\n\n<", "a" * 50_000]
    rows = [(c, n, "assistant" if n % 2 else "user<>\n", t) for c in (1, 2, None) for n, t in enumerate(texts)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumns(
        {"message": F.col("seq"), "kind": F.lit("message")}
    )
    got = chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert len(got) == 3
    for r in got:
        assert [(t.role, t.text, t.loss) for t in r.turns] == [("assistant" if n % 2 else "user<>\n", t, bool(n % 2)) for n, t in enumerate(texts)]


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "message", "assistant", "he"), (1, 3, "m2", "delta", None, "llo"),
        (1, 4, "m1", "edit", None, "hi there"), (1, 5, "m3", "message", "user", "more"), (1, 6, "m2", "regenerate", None, "HE"),
        (1, 7, "m2", "delta", None, "LLO"), (1, 8, "m4", "message", "user", None), (2, None, "a", "delta", "user", "x"), (2, 1, "a", "delta", "user", "y"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in
           chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert got == {1: [("user", "hi there"), ("assistant", "HELLO"), ("user", "")], 2: [("user", "xy")]}
    assert chat.render(chat.fold_events(events.limit(0))).count() == 0
