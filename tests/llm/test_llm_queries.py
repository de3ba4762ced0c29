"""The registered training-data queries over the smallest tables, against SQL or plain versions."""

import collections
import hashlib
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import llm_cases as cases
from ledgerlift.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
                         "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                    "sequence_id": "bigint", "offset": "bigint"},
    "op4_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_minhash_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
                             "loss_sha256": "string", "formatted_chars": "bigint"},
    "op11_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                            "positive_score": "bigint", "negative_score": "bigint"},
}


def read(sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.fixture(scope="module")
def out(spark):
    """Rows of a query, run once; its columns are the contract's."""
    done = {}

    def rows(name):
        if name not in done:
            df = queries.QUERIES[name](spark, SF)
            assert COLUMNS[name].items() <= dict(df.dtypes).items()
            done[name] = df.collect()
        return done[name]

    return rows


@pytest.fixture(scope="module")
def docs():
    return read("select doc_id, text, lang, source, n_chars from documents")


def test_every_query_has_a_contract():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(out, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in out(name)) == sorted(cur.fetchall())


def test_op1_places_every_document(out, docs):
    got = {r.doc_id: r for r in out("op1_sharding")}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        raw = text.encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    counts = collections.Counter(r.shard for r in got.values())
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in got.values()} == {(s, k) for s, n in counts.items() for k in range(n)}


def test_op2_tells_an_edit_from_another_document(out, docs):
    got = {r.doc_id: r for r in out("op2_fingerprints")}
    order = sorted(docs, reverse=True)
    for n, (i, text, *_) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.85


def test_op3_is_the_tokenizers_own_ids(out, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tk.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t, *_ in docs}
    seen = collections.Counter()
    for r in out("op3_packing"):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(v) for i, v in ids.items()}


def test_op4_follows_its_rules(out):
    ruled = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = out("op4_url_filter")
    assert len(rows) == read("select count(*) from pages")[0][0]
    assert all(r.verdict == ruled[r.rule] if r.rule else r.verdict in ("allow", "block") for r in rows)
    assert {r.rule for r in rows} >= set(ruled)


def test_op5_finds_the_nearest(out):
    table = dict(read("select vec_id, embedding from embeddings"))
    ids = np.array(sorted(table))
    u = np.array([table[i] for i in ids], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hits = total = 0
    found = collections.defaultdict(set)
    for r in out("op5_nearest"):
        found[r.query_id].add(r.vec_id)
    for n in np.flatnonzero(ids % 50 == 0):
        score = u @ u[n]
        score[n] = -9
        hits += len(found[ids[n]] & set(ids[np.lexsort((ids, -score))[:5]]))
        total += 5
    assert hits / total >= 0.9


def test_op6_finds_all_links(out, docs):
    want = cases.near_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out("op6_minhash_dedup")} == want


def test_op7_removes_all_repeats(out, docs):
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in cases.without_repeats(docs, 35)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out("op7_substring_dedup")} == want


def test_op9_is_right_on_held_out_documents(out, docs):
    lang = {i: code for i, _, code, *_ in docs}
    rows = [r for r in out("op9_language_id") if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.95
