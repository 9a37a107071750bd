"""Each stage of the pipeline on its own input against brute force, and the whole."""

import pytest

import corpus_pipeline as cp
from .brute import word_set

from .test_texts import brute_repeats, check_packing, odd_documents, whole


@pytest.fixture(scope="module")
def folder(spark, sf_dir):
    from vellum.llm.common import Scratch

    return Scratch(spark), sf_dir


def stage(spark, folder, name, docs):
    scratch, sf_dir = folder
    return scratch.write(dict(cp.STAGES)[name](spark, docs, sf_dir), name)


def test_stages(spark, folder, components):
    sf_dir = folder[1]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = stage(spark, folder, "quality", docs)
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns
    judged = {r["doc_id"] for r in docs.select("doc_id").collect()} & labels.keys()
    assert sum((d in kept) == (labels[d] > 0) for d in judged) >= 0.95 * len(judged)

    one = stage(spark, folder, "near_dedup", good)
    sets = {r["doc_id"]: word_set(r["text"] or "", 5) for r in good.collect()}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    comp = components(ids, edges)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [d for d in ids if comp[d] == d]

    cut = stage(spark, folder, "repeats", one)
    want = {x[0]: x for x in brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in one.collect()], 50)}
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and rows.keys() == want.keys()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for d, (_, n, removed, _, _) in want.items():
        assert 0 <= n - removed - len(rows[d]["text"].encode()) <= 3 * 2 * (removed // 50 + 1) and rows[d]["n_chars"] == len(rows[d]["text"])
        assert removed or rows[d]["text"] == before[d]

    mixed = stage(spark, folder, "mixture", cut)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, cut.collect()))

    packed = stage(spark, folder, "packing", mixed).collect()
    total = sum(len(whole(r["text"])) // 4 + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed) == total and check_packing(packed, 2048) <= -(-total // 2048) * 1.02 + 1


def test_odd_documents_go_through(spark, folder):
    docs = odd_documents(spark)
    for name, _ in cp.STAGES:
        out = stage(spark, folder, name, docs)
        assert name == "packing" or out.columns == docs.columns
        docs = out if name != "packing" else docs
    assert stage(spark, folder, "packing", docs.limit(0)).count() == 0


def test_one_row_of_a_repeated_id_stays(spark, folder):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, "another text with words of its own"), (3, "and a third one of that same id"), (None, text), (None, text), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, folder, "near_dedup", docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 3), (False, 5), (True, 0), (True, 0)]
    assert all(tuple(r)[:2] in rows for r in got)


def test_the_mixture_orders_the_sequences(spark, folder, monkeypatch):
    words, n, top = [f"w{i}" for i in range(97)], 900, folder[0].path("sourced")
    rows = [(i, " ".join(words[(i * j) % 97] for j in range(60 + i * 7 % 90)), "en", f"src{i % 2}", 0) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    runs, real = [], cp.mix
    for weights in ({"src0": 4, "src1": 1}, {"src0": 1, "src1": 4}):
        monkeypatch.setattr(cp, "mix", lambda scratch, docs, w=weights, **_: real(scratch, docs, weights=w, block_chars=2000))
        monkeypatch.setattr(cp, "STAGES", [("mixture", cp.mixture), ("packing", lambda *a: cp.packing(*a, window_tokens=20_000))])
        packed = cp.run(spark, top).collect()
        total = sum(r["length"] for r in packed)
        assert len(packed) == n and {r["sequence_id"] for r in packed} == set(range(check_packing(packed, 2048)))
        early = [r for r in packed if r["sequence_id"] < 0.4 * total / 2048]
        share = sum(r["length"] for r in early if r["doc_id"] % 2 == 0) / sum(r["length"] for r in early)
        assert abs(share - weights["src0"] / 5) < 0.1
        runs.append(sorted(map(tuple, packed)))
    assert runs[0] != runs[1]
