import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import answers, chunking, clusters, fusion, lexical, scan, vectors, whole
from folioscope.settings import Settings
from folioscope.sources import store
from folioscope.sources.workspace import Tables
from tests.conftest import rows


def postings(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    p = lexical.build_postings(df)
    s = lexical.corpus_stats(lexical.passage_lengths(df)).first()
    return p, lexical.idf_table(p, s.n), s


def scores(spark, texts, query):
    p, w, s = postings(spark, texts)
    q = spark.createDataFrame([(1, query)], "qid long, question string")
    return {r.ord: r.keyword for r in lexical.keyword_scores(q, p, w, s.avg_len).collect()}


def bm25(texts, query):
    stop = set(__import__("folioscope.functions.textcols", fromlist=["x"]).STOPWORDS)
    import re
    toks = [[w for w in re.findall("[a-z0-9]+", t.lower()) if w not in stop] for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        total = 0.0
        for w in {w for w in re.findall("[a-z0-9]+", query.lower()) if w not in stop}:
            df, f = sum(w in x for x in toks), t.count(w)
            total += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if total:
            out[i] = round(total, 9)
    return out


TEXTS = ["model training data model", "model wordpiece of rare terms", "", "the of and", "wordpiece wordpiece wordpiece long long long text here"]


@pytest.mark.parametrize("query", ["wordpiece", "model model training", "nothing here", "the of"])
def test_bm25_matches_the_formula(spark, query):
    assert scores(spark, TEXTS, query) == pytest.approx(bm25(TEXTS, query))


def test_bm25_counts_empty_passages_and_empty_corpora(spark):
    _, _, s = postings(spark, TEXTS)
    assert s.n == 5
    empty = spark.createDataFrame([], "ord long, text string")
    s = lexical.corpus_stats(lexical.passage_lengths(empty)).first()
    assert (s.n, s.avg_len) == (0, 0.0)


def test_keyword_ties_keep_passage_order(spark):
    df = spark.createDataFrame([(1, 7, 2.0), (1, 3, 2.0), (1, 5, 3.0), (1, 9, 0.0)], "qid long, ord long, keyword double")
    assert [(r.ord, r["rank"]) for r in lexical.keyword_ranking(df).orderBy("rank").collect()] == [(5, 1), (3, 2), (7, 3)]


def test_hashed_words(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "the of")], "id long, text string")
    got = {r.id: dict(zip(r.slots, r.vals, strict=True)) for r in vectors.HashedWords(vectors.crc_slot).embed(df).collect()}
    a, b = zlib.crc32(b"alpha") % 384, zlib.crc32(b"beta") % 384
    assert got[1] == pytest.approx({a: 2 / math.sqrt(5), b: 1 / math.sqrt(5)}) and got[2] == {}


def test_rrf_adds_shares_and_ties_keep_dense_order(spark):
    rank = lambda ids: spark.createDataFrame([(1, o, k + 1) for k, o in enumerate(ids)], "qid long, ord long, rank int")
    fused = {r.ord: r.fused for r in fusion.rrf([rank([7, 8, 9]), rank([9, 7])]).collect()}
    assert fused == pytest.approx({7: 1 / 61 + 1 / 62, 9: 1 / 63 + 1 / 61, 8: 1 / 62}, abs=1e-11)
    tied = fusion.fused_order(fusion.rrf([rank([4, 2]), rank([2, 4])]), rank([4, 2]))
    assert [r.ord for r in tied.orderBy("rank").collect()] == [4, 2]


def test_one_per_page_never_loses_a_page(spark):
    r = random.Random(5)
    data = []
    for q in range(40):
        order = r.sample(range(40), 40)
        data += [(q, o, f"s{o % 3}", o % 7, k + 1) for k, o in enumerate(order)]
    df = spark.createDataFrame(data, "qid long, ord long, source string, page int, rank int")
    got = {}
    for x in fusion.one_per_page(df).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append((x.source, x.page))
    for q in range(40):
        plain = [(s, p) for i, _, s, p, _ in data if i == q]
        assert got[q] == list(dict.fromkeys(plain))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(120)]
    texts = [(f"d{o // 12}.pdf", 1 + o // 4 % 3, o % 4, " ".join(r.choices(vocabulary, k=r.randrange(20, 60)))) for o in range(240)]
    chunks = spark.createDataFrame([(f"{s}::p{p}::c{i}", s[:-4], s, p, i, t) for s, p, i, t in texts], "chunk_id string, doc_id string, source string, page int, i int, text string")
    path = f"file://{tmp_path_factory.mktemp('index')}"
    stats = store.build(chunks, path)
    assert stats == {"pdfs": 20, "chunks": 240, "dim": 384, "skipped": []}
    questions = [(q, " ".join(r.choices(vocabulary, k=4))) for q in range(1, 7)] + [(7, texts[100][3]), (8, "unknown words only")]
    return store.load(spark, path), questions, path


def brute(index, questions, k, mode, distinct):
    import re

    from hashlib import md5

    chunks = sorted(index.chunks.collect(), key=lambda c: c.ord)

    def vec(t):
        v = np.zeros(384)
        for w in re.findall("[a-z0-9]+", t.lower()):
            v[int(md5(w.encode()).hexdigest()[:8], 16) % 384] += 1
        return v / max(np.linalg.norm(v), 1e-12)

    m = np.array([vec(c.text) for c in chunks])
    out = {}
    for q, text in questions:
        cos = np.round(m @ vec(text), 9)
        dense = sorted(range(len(chunks)), key=lambda o: (-cos[o], o))
        order = dense
        if mode == "hybrid":
            words = bm25([c.text for c in chunks], text)
            keyword = sorted(words, key=lambda o: (-words[o], o))
            fused = {o: 1 / (61 + k) for k, o in enumerate(dense)}
            for k2, o in enumerate(keyword):
                fused[o] += 1 / (61 + k2)
            order = sorted(dense, key=lambda o: -round(fused[o], 12))
        if distinct:
            first = {}
            for o in order:
                first.setdefault((chunks[o].source, chunks[o].page), o)
            order = list(first.values())
        out[q] = [chunks[o].chunk_id for o in order[:k]]
    return out


@pytest.mark.parametrize(("mode", "distinct"), [("dense", False), ("dense", True), ("hybrid", False), ("hybrid", True)])
def test_top_k_is_that_of_full_rankings(spark, corpus, mode, distinct):
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    got = fusion.retrieve(asked, index, Settings(top_k=5), mode=mode, distinct_pages=distinct).collect()
    assert {r.qid: [h.chunk_id for h in r.hits] for r in got} == brute(index, questions, 5, mode, distinct)


def test_guard_is_the_same_in_every_mode_and_blank_questions_abstain(spark, corpus):
    index, questions, _ = corpus
    asked = spark.createDataFrame([*questions, (9, " \n ")], "qid long, question string")
    a = rows(fusion.retrieve(asked, index, mode="dense"), "qid", "top_score", "abstain")
    assert a == rows(fusion.retrieve(asked, index, mode="hybrid", distinct_pages=False), "qid", "top_score", "abstain")
    by = {q: (t, x) for q, t, x in a}
    assert by[9] == (0.0, True) and by[7] == (pytest.approx(1.0), False) and by[8] == (0.0, True)
    blank = fusion.retrieve(asked.where("qid = 9"), index, Settings(sim_threshold=-1.0)).first()
    assert blank.abstain and blank.hits == []


def test_more_hits_than_passages_and_unknown_modes(spark, corpus):
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions[:1], "qid long, question string")
    assert len(fusion.retrieve(asked, index, Settings(top_k=500), distinct_pages=False).first().hits) == 240
    with pytest.raises(ValueError, match="unknown retrieval mode"):
        fusion.retrieve(asked, index, mode="magic")


def test_missing_and_unmatched_indexes(spark, corpus, tmp_path):
    index, _, path = corpus
    with pytest.raises(store.NotBuilt):
        store.load(spark, f"file://{tmp_path}/none")
    assert rows(store.health(spark, f"file://{tmp_path}/none")) == [("index_missing", 0, "extractive", 0.5)]
    assert rows(store.health(spark, path)) == [("ok", 240, "extractive", 0.5)]
    assert rows(store.unmatched(index.chunks.where("ord <> 4"), index.vectors.where("ord <> 9"))) == [(4, "vectors"), (9, "chunks")]
    for t in store.TABLES:
        spark.read.parquet(f"{path}/{t}").write.parquet(f"file://{tmp_path}/bad/{t}") if t != "vectors" else index.vectors.where("ord > 3").write.parquet(f"file://{tmp_path}/bad/{t}")
    with pytest.raises(store.OutOfSync):
        store.load(spark, f"file://{tmp_path}/bad")
    with pytest.raises(store.NothingChunked):
        store.build(index.chunks.withColumn("i", F.lit(0)).drop("ord").where("false"), f"file://{tmp_path}/none")


def test_skipped_documents_are_told(spark, corpus, tmp_path):
    index, _, _ = corpus
    docs = spark.createDataFrame([("d0.pdf",), ("blank.pdf",)], "source string")
    chunks = index.chunks.where("source = 'd0.pdf'").withColumn("i", F.col("ord").cast("int")).drop("ord")
    assert store.build(chunks, f"file://{tmp_path}/s", documents=docs)["skipped"] == ["blank.pdf"]
    assert chunking.skipped(docs, chunks).count() == 1
    store.export_jsonl(store.load(spark, f"file://{tmp_path}/s").chunks, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == chunks.count()


def test_answers(spark, corpus):
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    got = {r.qid: r for r in answers.answer(fusion.retrieve(asked, index)).collect()}
    assert got[8].abstained and got[8].citations == [] and "0.000" in got[8].answer and "0.500" in got[8].answer
    assert not got[7].abstained and got[7].citations[0].n == 1 and got[7].citations[0].score == 1.0
    assert got[7].answer.startswith(answers.EXTRACTIVE_HEADER + "[1] d8.pdf p.")


def test_streamed_questions(spark, corpus, tmp_path):
    from folioscope.streaming.ask_stream import answer_stream

    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    asked.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"file://{tmp_path}/in")
    answer_stream(stream, index, f"file://{tmp_path}/ck", f"file://{tmp_path}/out").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert rows(got, "qid", "answer") == rows(answers.answer(fusion.retrieve(asked, index)), "qid", "answer")


def test_model_vectors_load_in_the_worker(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    got = {r.id: r.vals for r in vectors.ModelVectors(load, dim=2).embed(df).collect()}
    assert got[1] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)]) and got[2] == [0.0, 1.0]


def test_whole_rankings_have_every_passage(spark, corpus):
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    ranked = fusion.whole_ranking(asked, index, Tables(spark, "whole"))
    chunks = {c.ord: c for c in index.chunks.collect()}
    n = len(chunks)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.qid, {})[r["rank"]] = chunks[r.ord].chunk_id
    assert {q: [own[k] for k in range(1, n + 1)] for q, own in got.items()} == brute(index, questions, n, "hybrid", False)
    paged = fusion.whole_pages(ranked.join(index.chunks.select("ord", "source", "page"), "ord"), Tables(spark, "pages"))
    got = {}
    for r in paged.collect():
        got.setdefault(r.qid, {})[r["rank"]] = chunks[r.ord].chunk_id
    assert {q: [own[k] for k in range(1, len(own) + 1)] for q, own in got.items()} == brute(index, questions, n, "hybrid", True)
    assert fusion.whole_ranking(asked.where("false"), index, Tables(spark, "whole")).count() == 0


def test_ranks_by_range_partitions(spark, monkeypatch):
    """One question with nearly all rows, cut over many partitions; others with few."""
    r = random.Random(4)
    data = [(1, r.random(), k) for k in range(20_000)] + [(q, float(k % 2), k) for q in range(2, 9) for k in range(q)]
    own = spark.createDataFrame(data, "qid long, s double, ord long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = Tables(spark, "placed")
        got = {(x.qid, x.ord): x["rank"] for x in scan.placed(own, [F.desc("s"), F.col("ord")], tables, "t").collect()}
        assert spark.read.parquet(tables.path("t")).select(F.shiftright("_m", 33)).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for q in range(1, 9):
        for k, (_, _, o) in enumerate(sorted((x for x in data if x[0] == q), key=lambda x: (-x[1], x[2])), 1):
            want[q, o] = k
    assert got == want


def test_deep_ranks_are_counted_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(scan, "TARGETS", 5)
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    got = fusion.retrieve(asked, index, Settings(top_k=5)).collect()
    assert {r.qid: [h.chunk_id for h in r.hits] for r in got} == brute(index, questions, 5, "hybrid", True)


def test_keyword_products_of_hits():
    r = np.random.default_rng(2)
    weights = r.random((40, 7)) * (r.random((40, 7)) < 0.3)
    table = r.random((11, 40)) * (r.random((11, 40)) < 0.4)
    table[3] = 0
    used = [np.flatnonzero(weights[w]) for w in range(40)]
    idf = r.random(40)
    asked = scan.Asked(list(range(7)), np.zeros((7, 1)), [str(w) for w in range(40)], np.cumsum([0, *map(len, used)]), np.concatenate(used), idf, 1.0)
    row, word = np.nonzero(table)
    got = asked.keyword(word, row, table[row, word], 11)
    assert np.allclose(got, table @ ((weights > 0) * idf[:, None]))


def test_bounds_skip_blocks_and_lose_nothing(spark, monkeypatch):
    """Passages of topics that follow each other: the first rows are exact for every depth, and most blocks are skipped."""
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("anto", "erit", "olus", "umen")]
    texts = [" ".join(r.choices(vocabulary[(k // 100) % 14 * 4 : (k // 100) % 14 * 4 + 4], k=r.randrange(3, 30)) + r.choices(vocabulary, k=r.randrange(3))) for k in range(1400)] + ["", "12 of the"]
    p, w, s = postings(spark, texts)
    asked = spark.createDataFrame([(1, "banto berit bolus"), (2, "canto sumen"), (3, "nowhere"), (4, ""), (5, "banto banto tumen kerit"), (6, " ".join(vocabulary))], "qid long, question string")
    blocks = lexical.block_table(p, s.avg_len, 16)
    for depth in (1, 5, 2000):
        want = lexical.keyword_ranking(lexical.keyword_scores(asked, p, w, s.avg_len), depth)
        got, read = lexical.pruned_topk(asked, blocks, w, depth, Tables(spark, "pruned"))
        assert rows(got, "qid", "ord", "keyword", "rank") == rows(want, "qid", "ord", "keyword", "rank") != []
        shares = {x.qid: x.read / x.blocks for x in read.collect()}
        assert set(shares) == {1, 2, 5, 6} and (max(shares[1], shares[2]) < 0.3 if depth < 2000 else set(shares.values()) == {1.0})


@pytest.mark.parametrize("spread", [0.03, 3.0])
def test_clusters_are_skipped_and_lose_nothing(spark, spread):
    """Vectors around twelve centres, repeated and zero vectors: the first ranks are exact whatever is skipped."""
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 24))[r.integers(0, 12, 3000)] + spread * r.normal(size=(3000, 24))
    x[5], x[6:9] = 0, x[9]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    data = [(k, [int(i) for i in np.flatnonzero(v)], [float(c) for c in v[v != 0]]) for k, v in enumerate(x)]
    own = spark.createDataFrame(data, "ord long, slots array<int>, vals array<double>").repartition(5)
    tables = Tables(spark, "clusters")
    known = clusters.build(own, 24, tables)
    asked = [0, 5, 9, 700, 2999]
    for depth in (1, 10, 4000):
        found, read = clusters.search(known, asked, x[asked], depth, tables, f"d{depth}")
        got = {}
        for row in vectors.dense_ranking(found, depth).collect():
            got.setdefault(row.qid, {})[row["rank"]] = row.ord
        for q in asked:
            cos = np.round(x @ x[q], 9) + 0.0
            assert [got[q][k] for k in range(1, len(got[q]) + 1)] == sorted(range(3000), key=lambda o: (-cos[o], o))[:depth]
        if spread < 1 and depth < 100:
            assert read[[0, 2, 3, 4]].mean() < 0.6
    none = clusters.build(own.where("false"), 24, tables, "none")
    assert clusters.search(none, asked, x[asked], 3, tables, "none-found")[0].count() == 0


def test_keyword_top_k_comes_from_scans_not_from_pairs(spark, corpus, monkeypatch, tmp_path):
    index, questions, _ = corpus
    asked = spark.createDataFrame(questions, "qid long, question string")
    want = lexical.keyword_ranking(lexical.keyword_scores(asked, index.postings, index.words, index.avg_len), 7)
    got = scan.keyword_first(asked, index.passages, index.words, index.avg_len, 7, Tables(spark, "test"), size=3)
    assert {(r.qid, r.ord, r["rank"]): r.keyword for r in got.collect()} == pytest.approx({(r.qid, r.ord, r["rank"]): r.keyword for r in want.collect()})
    assert scan.keyword_first(asked.where("false"), index.passages, index.words, index.avg_len, 7, Tables(spark, "test")).collect() == []

    def pairs(*_):
        raise AssertionError("pairs of questions and passages")

    from folioscope.plans import catalogue
    monkeypatch.setattr(lexical, "keyword_scores", pairs)
    assert catalogue.keyword_topk(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("slot", [vectors.md5_slot, vectors.crc_slot, lambda w, dim: (F.length(w) % dim).cast("int")])
def test_passages_in_batches_equal_those_by_expressions(spark, slot):
    texts = ["Alpha beta ALPHA the of", "", "the of", "K2 İstanbul ẞ x" + "1" * 40, "ünï c0de b a c b", " ".join(f"w{k % 700}" for k in range(3000)), None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    tokens = chunks.select("ord", F.coalesce(vectors.T.tokenize("text"), F.array().cast("array<string>")).alias("t"))
    want = vectors.HashedWords(slot).from_tokens(lexical.counted(tokens.withColumn("len", F.size("t").cast("long")), "t", "words", "tfs"), "t")
    names = ["ord", "len", "words", "tfs", "slots", "vals"]
    assert rows(vectors.HashedWords(slot).passages(chunks), *names) == rows(want, *names)


def test_index_is_written_once_and_ranges_are_kept(spark, corpus, tmp_path):
    index, _, path = corpus
    given = index.chunks.withColumn("i", (F.col("ord") % 4).cast("int")).drop("ord").repartitionByRange(5, "source")
    store.build(given, f"file://{tmp_path}/r", ranged=True)
    assert rows(store.load(spark, f"file://{tmp_path}/r").chunks, "ord", "chunk_id", "text") == rows(index.chunks, "ord", "chunk_id", "text")
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == sorted(store.TABLES)  # no second copy of texts, no postings


def test_chunks_are_made_with_one_exchange(spark):
    from folioscope.plans import catalogue
    plan = catalogue.chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString() + catalogue.chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") >= 1 and "Exchange hashpartitioning" not in plan


def test_whole_rankings_keep_one_table_of_pairs(spark, corpus):
    index, questions, _ = corpus
    tables = Tables(spark, "whole")
    found = fusion.whole_ranking(spark.createDataFrame(questions, "qid long, question string"), index, tables)
    assert not any(tables.has(t) for t in ("scores", "by-cosine", "by-keyword")) and tables.has("by-fused")
    assert "keyword" not in found.columns and found.count() == 8 * 240


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Pages of one to five chunks, most of them copies: very many ties of either score."""
    r = random.Random(8)
    kinds = ["alpha beta gamma", "beta delta", "none of them here", "alpha alpha omega"]
    rows_ = [(f"d{p // 7}.pdf", 1 + p % 7, i, r.choice(kinds) if r.random() < 0.9 else f"alpha w{p} x{i} beta") for p in range(90) for i in range(1 + p % 5)]
    chunks = spark.createDataFrame([(f"{s}::p{p}::c{i}", s[:-4], s, p, i, t) for s, p, i, t in rows_], "chunk_id string, doc_id string, source string, page int, i int, text string")
    path = f"file://{tmp_path_factory.mktemp('tied')}"
    store.build(chunks, path)
    return store.load(spark, path), [(3, "alpha beta"), (1, "delta delta"), (2, "unknown"), (9, "omega here w12")]


def test_whole_ranking_in_many_buckets_stores_pieces(spark, tied, monkeypatch):
    """A row for each pair was written and exchanged for each of three rankings."""
    index, questions = tied
    monkeypatch.setattr(whole, "BUCKET", 32)
    tables = Tables(spark, "whole")
    got = {}
    for x in fusion.whole_ranking(spark.createDataFrame(questions, "qid long, question string"), index, tables).collect():
        got.setdefault(x.qid, {})[x["rank"]] = x.ord
    names = {c.ord: c.chunk_id for c in index.chunks.collect()}
    assert {q: [names[own[k]] for k in range(1, index.n + 1)] for q, own in got.items()} == brute(index, questions, index.n, "hybrid", False)
    pieces = spark.read.parquet(tables.path("by-fused"))
    assert pieces.agg(F.sum("n")).first()[0] == 4 * index.n > 4 * pieces.count() and pieces.select("bucket").distinct().count() > 3


def test_whole_page_ranking_in_many_slices_joins_no_pairs(spark, tied, monkeypatch):
    """Pairs were joined with pages, grouped by page, joined with that and ranked again."""
    index, questions = tied
    monkeypatch.setattr(whole, "BUCKET", 32)
    monkeypatch.setattr(whole, "SLICE", 20)
    tables = Tables(spark, "whole")
    found = fusion.whole_page_ranking(spark.createDataFrame(questions, "qid long, question string"), index, tables)
    got, chunks = {}, {c.ord: c for c in index.chunks.collect()}
    for x in found.collect():
        assert (x.source, x.page) == (chunks[x.ord].source, chunks[x.ord].page)
        got.setdefault(x.qid, {})[x["rank"]] = chunks[x.ord].chunk_id
    assert {q: [own[k] for k in range(1, len(own) + 1)] for q, own in got.items()} == brute(index, questions, index.n, "hybrid", True)
    assert spark.read.parquet(tables.path("names")).count() > 5 and spark.read.parquet(tables.path("by-fused")).agg(F.sum("n")).first()[0] == 4 * 90
    empty = spark.createDataFrame([], "qid long, question string")
    assert fusion.whole_page_ranking(empty, index, Tables(spark, "whole")).count() == 0


def test_all_keyword_scores_come_without_an_exchange(spark, corpus, tied):
    from folioscope.plans import catalogue
    for index, questions in (corpus[:2], tied):
        asked = spark.createDataFrame(questions, "qid long, question string")
        want = {(x.qid, x.ord): x.keyword for x in lexical.keyword_scores(asked, index.postings, index.words, index.avg_len).collect()}
        for size in (3, 1000):
            got = scan.keyword_pairs(asked, index.passages, index.words, index.avg_len, size).collect()
            assert len(got) == len(want) > 0 and {(x.qid, x.ord): x.keyword for x in got} == pytest.approx(want)
        assert scan.keyword_pairs(asked.where("false"), index.passages, index.words, index.avg_len).count() == 0
    # A word of every passage can weigh so little that it rounds to nothing: its pairs stay.
    light = index.words.withColumn("idf", F.lit(1e-12))
    assert scan.keyword_pairs(asked, index.passages, light, index.avg_len).count() == len(want)
    plan = catalogue.bm25_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_pieces_and_shares_are_exact():
    r = np.random.RandomState(2)
    for n in (1, 2, 1000):
        columns = np.sort(r.randint(-(2**40), 2**40, n)), r.randint(0, 300, n), np.zeros(n, np.int64), -r.randint(0, 2**55, n)
        assert all((a == b).all() for a, b in zip(columns, whole.unpack(whole.pack(*columns), n), strict=True))
    assert whole.fused_key(np.array([8132, 1]), None, 60).tolist() == [-122070313, -16393442623]  # 1 / 8192 lies half way
    first, second = np.array([1, 2, 2, 2, 5]), np.array([7, 0, 4, 9, 1])
    assert whole.cuts(first, second, ([2, 2, 4], [4, 5, 0])) == [0, 2, 3, 4, 5]


def test_ranks_are_counted_with_ties(spark):
    r = np.random.RandomState(3)
    for _ in range(60):
        n, m = r.randint(1, 50), r.randint(1, 40)
        scores, ords = r.randint(0, 6, n) / 3.0, np.sort(r.choice(900, n, replace=False))
        own = sorted(zip((r.randint(0, 8, m) / 3.0).tolist(), r.randint(0, 900, m).tolist(), strict=True))
        want = [sum(x > a or (x == a and y < b) for x, y in zip(scores, ords, strict=True)) for a, b in own]
        assert scan.before(scores, ords, np.array([a for a, _ in own]), np.array([b for _, b in own])).tolist() == want
    # All of a block and all targets of one score: each of them was compared with the whole block when ties were counted one by one.
    ords, keys = np.arange(4096), np.zeros(4000)
    start = time.perf_counter()
    for _ in range(200):
        got = scan.before(np.zeros(4096), ords, keys, np.arange(4000))
    assert got.tolist() == list(range(4000)) and time.perf_counter() - start < 3


def test_blocks_are_made_without_an_exchange(spark):
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("anto", "erit", "olus")]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(3)
    p, w, s = postings(spark, texts)
    blocks = lexical.passage_blocks(lexical.passage_terms(df).cache(), s.avg_len, 16)
    plan = lexical.passage_blocks(lexical.passage_terms(df.select("ord", "text").coalesce(1)), s.avg_len, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the test's own repartition
    asked = spark.createDataFrame([(1, "banto berit bolus"), (2, "canto nowhere"), (3, "")], "qid long, question string")
    unfold = lambda b: rows(b.selectExpr("word", "block", "explode(items) AS x").selectExpr("word", "block", "x.ord", "round(x.part, 9)"))
    assert unfold(blocks) == unfold(lexical.block_table(p, s.avg_len, 16)) != []
    for depth in (1, 5, 2000):
        got, _ = lexical.pruned_topk(asked, blocks, w, depth, Tables(spark, "pruned"))
        assert rows(got, "qid", "ord", "keyword", "rank") == rows(lexical.keyword_ranking(lexical.keyword_scores(asked, p, w, s.avg_len), depth), "qid", "ord", "keyword", "rank") != []


def test_only_unsettled_questions_are_ranked_as_deep_as_the_longest_page(spark, corpus, monkeypatch, tmp_path):
    """One page has 90 passages that all suit the first question; the others meet five pages at once."""
    _, questions, _ = corpus
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(120)]
    texts = [("a.pdf", 1, k, " ".join(["alpha", "beta", *r.choices(vocabulary, k=r.randrange(6))])) for k in range(90)]
    texts += [(f"d{k}.pdf", 1 + k % 2, 0, " ".join(r.choices(vocabulary, k=20) + ["alpha"] * (k % 3 == 0))) for k in range(150)]
    chunks = spark.createDataFrame([(f"{s}::p{p}::c{i}", s[:-4], s, p, i, t) for s, p, i, t in texts], "chunk_id string, doc_id string, source string, page int, i int, text string")
    store.build(chunks, f"file://{tmp_path}/long")
    index = store.load(spark, f"file://{tmp_path}/long")
    asked = [(1, "alpha beta"), *((q + 10, t) for q, t in questions[:4])]
    monkeypatch.setattr(fusion, "NEAR", 1)
    made, plain = [], fusion.rankings

    def noted(questions, index, depth, *rest):
        made.append((depth, sorted(x.qid for x in questions.collect())))
        return plain(questions, index, depth, *rest)

    monkeypatch.setattr(fusion, "rankings", noted)
    for mode in ("hybrid", "dense"):
        got = fusion.retrieve(spark.createDataFrame(asked, "qid long, question string"), index, mode=mode).collect()
        assert {x.qid: [h.chunk_id for h in x.hits] for x in got} == brute(index, asked, 5, mode, True)
        (near, every), (deep, few) = made
        assert near < 90 < deep == fusion.depth_for(5, True, index.page_chunks) and every == [q for q, _ in asked] and 1 in few and len(few) < len(every)
        made.clear()


def test_scans_have_a_number_of_tasks_that_does_not_grow(spark, corpus):
    index, _, _ = corpus
    cores = spark.sparkContext.defaultParallelism
    asked = scan.Asked([1], np.zeros((1, 384)), [], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), 1.0)
    many = index.passages.repartition(20 * cores)
    assert scan.best(many, asked, 3, True).rdd.getNumPartitions() == scan.SCANS * cores
    assert scan.best(many, asked, 3, True).count() <= 3 * scan.SCANS * cores


def test_evaluation_takes_its_places_from_the_rankings_and_an_index_is_loaded_once(spark, monkeypatch):
    from folioscope.plans import catalogue

    data = "/root/testdata/sf0.001"
    want = rows(catalogue.evaluation(spark, data, catalogue.index(spark, data)))

    def again(*_, **__):
        raise AssertionError("made before")

    monkeypatch.setattr(scan, "keyword_first", again)
    monkeypatch.setattr(store, "load", again)
    ix = catalogue.index(spark, data)
    assert rows(catalogue.evaluation(spark, data, ix, catalogue.ranked(spark, data, ix)[1])) == want != []
    assert catalogue.eval_misses(spark, data).count() > 0 and catalogue.llm_metrics(spark, data).count() == 1


def test_words_of_a_batch_are_those_of_each_text(spark):
    import pyarrow as pa

    r = random.Random(5)
    signs = list("abcxyz019 ABZ \n\t_-é İKſß٣中'\0\x01") + [" the ", " of"]
    texts = [None, "", "the of", "é", *("".join(r.choices(signs, k=r.randrange(40))) for _ in range(500))]
    want = [[w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in lexical.T.STOPWORDS] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["ord", "text"])
    for at, n in ((0, 504), (3, 100), (0, 0), (1, 1)):
        (got,) = lexical.term_batches([batch.slice(at, n)])
        own = [{"ord": at + k, "len": len(ws), "words": sorted(set(ws)), "tfs": [ws.count(w) for w in sorted(set(ws))]} for k, ws in enumerate(want[at : at + n])]
        assert got.to_pylist() == own
