"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import json
import math
import time
import zlib
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doorstep.llm import bpe, chat, components, fixity, hnsw, jaccard, lines, maxent, mixing, rules, toxicity, words
from doorstep.llm.queries import vocabulary_path
from doorstep.llm.store import ready, stored, table
from tests.llm.test_queries import plain_components

DOCS = "doc_id long, text string, lang string, source string, n_chars int, row string, copy int, failed string"
LONG = " ".join(f"w{k % 700}" for k in range(30_000))
ROWS = [
    (1, "Shared line\nown one", "en", "a", 1, "x", 1, "f"),
    (2, " shared LINE\t\nown two", None, "a", None, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "x", 1, "f"),
    (None, "shared line", "en", "b", 3, "x", 1, "f"),
    (5, LONG, "en", "b", 3, "x", 1, "f"),
    (5, LONG, "en", "b", 3, "x", 1, "f"),
    (6, LONG + " tail", "en", "b", 3, "x", 1, "f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return spark.createDataFrame(ROWS, DOCS)


def test_lines(docs):
    got = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs, least=3).collect()}
    assert got == {
        (1, "own one", 2, 1), (2, "own two", 2, 1), (3, "", 1, 0), (4, "", 1, 0), (None, "", 1, 1),
        (5, LONG, 1, 0), (6, LONG + " tail", 1, 0),
    }
    assert lines.without_shared_lines(docs.limit(0)).count() == 0


def test_lines_of_long_texts_cost_no_more_each(spark):
    ready(spark)

    def seconds(n):
        texts = [(k, "\n".join(f"line {i}" for i in range(n)) + f"\nown {k}") for k in range(12)]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        began = time.perf_counter()
        got = lines.dedup_lines(df, least=10).collect()
        assert {(r.doc_id, r.kept_text, r.n_dropped) for r in got} == {(k, f"own {k}", n) for k in range(12)}
        return time.perf_counter() - began

    seconds(100)
    few, many = seconds(3000), seconds(24000)
    assert many < 16 * few


def test_is_in(spark):
    df = spark.createDataFrame([([1, 3, 5, 9], v) for v in range(11)] + [([], 1), ([4], 4)], "s array<int>, v int")
    assert [r[0] for r in df.select(lines.is_in(F.col("v"), F.col("s"))).collect()] == [
        v in (1, 3, 5, 9) for v in range(11)
    ] + [False, True]


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    sizes, bits, slot = lines.build_mph(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (lines.find_slots(keys, sizes, bits) == slot).all()
    assert lines.build_mph(np.zeros(0, np.uint64))[0] == []


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs, 5, 4, 5)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, len(r.text or "")) for r in kept.select("doc_id", "text").collect())
    assert got == sorted([(1, 19), (2, 21), (3, 0), (4, 0), (0, 11), (5, len(LONG))])
    assert jaccard.similar_texts(docs.limit(0)).count() == 0


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300):
        a, b = rng.integers(-n, n, 2 * n), rng.integers(-n, n, 2 * n)
        top = {int(v): int(v) for v in (*a, *b)}

        def root(v):
            while top[v] != v:
                v = top[v]
            return v

        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = root(x), root(y)
            top[max(rx, ry)] = min(rx, ry)
        node, to = components.forest(a, b)
        assert dict(zip(node.tolist(), to.tolist())) == {v: root(v) for v in top if root(v) != v}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(2, 1), (3, 1), (7, 6), (8, 6), (9, 6)}


def test_encode_and_decode(docs):
    rows = bpe.encode(docs, vocabulary_path())
    back = bpe.decode(rows, vocabulary_path())
    assert back.where("coalesce(text, '') <> decoded").count() == 0
    assert back.where("doc_id in (3, 4) AND size(ids) = 0").count() == 2


@pytest.mark.parametrize("width", range(1, 7))
def test_short_runs(spark, width):
    ready(spark)
    texts = ["", None, "hello world", "a", "a b c", "a b c d", "A b  c d", " ", "a b c d e", "a b c d e f", "a b c d e f g", "hello world"]
    want = plain_components([(k, t) for k, t in enumerate(texts)], width, 4, 5)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, len(texts)):
        got = {tuple(r) for r in jaccard.similar_texts(df.repartition(parts), width).select("doc_id", "n_shingles", "component_id").collect()}
        assert got == want


def test_short_text_after_a_very_long_one(spark):
    ready(spark)
    long = " ".join(f"w{k}" for k in range(700_000))
    df = spark.createDataFrame([(1, long), (2, "hello world"), (3, "hello world"), (4, long + " x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_texts(df.coalesce(1), 4, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}
    assert hash_runs(["hello world"], 4) == hash_runs(["hello world", "x"], 4)[:1]


def hash_runs(texts, width):
    hashes, edge = words.shingle_hashes(words.split_words(pa.array(texts)), width)
    return [hashes[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]


def test_names_of_the_caller(docs):
    names = ["steps", "_pool", "_u", "rate", "u", "key", "_drop", "_doc", "_hash", "_own", "own_id", "_words", "_lines", "words", "row"]
    more = docs.withColumns({n: F.lit(n) for n in names})
    for out in (
        mixing.mix(more, {"a": 0.5}), jaccard.one_of_each(more), rules.ledger(more), lines.dedup_lines(more, least=3),
    ):
        assert set(more.columns) - {"failed"} <= set(out.columns)
        row = out.select(*[F.col(f"`{n}`") for n in names]).first()
        assert row is None or list(row) == names


def test_rules(docs):
    rows = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert (rows[3].n_words, rows[3].n_repeat_words, rows[3].n_lines) == (0, 0, 0)
    assert rows[5].n_repeat_words == 30_000 and rows[1].failed & 1
    assert rules.ablations(rules.ledger(docs.limit(0))).count() == 0


def test_ablations_against_plain_counts(spark):
    rows = stored(rules.ledger(table(spark, "/root/testdata/sf0.01", "documents")).select("failed"), "test-ledger")
    bits = [r.failed for r in rows.collect()]
    got = {(r.version, r.rule): (r.failing, r.only_this, r.kept, r.kept_without) for r in rules.ablations(rows).collect()}
    want = {}
    for p in rules.POLICIES:
        for r in (r for r in rules.RULES if p.mask >> r.bit & 1):
            one = 1 << r.bit
            want[p.version, r.name] = (
                sum(b & one != 0 for b in bits), sum(b & p.mask == one for b in bits),
                sum(b & p.mask == 0 for b in bits), sum(b & p.mask & ~one == 0 for b in bits),
            )
    assert got == want and any(v[1] for v in want.values())


def test_repeated_words(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "a b", "", "x a b c y a b c z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rules.repeated_words(rules.words_of(F.col("t")))).collect()]
    assert got == [6, 4, 0, 0, 0, 6]


def test_mix(docs, spark):
    assert mixing.mix(docs.limit(0), {"a": 0.5}).count() == 0
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("abcd").alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
    )
    n = {r["source"]: r["count"] for r in mixing.mix(many, {"a": 0.75}).groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 1000) < 150
    assert mixing.mix(docs, {"a": 0.5}).columns[: 2] == ["doc_id", "text"]


def test_mix_of_sources_without_characters(spark):
    rows = [(k, None if k % 2 else "", "a") for k in range(100)] + [(100 + k, "abcd", "b") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"a": 0.5, "b": 0.5}).collect()
    assert sorted(r.doc_id for r in got if r.source == "a") == list(range(100))
    assert {r.doc_id for r in got if r.source == "b"} <= set(range(100, 200))
    assert mixing.mix(df.where("source = 'a'"), {"a": 1.0}).count() == 100
    assert mixing.mix(df, {"a": 1.0}).where("source = 'b'").count() == 0  # weight 0


def test_mix_of_high_rates(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y" * 1_000_000, "b")], "doc_id long, text string, source string")
    n = mixing.mix(df.select("doc_id", "text", "source"), {"a": 0.5}).where("source = 'a'").count()
    assert abs(n - 500_000) < 12 * 500_000**0.5
    table = {r.pool: r for r in mixing.rates(df, {"a": 0.5}).collect()}
    assert len(table["a"].steps) < 25_000 and table["a"].first > 0
    far = spark.createDataFrame([(u,) for u in (1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999)], "u double")
    mean = 4e6
    for r in far.select("u", mixing.large_count(F.lit(mean), F.col("u")).alias("n")).collect():
        assert abs(r.n - (mean + NormalDist().inv_cdf(r.u) * mean**0.5)) < 10

def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}], "id": 7}'),
        (2, '{"instruction": "add", "input": "", "output": "three"}'),
        (3, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (4, "no json"), (5, None), (6, '{"other": 1}'), (7, '{"prompt": "p", "completion": "c"}'),
    ]
    df = spark.createDataFrame(records, "id long, body string")
    got = {}
    for r in chat.turns_of_records(df, "body", "id").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[2] == [("user", "add"), ("assistant", "three")]
    assert got[3] == [("user", "q"), ("assistant", "a")] and got[7] == [("user", "p"), ("assistant", "c")]
    assert got[4] == got[5] == got[6] == [(None, None)]


def test_chat_layouts_mixed(spark):
    turns = [("user", None), ("assistant", "a \\ [INST]"), ("user", "q2"), ("assistant", "")]
    said = [{"role": r, "content": t} for r, t in turns]
    other = [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]
    bodies = [
        {"messages": said}, {"messages": said, "prompt": "p"}, {"messages": said, "system": "s"},
        {"messages": [None, *said[1:]], "answer": "x"}, {"conversations": other}, {"conversations": other, "output": "o"},
    ]
    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(9, '{"messages": []}'), (8, '{"messages": "text"}')]
    got = {}
    for r in chat.turns_of_records(spark.createDataFrame(rows, "id long, body string"), "body", "id").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.layout))
    want = [(r, t or "") for r, t in turns]
    for k in range(len(bodies)):
        seen = [(role, text) for _, role, text, _ in sorted(got[k])]
        assert seen == {2: [("system", "s"), *want], 3: [("", ""), *want[1:]]}.get(k, want)
        assert {x[3] for x in got[k]} == {"messages" if k < 4 else "from and value"}
    assert got[9] == got[8] == [(None, None, None, None)]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<<SYS>>\\\\<s>", "", None, "[ROLE] x [/ROLE]", "<"]
    rows = [(1, k, "assistant" if k % 2 else "a [/ROLE] b", t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(chat.turns_of_table(df))
    turns, loss = out.select(
        chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    ).first()
    assert [(t.role, t.text) for t in turns] == [(r[2], r[3] or "") for r in rows]
    assert loss == "".join(t or "" for t in texts[1::2])


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]),
            (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in hnsw.nearest(df).collect()}
    assert got == {(0, 1): (2, 2.0), (0, 2): (1, 1.0), (0, 3): (20, 1.0),
                   (20, 1): (2, 2.0), (20, 2): (0, 1.0), (20, 3): (1, 1.0)}


def test_shards_follow_the_vectors(spark):
    assert hnsw.Graph().shards(112_000_000) * hnsw.Graph().shard >= 112_000_000
    small = hnsw.Graph(shard=100, least=2, seen=1 << 10)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<float>")
    sizes = [r["size"] for r in hnsw.index(df, small).select("size").collect()]
    assert len(sizes) == 9 and sum(sizes) == 900 and max(sizes) < 200
    got = {}
    for r in hnsw.nearest(df, every=100, graph=small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 900, 100):
        near = [int(i) for i in np.argsort(-(data.astype(np.float64) @ data[q]), kind="stable") if i != q][:20]
        hits += len(got[q] & set(near))
    assert hits >= 0.9 * 180


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"body {k}") for k in range(40)] + [(None, None, None)],
                                  "page_id long, url string, html string")
    ours = fixity.archived(pages)
    assert fixity.audit(fixity.tree(ours), fixity.tree(ours)).count() == 0
    bad = ours.withColumn("hash", F.when(F.col("page_id") == 9, "0").otherwise(F.col("hash")))
    found = fixity.audit(fixity.tree(ours), fixity.tree(bad)).collect()
    assert [(r.node, r.fault) for r in found] == [(9, "changed")]


def test_fixity_reads_one_path_and_counts_copies(spark):
    kind = "page_id long, url string, html string"
    rows = [(k, f"u{k}", f"body {k}") for k in range(3000)] + [(7, "u7", "body 7"), (None, "n", "x"), (None, "n", "x")]
    less = [r for r in rows if r[0] not in (1500, 7)] + [(7, "u7", "body 7")]
    less.remove((None, "n", "x"))
    less[less.index((2100, "u2100", "body 2100"))] = (2100, "u2100", "rotten")
    ours, theirs = (fixity.archived(spark.createDataFrame(r, kind)) for r in (rows, less + [(2999, "u", "new")]))
    a, b = fixity.tree(ours), fixity.tree(theirs)
    leaves = {(r.file, r.node) for r in fixity.audit(a, b).collect() if r.file >= 0}
    assert leaves == {(0, 7), (1, 1500), (2, 2100), (2, 2999)}
    got = sorted((r.page_id if r.page_id is not None else -1, r.fault) for r in fixity.located(a, b, ours, theirs).collect())
    assert got == [(-1, "lost"), (7, "lost"), (1500, "lost"), (2100, "changed"), (2999, "extra")]


def test_toxic_sentences(spark):
    bad = [(k, "All is well here. You are a vile lout today.", 1) for k in range(60)]
    good = [(100 + k, "All is well here. You are a good friend today.", 0) for k in range(60)]
    rows = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    more = spark.createDataFrame([(1, "Fine day. What a vile lout!"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_texts(more, model, spans=True).collect()}
    assert got[1].score >= 0.3 and got[2].score == got[3].score == 0
    assert [(s.start, s.stop) for s in got[1].sentences] == [(10, 26)]


def test_weak_sentences_are_located_together(spark):
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(0.15 / 0.85)))  # 0.15 a sentence
    rows = spark.createDataFrame([(1, "One here. Two there. Three now."), (2, "One here."), (3, None)], "doc_id long, text string")
    for cut, want in ((0.3, [(0, 8)]), (0.2, [(0, 8), (10, 19)]), (0.1, [(0, 8), (10, 19), (21, 30)])):
        got = {r.doc_id: r for r in toxicity.score_texts(rows, model, spans=True, cut=cut).collect()}
        assert got[1].score == pytest.approx(1 - 0.85**3)
        assert [(s.start, s.stop) for s in got[1].sentences] == want
        assert len(got[2].sentences) == (cut < 0.15) and not got[3].sentences


def test_scores_of_odd_rows(docs):
    got = maxent.score_texts(docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)


def test_language_model_shares_add_up(spark):
    """On every way down the shares of all words, the rest and what was never seen make one."""
    texts = [(k, " ".join(f"w{(k * 7 + j * j) % 300}" for j in range(5 + k % 60))) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    shape = maxent.Shape(words=200, classes=4, per_class=4, bands=(40, 90), cell=2, buckets=64, most_buckets=64)
    known = maxent.known_counts(maxent.word_counts(docs), shape)
    assert 0 < len(known.seen) <= 200 and known.seen.min() >= known.least and known.distinct > len(known.seen)
    flat = np.random.default_rng(1).normal(0, 0.5, (64, shape.groups + 4)).astype(np.float32)
    model = maxent.Weights(known, flat)
    order = np.argsort(known.ranks)
    hashes, ranks = known.hashes[order], known.ranks[order]
    context = np.repeat(np.array([[5], [6], [7]], np.uint64) * np.uint64(0x9E3779B97F4A7C15), len(ranks), axis=1)
    logs, _ = model.forward(known, hashes, ranks, context)
    rest = 0.0
    depth = int(known.depth[-1])
    for tail in range(4**depth):
        more, _ = model.forward(known, np.array([tail], np.uint64), np.array([len(ranks)]), context[:, :1])
        rest += np.exp(more[0])
    assert np.exp(logs).sum() + rest == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("size", [1.0, 30.0, 59.0, 61.0, 500.0])
def test_softmax_of_small_and_large_sums(size):
    """Equal to one in 64 bits whether rows are moved or not, with and without probabilities."""
    rng = np.random.default_rng(int(size))
    z = rng.uniform(-size, size, (50, 36)).astype(np.float32)
    z[0], z[1], hit = -size, size, rng.integers(0, 36, 50)
    wide = z.astype(np.float64)
    want = wide - wide.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    logs, p = maxent._softmax(z.copy(), hit, True)
    assert np.allclose(logs, want[np.arange(50), hit], rtol=1e-5, atol=1e-4) and np.allclose(p, np.exp(want), atol=1e-5)
    again, none = maxent._softmax(z.copy(), hit, False)
    assert none is None and (again == logs).all()
    assert maxent._softmax(z[:0].copy(), hit[:0], True)[0].shape == (0,)


def test_language_model_adds_each_row_once():
    """Rows met once, twice and often get the step of their sum."""
    rng = np.random.default_rng(3)
    rows = np.array([5, 1, 5, 2, 2, 2, 7, 1, 0, 2])
    values = rng.normal(size=(10, 4)).astype(np.float32)
    table, speed, met = np.ones((8, 4), np.float32), np.zeros(8, np.float32), np.zeros(8, np.float32)
    maxent._add_rows(table, rows, values, speed, met, 0.3)
    total = np.zeros((8, 4))
    np.add.at(total, rows, values)
    fast = (total**2).mean(1)
    assert np.allclose(met, np.bincount(rows, minlength=8)) and np.allclose(speed, fast, rtol=1e-5)
    assert np.allclose(table, 1 + total * (0.3 / np.sqrt(fast + 1))[:, None], rtol=1e-5)


def test_language_model_step(spark):
    """The gradient of the forward pass lowers the loss on what it was taken from."""
    docs = spark.createDataFrame([(k, "a b c d " * 20) for k in range(40)], "doc_id long, text string")
    known = maxent.known_counts(maxent.word_counts(docs))
    trained = maxent.train(docs, known)
    texts = pa.array(["a b c d a b c d"])
    ranks, hashes, edge = maxent.token_ranks(texts, known)
    context = maxent.features(hashes, edge)
    before, _ = maxent.Weights(known).forward(known, hashes, ranks, context)
    after, _ = maxent.Weights(known, trained).forward(known, hashes, ranks, context)
    assert after.sum() > before.sum() + 3


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.score_texts(empty).collect() == []
    held = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "one two"])], "doc_id long, text string")
    assert len(maxent.score_texts(held).collect()) == 3


@pytest.mark.parametrize("words", [8, 1 << 18])
def test_rare_words_keep_their_counts(spark, words):
    """Whatever the bound, base scores and known words stay the same."""
    texts = [(k, " ".join(f"w{(k * k + j) % 97}" for j in range(k % 40))) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score_texts(docs, maxent.Shape(words=words)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in texts}
    tokens = {k: t.split() + [None] for k, t in texts}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    total, size = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in ws)
        assert got[k].base_score == pytest.approx(base, rel=1e-9)
        assert got[k].n_known == sum(counts[w] > 0 for w in ws)
        assert math.isfinite(got[k].score) and got[k].score < 0
