"""Registered queries against their SQL, and against plain versions where SQL has none."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from doorstep.checks import Check
from doorstep.llm.queries import ORACLE, QUERIES, vocabulary_path
from doorstep.llm.store import table
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
OPERATORS = range(1, 14)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_one_query_per_operator():
    for n in OPERATORS:
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, name):
    state, note, _ = compare(spark, con, name, Check(QUERIES[name], ORACLE[name], ()), FOLDER)
    assert state == "OK", note


def test_bpe_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    for row in QUERIES["op3_bpe_round_trip"](spark, FOLDER).collect():
        ids = tok.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = tok.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_scores_over_plain_counts(spark):
    rows = QUERIES["op4_maxent_scores"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    tokens = {
        i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + [None]
        for i, t in texts.items()
    }
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, size = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), total)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isfinite(r.score) and r.score < 0
    for part in (True, False):
        own = [r for r in rows if r.held_out == part]
        gain = sum(r.score - r.base_score for r in own) / sum(r.n_tokens for r in own)
        assert gain > 0.05, part


def test_neighbours_recall(spark):
    rows = QUERIES["op5_nearest_vectors"](spark, FOLDER).collect()
    data = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in data])
    vectors = np.array([r.embedding for r in data], np.float64)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = wanted = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        best = [i for _, i in sorted((-s, i) for s, i in zip(scores, ids) if i != q)][:20]
        assert sorted(found[q]) == list(range(1, 21))
        got = [found[q][k] for k in range(1, 21)]
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        for v, s in got:
            assert s == pytest.approx(scores[ids == v][0], abs=1e-12)
        hits, wanted = hits + len({v for v, _ in got} & set(best)), wanted + 20
    assert hits / wanted >= 0.9


def plain_components(rows, width, num, den):
    sets, parent = {}, {}
    for i, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams = list(zip(*[words[k:] for k in range(width)])) if len(words) >= width else [tuple(words)] * bool(words)
        sets[i], parent[i] = set(grams), i

    def root(i):
        return i if parent[i] == i else root(parent[i])

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(i, len(sets[i]), root(i)) for i in ids}


def test_jaccard_components(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op9_ngram_jaccard_join"](spark, FOLDER).collect()}
    assert got == plain_components([tuple(r) for r in docs], 4, 85, 100)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_minmax_components(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op11_minmax_near_dedup"](spark, folder).collect()}
    want = plain_components([tuple(r) for r in docs], 2, 80, 100)
    assert got == {(i, n, c, i == c) for i, n, c in want} and len({c for _, _, c in want}) < len(want)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert len(rows) == 10000
    truth = table(spark, folder, "labels").select("doc_id", "toxic").collect()
    seen = [(rows[r.doc_id].predicted, r.toxic) for r in truth if rows[r.doc_id].held_out]
    caught = [p for p, t in seen if t == 1]
    clean = [p for p, t in seen if t == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.02
    for i, r in rows.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_locates_sentences(spark):
    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all((r.n_located > 0) == (r.predicted == 1) for r in rows) and any(r.n_located for r in rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.located_sha256 == none) == (r.n_located == 0) for r in rows)
