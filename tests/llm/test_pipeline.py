"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from corpus_pipeline import COLUMNS, STAGES
from doorstep.llm.queries import SEED, WEIGHTS, vocabulary_path
from doorstep.llm.store import stored, table
from tests.llm.test_queries import plain_components

FOLDER = "/root/testdata/sf0.001"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain_counts(sources, docs):
    """How often each document is drawn: the Poisson distribution inverted at its hashed number."""
    pool = {i: s if s in WEIGHTS else None for i, s in sources.items()}
    chars = Counter()
    for i, t in docs:
        chars[pool[i]] += len(t)
    out = Counter()
    for i, _ in docs:
        if not chars[pool[i]]:
            out[i] = 1
            continue
        share = WEIGHTS.get(pool[i], 1.0 - sum(WEIGHTS.values()))
        rate = share * sum(chars.values()) / chars[pool[i]]
        u = int(hashlib.md5(f"{SEED}:{i}:".encode()).hexdigest()[:13], 16) / (1 << 52)
        term = below = math.exp(-rate)
        while below <= u:
            out[i] += 1
            term *= rate / out[i]
            below += term
    return +out


def test_stages(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    docs = table(spark, FOLDER, "documents")
    for name, stage in STAGES:
        before = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        after = docs.collect()
        texts = [(r.doc_id, r.text or "") for r in after]
        if name != STAGES[-1][0]:
            assert docs.columns == list(COLUMNS)
        if name == "toxicity":
            assert set(texts) <= set(before) and len(texts) > 0.8 * len(before)
        elif name == "line_dedup":
            holders = defaultdict(set)
            for i, t in before:
                for line in t.split("\n"):
                    holders[key(line)].add(i)
            gone = {k for k, ids in holders.items() if k and len(ids) >= 10}
            assert sorted(texts) == sorted(
                (i, "\n".join(x for x in t.split("\n") if key(x) not in gone)) for i, t in before
            )
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "ngram_jaccard_join":
            groups = defaultdict(set)
            for i, _, root in plain_components(before, 5, 4, 5):
                groups[root].add(i)
            kept = {i for i, _ in texts}
            assert all(len(kept & ids) == 1 for ids in groups.values()) and len(texts) == len(kept)
        elif name == "mix_sources":
            assert Counter(i for i, _ in texts) == plain_counts(sources, before) and set(texts) <= set(before)
        else:
            for r in after:
                assert r.ids == tok.encode(r.text or "", add_special_tokens=False).ids
                assert r.n_tokens == len(r.ids)
