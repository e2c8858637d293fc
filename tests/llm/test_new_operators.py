"""Min-max near-dedup, the manifest and the codebooks against plain versions, and in odd cases."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doorstep.llm import codebooks, manifest, minmax, spread
from doorstep.llm.store import discard, ready, stored
from tests.llm.test_queries import plain_components

# ---- min-max near-dedup


@pytest.fixture(scope="module")
def texts(spark):
    ready(spark)
    long = " ".join(f"w{k % 900}-{k // 7}" for k in range(40_000))
    base = [f"word{k}" for k in range(120)]
    near = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 120, 6)]
    rows = [" ".join(base), *near, long, long + " tail", "", None, " \n", "one", "One", "a b", "a  B", "a b c", "x y z", None]
    return list(enumerate(rows)) + [(None, "one"), (None, "only here"), (3, "three again"), (40, rows[1])]


@pytest.mark.parametrize("width", [2, 5])
def test_minmax_against_all_pairs(spark, texts, width):
    rows = [(k, t) for k, t in texts if k is not None and k != 3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        got = {tuple(r) for r in minmax.near_duplicates(df.repartition(parts), width).collect()}
        assert got == {(i, n, c, i == c) for i, n, c in plain_components(rows, width, 4, 5)}


def test_minmax_odd_rows(spark, texts):
    df = spark.createDataFrame([(k, t, 1, "s", 2) for k, t in texts * 2], "doc_id long, text string, n int, sid string, bands int")
    got = minmax.near_duplicates(df).collect()
    assert len(got) == 2 * len(texts)
    one = [r for r in got if r.doc_id is None]
    assert sorted((r.component_id, r.kept) for r in one if r.component_id) == [(26, False)] * 2  # "one"
    assert [r.kept for r in one if r.component_id is None] == [True] * 2
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 0 for r in got if r.doc_id in (23, 24, 25, 32))
    assert minmax.near_duplicates(df.limit(0)).count() == 0


def test_minmax_signatures():
    rng = np.random.default_rng(4)
    shared, own = rng.integers(0, 1 << 63, 800), rng.integers(0, 1 << 63, 400)
    a, b = (np.sort(np.concatenate([shared, own[k::2]]).astype(np.uint64)) for k in (0, 1))
    members, edge = np.concatenate([a, b]), np.array([0, 1000, 2000])
    low, high = minmax.min_max(members, edge)
    same = ((low[:, 0] == low[:, 1]).sum() + (high[:, 0] == high[:, 1]).sum()) / (2 * minmax.PERMUTATIONS)
    assert abs(same - 800 / 1200) < 0.15
    assert minmax.bands(low, high).shape == (2, minmax.BANDS)
    parity = minmax.parities(members, edge)
    apart = np.unpackbits((parity[0] ^ parity[1]).view(np.uint8)).sum()
    assert 0 < apart <= 400
    assert minmax.identities(members, edge)[0] != minmax.identities(members, edge)[1]


def test_attach_deals_out_hot_keys(spark):
    rows = stored(spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("k")), "test")
    values = spark.createDataFrame([(None, "n"), (0, "a"), (7, "z")], "k long, v string")
    got = {r["v"]: r["count"] for r in spread.attach(rows, values, "k").groupBy("v").count().collect()}
    assert got == {"n": 10_000, "a": 10_000, None: 10_000}
    assert spread.attach(rows, values, "k", "inner").count() == 20_000
    assert spread.attach(rows.limit(0), values, "k").count() == 0
    discard(rows)


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(*values):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def lower(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(hashes):
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(level) > 1:
            runs = [level[k : k + 16] for k in range(0, len(level), 16)]
            for leaf_no, place in enumerate(at):
                run, slot = divmod(place, 16)
                paths[leaf_no].append((runs[run][:slot], runs[run][slot + 1 :]))
                at[leaf_no] = run
            level = [sha(*run) for run in runs]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[name] = own, *tree([leaf(*r) for r in own])
    root, above = tree([subs[n][1] for n in names])
    out = []
    for place, name in enumerate(names):
        own, sub, paths = subs[name]
        for r, path in zip(own, paths):
            steps = path + above[place]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(*r[:4], lower(r[4])) if hit else leaf(*r)
            for left, right in steps:
                now = sha(*left, now, *right)
            out.append((r[0], leaf(*r), sub, root, sha(*[x for a, b in steps for x in a + b]), now, now == root))
    return out


def run_manifest(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(df, changed={"text": lower}, where=hit)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("parts", [1, 5])
def test_manifest_against_a_plain_one(spark, parts):
    ready(spark)
    big = [(k * 7919 % 300_007 - 100, "hot", "en", k, f"Text {k} Ä") for k in range(700)]
    far = [(k, f"s{i}", None, None, None if i % 3 else "") for i, k in enumerate((-(1 << 63), (1 << 63) - 1, 0, -1, 65_535, 65_536) * 4)]
    odd = [(None, "hot", "en", 1, f"Null {k}") for k in range(40)] + [(5, "twice", "x", 1, f"T{k % 9}") for k in range(50)]
    odd += [(None, None, None, None, None)] * 20 + [(1, "ä", "x", 0, "A" * 50_000), (2, "Z", "x", 0, ""), (2, "", "x", 0, "Q")]
    rows = big + far + odd
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("grp", "pos", "leaf", "hash", "size", "n")})
    got = [
        tuple(r) for r in run_manifest(df.repartition(parts)).collect()
    ]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_few_rows(spark):
    ready(spark)
    for rows in ([(1, "a", "en", 1, "Only")], [(k, "a", "en", 1, "x") for k in range(16)], [(k, str(k), "en", 1, "x") for k in range(17)]):
        got = [tuple(r) for r in run_manifest(spark.createDataFrame(rows, DOC)).collect()]
        assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert run_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_manifest_lays_out_many_equal_rows(spark):
    ready(spark)
    df = spark.range(10_000).select(F.lit(4).alias("doc_id"), *[F.lit("s").alias(c) for c in ("source", "lang", "n_chars", "text")])
    got = manifest.manifest(df).agg(F.count("*"), F.countDistinct("proof_sha256"), F.min("verified")).first()
    assert got[0] == 10_000 and got[1] > 2 and got[2]


def test_containers():
    rng = np.random.default_rng(1)
    for size in (0, 1, 4000, 4096, 5000, 65_536):
        places = np.sort(rng.choice(manifest.PLACES, size, replace=False))
        rows = rng.integers(1, 4, size)
        one = manifest.container_of(places, rows)
        assert len(one[0]) <= manifest.PLACES // 8
        both = manifest.rows_of([one[0]] * 2, [one[1]] * 2)
        assert (both[places] == 2 * rows).all() and both.sum() == 2 * rows.sum()


def test_directory_levels(spark):
    rng = np.random.default_rng(2)
    chunks = sorted({manifest.NULLS, -(1 << 47), (1 << 47) - 1, 0, -1, *map(int, rng.integers(-(1 << 47), 1 << 47, 50)), *range(4090, 4100)})
    rows = [(g, c, k + 1) for g in "ab" for k, c in enumerate(chunks)]
    got = manifest.directory(spark.createDataFrame(rows, "grp string, chunk long, n long")).collect()
    assert {(r.grp, r.chunk, r.before, r["size"]) for r in got} == {
        (g, c, sum(range(1, k + 1)), sum(range(1, len(chunks) + 1))) for g in "ab" for k, c in enumerate(chunks)
    }


# ---- codebooks


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    data = np.zeros((len(kept), parts * width), np.int64)
    for k, (_, _, v) in enumerate(kept):
        data[k, : len(v)] = np.floor(np.array(v, np.float64) * 4096)
    data = data.reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, data[k].astype("<i4").tobytes()))
    book = data[first[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        gaps = ((data[:, :, None, :] - book[None]) ** 2).sum(-1)
        at = gaps.argmin(2)
        for p in range(parts) if turn < rounds else ():
            for e in range(book.shape[1]):
                if (at[:, p] == e).any():
                    own = data[at[:, p] == e, p]
                    book[p, e] = own.sum(0) // len(own)
    error = gaps.min(2).sum(1)
    by = {}
    for (_, label, _), e in zip(kept, error.tolist()):
        by[label] = by.get(label, 0) + e
    digest = sha(",".join(map(str, book.ravel().tolist())))
    return [(i, "".join(f"{c:02x}" for c in row), e, by[l], digest) for (i, l, _), row, e in zip(kept, at.tolist(), error.tolist())]


VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("count, dim", [(3, 8), (16, 24), (400, 16), (400, 13)])
def test_codes_against_plain_rounds(spark, count, dim):
    ready(spark)
    rng = np.random.default_rng(count + dim)
    rows = [(k, (rng.integers(-3, 4, dim) / 64 if k % 2 else rng.normal(size=dim)).astype(np.float32).tolist(), k % 3 or None) for k in range(count)]
    rows += [(-1, None, 1), (-2, [float("nan")] * dim, 1), (-3, [None] * dim, 2), (-4, [float("inf")] * dim, 2)]
    rows += [rows[1], (None, [0.5] * dim, 9), (7, [0.25] * (dim - 2), None)]
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit(1) for c in ("q", "state", "sums", "error", "code")})
    for parts in (1, 5):
        got = sorted((tuple(r) for r in codebooks.compressed(df.repartition(parts)).collect()), key=str)
        assert got == sorted(plain_codes(rows), key=str)


def test_codes_of_odd_tables(spark):
    ready(spark)
    assert codebooks.compressed(spark.createDataFrame([], VEC)).count() == 0
    assert codebooks.compressed(spark.createDataFrame([(1, None, 2)], VEC)).count() == 0
    got = codebooks.compressed(spark.createDataFrame([(1, [], 2), (2, [1e30, -1e30], 2)], VEC)).collect()
    assert len(got) == 2 and all(r.error == 0 for r in got)


def test_bounds_are_right_and_spare_scans():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (12, 4, 8))
    data = (centres[rng.integers(0, 12, 5000)] + rng.integers(-60, 60, (5000, 4, 8))).astype(np.int32)
    history = data[:16].astype(np.int64).transpose(1, 0, 2)[None]
    state, scans = None, []
    for _ in range(7):
        state, scanned = codebooks.assign(data, state, history)
        scans.append(scanned)
        for p in range(4):
            gaps = codebooks.distances(data[:, p].astype(np.int64), history[-1][p])
            assert (state["entry"][:, p] == gaps.argmin(1)).all()
        sums = np.zeros((4, 16, 9), np.int64)
        for p in range(4):
            np.add.at(sums[p, :, :8], state["entry"][:, p], data[:, p])
            sums[p, :, 8] = np.bincount(state["entry"][:, p], minlength=16)
        history = np.concatenate([history, codebooks.next_book(history[-1], sums)[None]])
    assert scans[0] == 20_000 and scans[-1] < 0.2 * scans[0]


def test_matrix_columns():
    values = np.arange(12, dtype="<i4").reshape(3, 4)
    column = codebooks._binary(values)
    assert column.type == pa.binary() and (codebooks._rows(column, "<i4") == values).all()
