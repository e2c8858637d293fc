"""The merge against a plain fold, and upsert rules."""

from functools import reduce

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doorstep.operators import identity

FIELDS = identity.SCALAR_FIELDS
SCHEMA = (
    "dedupe_key string, ordinal int, " + ", ".join(f"{f} string" for f in FIELDS)
    + ", lat double, lng double, raw_categories array<string>, matched_niches array<string>"
)
text = st.sampled_from([None, "", "a", "b", "c"])
point = st.sampled_from([None, 0.0, 1.5])
record = st.fixed_dictionaries(
    {**{f: text for f in FIELDS}, "lat": point, "lng": point,
     "raw_categories": st.lists(st.sampled_from("xyz"), max_size=3),
     "matched_niches": st.lists(st.sampled_from("pq"), max_size=2)}
)


def rich(r):
    filled = sum(bool(r[f]) for f in identity.RICH_FIELDS)
    return filled + (r["lat"] is not None and r["lng"] is not None)


def together(first, second):
    lead, other = (second, first) if rich(second) > rich(first) else (first, second)
    out = {f: lead[f] or other[f] or None for f in FIELDS}
    for f in ("lat", "lng"):
        out[f] = lead[f] if lead[f] is not None else other[f]
    for f in identity.LIST_FIELDS:
        out[f] = list(dict.fromkeys(first[f] + second[f]))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(st.lists(record, min_size=1, max_size=7), min_size=12, max_size=25))
def test_merge_equals_the_fold(spark, groups):
    rows, want = [], {}
    for g, members in enumerate(groups):
        for i, m in enumerate(members):
            rows.append((f"k{g}", i * len(groups) + g, *[m[f] for f in FIELDS], m["lat"], m["lng"],
                         m["raw_categories"], m["matched_niches"]))
        start = {**members[0], **{f: members[0][f] or None for f in FIELDS},
                 **{f: list(dict.fromkeys(members[0][f])) for f in identity.LIST_FIELDS}}
        want[f"k{g}"] = reduce(together, members[1:], start)
    got = identity.merge_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(groups)
    for r in got:
        expected = want[r.dedupe_key]
        assert {f: r[f] for f in expected} == expected
        assert r.ordinal == int(r.dedupe_key[1:])


def test_key_tiers(spark):
    rows = [
        ("p", "Cafe Noir", "AB-1", "1", None, "x", 1.0, 2.0),
        ("c", "Cafe Noir", None, None, "https://www.Noir.example:8080/x", "x", None, None),
        ("d", "cafe-noir", "", "98 76", None, None, None, None),
        ("a", "Cafe Noir", None, None, None, "12, High St.", None, None),
        ("l", "Cafe Noir", None, None, None, "", 12.5, -3.25),
        ("n", "Cafe Noir", None, None, None, None, 12.5, None),
    ]
    df = spark.createDataFrame(
        rows, "id string, name string, pid string, phone string, site string, addr string, lat double, lng double"
    )
    key = identity.dedupe_key(*[F.col(c) for c in ("name", "pid", "phone", "site", "addr", "lat", "lng")])
    got = {r.id: r.k for r in df.select("id", key.alias("k")).collect()}
    assert got == {
        "p": "provider|ab1", "c": "contact|cafenoir|wwwnoirexample8080", "d": "contact|cafenoir|9876",
        "a": "address|cafenoir|12highst", "l": "location|cafenoir|1250000|-325000",
        "n": "location|cafenoir|",
    }


def test_thin_sighting_keeps_what_is_known(spark):
    stored = spark.createDataFrame([("k", "Old", "1", "see"), (None, "X", "2", None)], "key string, name string, phone string, notes string")
    incoming = spark.createDataFrame([("k", "New", None, ""), (None, "Y", None, "n"), ("z", "Z", None, None)], stored.schema)
    got = identity.upsert(stored, incoming, "key", replace=["name"], keep_known=["phone"], keep_present=["notes"])
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([("k", "New", "1", "see"), (None, "X", "2", None), (None, "Y", None, "n"), ("z", "Z", None, None)], key=str)


def test_insert_keeps_the_first_of_a_key(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame(
        [(2, "c", 2), (2, "b", 1), (1, "z", 0), (None, "n", 3), (None, "n", 4)], "k int, v string, at int"
    )
    got = identity.insert_if_absent(stored, incoming, ["k"], ["at"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, "b"), (None, "n"), (None, "n")]


def test_lists_of_any_length_keep_their_order(spark):
    long = [f"t{i}" for i in range(70_000)]
    df = spark.createDataFrame([("k", 1, long), ("k", 2, ["first of two"])], "k string, o long, l array<string>")
    wide = df.select("k", "o", *[df["l"].alias(f) for f in identity.LIST_FIELDS])
    (row,) = identity._ordered_unions(wide, "k", "o").collect()
    assert list(row[identity.LIST_FIELDS[0]]) == [*long, "first of two"]
