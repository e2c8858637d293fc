"""Parameters read from files, dimension tables, recall with expiry."""

import datetime as dt
import json

from pyspark.sql import functions as F

from doorstep.functions.geo import country_code
from doorstep.operators import places, recall
from doorstep.session import fresh_path
from doorstep.sources import gazetteer, registry


def test_profiles_and_offers_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([
        {"id": "salon", "label": "Salon", "queries": ["hair salon"], "aliases": ["parlour"], "include_types": ["nail_salon", "hair_salon"],
         "exclude_suffixes": ["_store"], "terms": ["salon"], "strict": True, "demand": 21, "budget": 16},
        {"id": "cafe", "label": "Cafe"},
    ]))
    (tmp_path / "o.json").write_text(json.dumps([{"id": "o", "label": "O", "niches": [], "signals": ["s"], "hours": 1.5, "pitch": "p"}]))
    profiles = registry.load_profiles(str(tmp_path / "p.json"))
    offers = registry.load_offers(str(tmp_path / "o.json"))
    assert registry.rule_table(spark, profiles).count() == 4
    assert registry.alias_table(spark, profiles).count() == 5
    assert registry.query_table(spark, profiles).collect() == [("salon", 0, "hair salon")]
    assert registry.profile_payload(spark, profiles).first().include_types == ["hair_salon", "nail_salon"]
    assert registry.offer_payload(spark, offers).first().pitch_line == "p"


def test_shipped_tables():
    assert len(registry.PROFILE_BASES) == 24 and len(registry.OFFERS) == 9
    known = set(registry.SCORER_SIGNALS) | set(registry.OBSERVED_SIGNALS)
    assert all(set(o.signals) <= known and o.signals for o in registry.OFFERS)
    ids = {b[0] for b in registry.PROFILE_BASES}
    assert all(set(o.niches) <= ids for o in registry.OFFERS)


GAZETTEER = {
    "cities": [{"city": "Bangalore", "aliases": ["Bengaluru"], "state": "Karnataka", "country": "India", "gl": "in", "lat": 12.97, "lng": 77.59},
               {"city": "Delhi", "state": "Delhi", "country": "India", "gl": "in", "lat": 28.6, "lng": 77.2}],
    "areas": [{"area": "J.P. Nagar", "city": "Bangalore", "aliases": [], "state": "Karnataka", "country": "India", "gl": "in", "lat": 12.9, "lng": 77.58}],
}


def test_gazetteer_and_scopes(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(GAZETTEER, indent=1))
    keys = gazetteer.place_keys(*gazetteer.read_gazetteer(spark, str(path)))
    assert gazetteer.clashing_keys(keys).count() == 0
    scopes = spark.createDataFrame(
        [(1, "bengaluru", None, "India", ["JP Nagar", "jp  nagar", " "]), (2, "Delhi", "Delhi", "India", None), (3, "Bangalore", "Ohio", None, []),
         (4, "Bangalore", None, "in", ["Nowhere"])],
        "scope_id int, city string, state string, country string, areas array<string>",
    )
    targets = places.scope_targets(scopes)
    assert sorted((r.scope_id, r.query, r.radius_m) for r in targets.collect()) == [
        (1, "JP Nagar, bengaluru, India", 3000), (2, "Delhi, India", 15000), (3, "Bangalore, Ohio", 15000), (4, "Nowhere, Bangalore, in", 3000)]
    resolved, unresolved = places.resolve_targets(targets, keys)
    assert sorted((r.scope_id, r.label) for r in resolved.collect()) == [(1, "J.P. Nagar, Bangalore, Karnataka, India"), (2, "Delhi, India")]
    assert sorted(r.scope_id for r in unresolved.collect()) == [3, 4]
    wrong = places.country_check(resolved.withColumn("declared_gl", country_code(F.lit("UK"))))
    assert wrong.where("wrong_country").count() == 2


def test_recall_skips_expired_and_zero_vectors(spark):
    now = dt.datetime(2024, 1, 1)
    memories = spark.createDataFrame(
        [(1, "a", [1.0, 0.0], None), (2, "a", [1.0, 1.0], now - dt.timedelta(1)), (3, "a", [0.0, 1.0], now + dt.timedelta(1)),
         (4, "a", [0.0, 0.0], None), (5, "b", [1.0, 0.0], None), (6, "a", [2.0, 0.1], None)],
        "id int, scope string, embedding array<float>, expires_at timestamp",
    )
    asked = spark.createDataFrame([(9, "a", [3.0, 0.0])], "question_id int, scope string, embedding array<float>")
    got = recall.nearest(memories, asked, 5, F.lit(now)).orderBy("rank").collect()
    assert [r.memory_id for r in got] == [1, 6, 3]
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
