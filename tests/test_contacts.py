"""Named contacts in page text."""

import pytest

from doorstep.operators.web import extracted_contacts

CASES = {
    "one line": ("Owner: Priya Sharma, priya@cakebee.example", [("Priya Sharma", "owner", None, "priya@cakebee.example")]),
    "founder": ("-- Founder Priya Sharma", [("Priya Sharma", "owner", None, None)]),
    "marketing before manager": ("Marketing Manager Ravi Kumar", [("Ravi Kumar", "marketing", None, None)]),
    "card": ("Priya Sharma\n\nManager\n+91 98450 12345\nravi@x.example", [("Priya Sharma", "manager", "+91 98450 12345", None)]),
    "two cards": ("Priya Sharma\nOwner\nRavi Kumar\n98450 12345", [("Priya Sharma", "owner", None, None), ("Ravi Kumar", "unknown", "98450 12345", None)]),
    "card stops at the next name": ("Priya Sharma\nRavi Kumar\nManager", [("Ravi Kumar", "manager", None, None)]),
    "name alone": ("Priya Sharma\nWe bake bread every day.", []),
    "email alone": ("write to hello@x.example", []),
    "heading": ("## For Website Owners", []),
    "address": ("Chinmaya Hospital Rd\nKFC Circle\nAbove Vivo Showroom\nBengaluru, Karnataka 560038\n080 4111 2222", []),
    "street": ("Call 080 4111 2222 or visit the shop on 100 Feet Road", []),
    "repeat": ("Owner Priya Sharma\nManager PRIYA Sharma and Priya Sharma", [("Priya Sharma", "owner", None, None)]),
    "title": ("Dr. Anita Rao, owner", [("Anita Rao", "owner", None, None)]),
    "whole lines first": ("Asha Menon\nOwner\nManager Ravi Kumar", [("Ravi Kumar", "manager", None, None), ("Asha Menon", "owner", None, None)]),
    "short number": ("Manager Ravi Kumar since 1998, 12 34", [("Ravi Kumar", "manager", None, None)]),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)], "k string, text string")
    out = {}
    for r in extracted_contacts(df, keep=("k",)).orderBy("k", "contact_no").collect():
        out.setdefault(r.k, []).append((r.name, r.role, r.phone, r.email))
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_contacts(found, case):
    assert found.get(case, []) == CASES[case][1]


def test_no_text(found):
    assert "null" not in found
