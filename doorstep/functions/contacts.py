"""Named contacts in page text, as one array expression per document.

A line with a name and a role, phone or e-mail is a contact. A line that is nothing but a
name takes its details from the next two written lines, stopping at another bare name. Both
rules look only at a fixed neighbourhood, so no document leaves its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import let, stripped


@dataclass(frozen=True)
class ContactRules:
    """Patterns for roles, details and names. Parameters with the usual ones as defaults."""

    # Role words in order of precedence, detail and name shapes, non-names.
    roles: tuple[tuple[str, str], ...] = (
        (r"(?i)\bmarketing\b", "marketing"),
        (r"(?i)\b(?:co-?founders?|founders?|owners?|proprietors?)\b", "owner"),
        (r"(?i)\bmanagers?\b", "manager"),
    )
    labels: str = (
        r"(?i)\b(?:co-?founders?|founders?|owners?|proprietors?|managers?|marketing|contact|"
        r"reach\s+us|write\s+to|enquir(?:y|ies)|general)\b"
    )
    email: str = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
    phone: str = r"(\+?\d[\d\-\s]{5,16}\d)"
    phone_digits: tuple[int, int] = (7, 13)
    title: str = r"(?:(?:Mr|Mrs|Ms|Dr|Mx)\.?\s+)?"
    name: str = r"([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){1,2})"
    heading: str = r"^#{1,6}\s"
    name_line_chars: int = 40
    not_names: tuple[str, ...] = (
        "our", "menu", "contact", "about", "home", "order", "book", "call", "visit", "shop",
        "team", "meet", "welcome", "products", "services", "gallery", "location", "hours",
        "policy", "privacy", "terms", "cart", "checkout", "cake", "cakes", "bakery",
        "questions", "general", "thanks", "thank", "road", "street", "lane", "avenue", "feet",
        "nagar", "layout", "block", "sector", "floor", "cross", "main", "showroom", "circle",
        "above", "opposite", "near", "mall", "complex", "building", "tower", "plaza",
        "junction", "signal",
    )


# Where a contact was read, and how far it is trusted.
SOURCE_CONFIDENCE = {"website": 0.8, "ig_bio": 0.6}

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _role(line: Column, rules: ContactRules) -> Column:
    found = F.lit(None).cast("string")
    for pattern, role in reversed(rules.roles):
        found = F.when(line.rlike(pattern), role).otherwise(found)
    return found


def email_in(line: Column, rules: ContactRules) -> Column:
    found = F.regexp_extract(line, rules.email, 1)
    return F.when(line.contains("@"), F.nullif(found, F.lit("")))


def phone_in(line: Column, rules: ContactRules) -> Column:
    low, high = rules.phone_digits
    runs = F.filter(
        F.regexp_extract_all(line, F.lit(rules.phone), F.lit(1)),
        lambda run: F.length(F.regexp_replace(run, r"[^0-9]", "")).between(low, high),
    )
    return F.trim(F.try_element_at(runs, F.lit(1)))


def _is_name(candidate: Column, rules: ContactRules) -> Column:
    return ~F.exists(F.split(F.lower(candidate), r"\s+"), lambda w: w.isin(*rules.not_names))


def _name_in(line: Column, rules: ContactRules) -> Column:
    masked = F.regexp_replace(line, rules.labels, " ")
    found = F.regexp_extract_all(masked, F.lit(rules.title + rules.name), F.lit(1))
    return F.try_element_at(F.filter(found, lambda c: _is_name(c, rules)), F.lit(1))


def _bare_name(line: Column, rules: ContactRules) -> Column:
    whole = F.regexp_extract(line, rf"^{rules.title}{rules.name}\.?$", 1)
    name = let(whole, lambda w: F.when((w != "") & _is_name(w, rules), w))
    return F.when(F.length(line) <= rules.name_line_chars, name)


def line_facts(text: Column, rules: ContactRules = ContactRules()) -> Column:
    """One struct per written line that is not a heading: role, phone, email, name, bare."""
    lines = F.filter(
        F.transform(
            F.split(F.coalesce(text, F.lit("")), LINE_BREAK),
            stripped,
        ),
        lambda line: (line != "") & ~line.rlike(rules.heading),
    )

    def facts(line: Column) -> Column:
        details = F.struct(
            _role(line, rules).alias("role"),
            phone_in(line, rules).alias("phone"),
            email_in(line, rules).alias("email"),
        )
        return let(details, lambda d: named(line, d))

    def named(line: Column, d: Column) -> Column:
        detailed = d["role"].isNotNull() | d["email"].isNotNull() | d["phone"].isNotNull()
        return F.struct(
            d["role"].alias("role"),
            d["phone"].alias("phone"),
            d["email"].alias("email"),
            F.when(detailed, _name_in(line, rules)).alias("name"),
            F.when(~detailed, _bare_name(line, rules)).alias("bare"),
        )

    return F.transform(lines, facts)


def contacts_from_facts(facts: Column) -> Column:
    """Array of (name, role, phone, email), one per distinct name, whole lines first."""

    def contact(name: Column, role: Column, phone: Column, email: Column) -> Column:
        return F.struct(
            name.alias("name"),
            F.coalesce(role, F.lit("unknown")).alias("role"),
            phone.alias("phone"),
            email.alias("email"),
        )

    whole = F.transform(
        F.filter(facts, lambda f: f["name"].isNotNull()),
        lambda f: contact(f["name"], f["role"], f["phone"], f["email"]),
    )

    def card(f: Column, i: Column) -> Column:
        one = F.try_element_at(facts, i + 2)
        one_ok = one.isNotNull() & one["bare"].isNull()
        two = F.try_element_at(facts, i + 3)
        two_ok = one_ok & two.isNotNull() & two["bare"].isNull()

        def detail(part: str) -> Column:
            return F.coalesce(F.when(one_ok, one[part]), F.when(two_ok, two[part]))

        role, phone, email = detail("role"), detail("phone"), detail("email")
        return F.when(
            f["bare"].isNotNull()
            & (role.isNotNull() | phone.isNotNull() | email.isNotNull()),
            contact(f["bare"], role, phone, email),
        )

    cards = F.filter(F.transform(facts, card), lambda c: c.isNotNull())
    return F.concat(whole, cards)
