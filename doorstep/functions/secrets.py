"""Removing credentials from text: redaction, payload scrub, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import let

# What a redacted spot reads, and the shapes that are redacted.
REDACTED = "[redacted]"
SCRUBBED = "REDACTED"
URL_SHAPE = r"""[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s"'<>{}\\]+"""
BEARER_SHAPE = r"(?i)\b(bearer|basic)\s+\S+"
ASSIGNMENT_SHAPE = (
    r"(?i)\b(api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|password"
    r"|authorization|x-api-key)\b\s*[=:]\s*\S+"
)
CREDENTIAL_SHAPE = (
    r"\b(?=[A-Za-z0-9_\-]*[0-9])(?=[A-Za-z0-9_\-]*[A-Za-z])[A-Za-z0-9_\-]{20,}\b"
)
LONG_RUN = r"[A-Za-z0-9_\-]{20}"
SECRET_FIELDS = ("api_key", "apikey", "key", "token", "access_token")


def redacted(text: Column, mark: str = REDACTED) -> Column:
    """Text without URLs, bearer tokens, labelled secrets and credential-shaped runs."""
    # Cheap tests first: most texts hold none of these.
    step = F.when(text.contains("://"), F.regexp_replace(text, URL_SHAPE, mark)).otherwise(text)
    step = F.regexp_replace(step, BEARER_SHAPE, f"$1 {mark}")
    step = F.regexp_replace(step, ASSIGNMENT_SHAPE, f"$1={mark}")
    return let(
        step,
        lambda s: F.when(
            s.rlike(LONG_RUN), F.regexp_replace(s, CREDENTIAL_SHAPE, mark)
        ).otherwise(s),
    )


def scrubbed_query(
    text: Column, fields: tuple[str, ...] = SECRET_FIELDS, mark: str = SCRUBBED
) -> Column:
    """Secret parameters after the first `?` replaced, up to the next `&`."""
    names = "|".join(fields)
    head = F.regexp_extract(text, r"^([^?]*\?)", 1)
    tail = F.regexp_extract(text, r"(?s)^[^?]*\?(.*)$", 1)
    clean = F.regexp_replace(tail, rf"(?i)(^|&)({names})(?:=[^&]*)?(?=&|$)", f"$1$2={mark}")
    return F.when(text.contains("?") & text.contains("="), F.concat(head, clean)).otherwise(text)


def _without_containers(text: Column, names: str, mark: str) -> Column:
    """`text` with every list or object of a secret name replaced, by counting brackets."""
    tokens = F.regexp_extract_all(
        text, F.lit(r'("(?:[^"\\]|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|")'), F.lit(1)
    )
    start = F.struct(
        F.lit("").alias("out"), F.lit(0).alias("inside"),
        F.lit("").alias("name"), F.lit("").alias("before"),
    )

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        begins = (
            opens & (F.trim(state["before"]) == ":") & state["name"].rlike(f'(?i)^"(?:{names})"$')
        )
        deep = state["inside"] > 0
        return F.struct(
            F.when(deep, state["out"]).otherwise(
                F.concat(state["out"], F.when(begins, f'"{mark}"').otherwise(token))
            ).alias("out"),
            F.when(deep, state["inside"] + opens.cast("int") - closes.cast("int"))
            .otherwise(begins.cast("int")).alias("inside"),
            state["before"].alias("name"), token.alias("before"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def scrubbed_json(
    payload: Column,
    fields: tuple[str, ...] = SECRET_FIELDS,
    known_key: str | None = None,
    mark: str = SCRUBBED,
) -> Column:
    """JSON text with secret-named fields, secret URL parameters and known keys replaced.

    Works on the text: a quoted name followed by a colon is a field. A value that is a string,
    a number or a word goes at once; a list or object goes whole, however deep.
    """
    names = "|".join(fields)
    value = r'(?:"(?:[^"\\]|\\.)*+"|[^,\[\]{}"\s]+)'
    step = F.regexp_replace(
        payload, rf'(?i)("(?:{names})"\s*:\s*){value}', f'$1"{mark}"'
    )
    step = let(
        step,
        lambda s: F.when(
            s.rlike(rf'(?i)"(?:{names})"\s*:\s*[\[{{]'), _without_containers(s, names, mark)
        ).otherwise(s),
    )
    step = F.regexp_replace(
        step, rf'(?i)([?&](?:{names}))=[^&"\\]*', f"$1={mark}"
    )
    if known_key:
        step = F.replace(step, F.lit(known_key), F.lit(mark))
    return step


def prompt_digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def key_fingerprint(key: Column) -> Column:
    """First twelve hex digits of a key's digest."""
    return F.substring(F.sha2(key, 256), 1, 12)
