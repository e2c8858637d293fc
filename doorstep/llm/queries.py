"""One query per operator over the given tables, and the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.llm import bpe, chat, codebooks, fixity, hnsw, jaccard, lines, manifest, maxent, minmax, mixing, rules, toxicity
from doorstep.llm.store import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
SPACES = r"[\x20\x09-\x0D]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def lower_sql(text: str) -> str:
    return f"translate({text}, '{lines.UPPER}', '{lines.LOWER}')"


LINE_KEYS = f"""
    SELECT row, doc_id, pos, line, {lower_sql(f"regexp_replace(line, '^{SPACES}+|{SPACES}+$', '', 'g')")} AS k
    FROM (
        SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
            FROM documents
        )
    )
"""


@query("op2_line_dedup", f"""
    WITH lines AS ({LINE_KEYS}),
    shared AS (
        SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(s.k) AS n_dropped,
        sha256(coalesce(string_agg(CASE WHEN s.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
    FROM lines l LEFT JOIN shared s USING (k)
    GROUP BY row
""")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs, least=10, shortest=1)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary_path())


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard.similar_texts(docs, width=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id"
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


_T = chat.Template()
_CONTROL = "|".join(
    m.replace("[", "\\[").replace("]", "\\]").replace("|", "\\|") for m in sorted({_T.begin, _T.end, *_T.more})
)
_MARKS = len(_T.begin + _T.role_open + _T.role_close + _T.end)


def escaped_sql(text: str) -> str:
    """Characters of a text after escaping: one more per backslash and per control string."""
    return (
        f"(length({text}) + length({text}) - length(replace({text}, chr(92), '')) "
        f"+ len(regexp_extract_all({text}, '{_CONTROL}')))"
    )


@query("op1_chat_format", f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
            AS loss_sha256,
        CAST(sum({_MARKS} + {escaped_sql("role")} + {escaped_sql("text")}) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.turns_of_table(table(spark, folder, "conversations"))
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(own)))


_FAILS = " OR ".join(f"({r.fails})" for r in rules.RULES if rules.POLICIES[-1].mask >> r.bit & 1)
_BASE = " OR ".join(f"({r.fails})" for r in rules.RULES if rules.BASE >> r.bit & 1)


@query("op7_quality_rules", f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
    ), split AS (
        SELECT row, doc_id, text,
            list_filter(regexp_split_to_array(text, '{SPACES}+'), lambda x: x <> '') AS words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM docs
    ), windows AS (
        SELECT row, i, words[i : i + 2] AS w
        FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM split)
    ), again AS (
        SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, w HAVING count(*) >= 2
    ), covered AS (
        SELECT row, count(DISTINCT p) AS n
        FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row
    ), measured AS (
        SELECT s.row, doc_id, CAST(len(words) AS BIGINT) AS n_words,
            CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
            len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
            len(regexp_extract_all(text, '!!|[?][?]')) AS n_stress,
            len(regexp_extract_all(text, '[0-9]')) AS n_digits
        FROM split s LEFT JOIN covered c ON s.row = c.row
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        {_BASE} AS base_failed, NOT ({_FAILS}) AS kept
    FROM measured
""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.rejected_by(rules.POLICIES[0]).alias("base_failed"),
        (~rules.rejected_by(rules.POLICIES[-1])).alias("kept"),
    )


#: Shares of the mix by source; the sources without one share what is left.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.02}
SEED = 17
_POOL = "CASE WHEN source IN (" + ", ".join(f"'{s}'" for s in WEIGHTS) + ") THEN source ELSE '' END"
_TARGET = (
    "CASE pool " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
    + f" ELSE {1.0 - sum(WEIGHTS.values())!r} END"
)


@query("op8_mix_sources", f"""
    WITH sums AS (
        SELECT {_POOL} AS pool, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1
    ), rated AS (
        SELECT pool, CAST({_TARGET} AS DOUBLE) * 1.0 * (SELECT sum(chars) FROM sums)::DOUBLE / chars::DOUBLE AS rate
        FROM sums WHERE chars > 0
    ), terms AS (
        SELECT pool, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rated
    ), p AS (
        SELECT pool, k, exp((CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END) - rate - lgamma(k + 1)) AS p FROM terms
    ), steps AS (
        SELECT pool, list(below ORDER BY k) AS steps FROM (
            SELECT pool, k, sum(p) OVER (PARTITION BY pool ORDER BY k) AS below FROM p
        ) GROUP BY pool
    ), drawn AS (
        SELECT doc_id, source, text, steps,
            CAST('0x' || substr(md5('{SEED}:' || doc_id || ':'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u
        FROM documents LEFT JOIN steps ON pool = {_POOL}
    )
    SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('{SEED}:place:' || doc_id || ':' || copy) AS place,
        sha256(coalesce(text, '')) AS text_sha256
    FROM (
        SELECT doc_id, source, text, unnest(range(1, CASE WHEN steps IS NULL THEN 2
            ELSE len(list_filter(steps, lambda s: s <= u)) + 1 END)) AS copy FROM drawn
    )
""")
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents; the digest is taken of the text that came through the shuffle."""
    mixed = mixing.mix(table(spark, folder, "documents"), WEIGHTS, seed=SEED)
    return mixed.select(
        "doc_id", "source", "copy", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


@query("op5_nearest_vectors")
def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op6_fixity_audit", """
    SELECT CAST(page_id // 1000 AS BIGINT) AS file, page_id,
        CASE WHEN page_id % 89 = 7 THEN 'lost' ELSE 'changed' END AS fault
    FROM pages WHERE page_id % 89 = 7 OR page_id % 97 = 5
""")
def op6_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as an archive against a replica in which some pages are lost and others have rotted."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    rotten = F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))
    replica = pages.where("page_id IS NULL OR page_id % 89 <> 7").withColumn(
        "html", F.when(F.col("page_id") % 97 == 5, rotten).otherwise(F.col("html"))
    )
    ours, theirs = (stored(fixity.archived(p), "fixity-records") for p in (pages, replica))
    return fixity.located(fixity.tree(ours), fixity.tree(theirs), ours, theirs)


@query("op4_maxent_scores")
def op4_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score_texts(table(spark, folder, "documents").select("doc_id", "text"))


@query("op11_minmax_near_dedup")
def op11_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, folder, "documents"), width=2, num=80, den=100)


#: Unsigned crc32 of a number's decimal digits, bit by bit.
_CRC = """
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
        lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


@query("op12_merkle_manifest", f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf_sql("text")} AS leaf,
            CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(lower_sql("text"))} END AS other
        FROM documents
    ), nodes AS (
        SELECT 0 AS level, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            leaf AS hash, count(*) OVER (PARTITION BY grp) AS n FROM leaves
        UNION ALL
        SELECT level + 1, grp, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16
        FROM nodes WHERE n > 1 GROUP BY ALL
    ), tops AS (
        SELECT 0 AS level, grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, hash, count(*) OVER () AS n
        FROM nodes WHERE n = 1
        UNION ALL
        SELECT level + 1, '', pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16
        FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
    ), paths AS (
        SELECT 0 AS level, grp, pos, pos AS at, coalesce(other, leaf) AS own, '' AS proof, doc_id, leaf
        FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)
        UNION ALL
        SELECT p.level + 1, p.grp, p.pos, p.at // 16,
            sha256(string_agg(CASE WHEN s.pos = p.at THEN p.own ELSE s.hash END, '' ORDER BY s.pos)),
            p.proof || coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (WHERE s.pos <> p.at), ''), p.doc_id, p.leaf
        FROM paths p JOIN nodes s ON s.level = p.level AND s.grp = p.grp AND s.pos // 16 = p.at // 16 AND s.n > 1
        GROUP BY p.level, p.grp, p.pos, p.at, p.own, p.proof, p.doc_id, p.leaf
    ), upper AS (
        SELECT p.doc_id, p.leaf, p.grp, p.pos, t.hash AS subroot, 0 AS level, t.pos AS at, p.own, p.proof
        FROM paths p JOIN nodes n ON n.grp = p.grp AND n.level = p.level AND n.n = 1 JOIN tops t ON t.level = 0 AND t.grp = p.grp
        UNION ALL
        SELECT p.doc_id, p.leaf, p.grp, p.pos, p.subroot, p.level + 1, p.at // 16,
            sha256(string_agg(CASE WHEN s.pos = p.at THEN p.own ELSE s.hash END, '' ORDER BY s.pos)),
            p.proof || coalesce(string_agg(s.hash, '' ORDER BY s.pos) FILTER (WHERE s.pos <> p.at), '')
        FROM upper p JOIN tops s ON s.level = p.level AND s.pos // 16 = p.at // 16 AND s.n > 1
        GROUP BY p.doc_id, p.leaf, p.grp, p.pos, p.subroot, p.level, p.at, p.own, p.proof
    ), root AS (SELECT hash AS root, level FROM tops WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
    FROM upper JOIN root USING (level)
""")
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the documents, and where it notices that texts were lower-cased afterwards."""
    docs = table(spark, folder, "documents")
    lower = F.translate("text", lines.UPPER, lines.LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(docs, changed={"text": lower}, where=hit)


PARTS, ENTRIES, ROUNDS = 8, 16, 6


def _codebooks_sql() -> str:
    """All rounds one after another: assign parts, then replace entries by floored means."""
    steps = [f"""
        kept AS (
            SELECT row_number() OVER () AS row, vec_id, label, len(embedding) // {PARTS} AS w,
                list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT row, part, q[part * w + 1 : (part + 1) * w] AS v FROM kept, range({PARTS}) p(part)
        ), book0 AS (
            SELECT part, e, v FROM parts JOIN (
                SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
            ) USING (row) WHERE e < {ENTRIES}
        )"""]
    for turn in range(ROUNDS + 1):
        steps.append(f"""
        assigned{turn} AS (
            SELECT row, part, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
                SELECT row, p.part, p.v, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                FROM parts p JOIN book{turn} b ON p.part = b.part
            ) GROUP BY row, part
        )""")
        if turn < ROUNDS:
            steps.append(f"""
        means{turn} AS (
            SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT part, e, i, sum(x)::BIGINT AS s, count(*) AS n
                FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM assigned{turn}) GROUP BY ALL
            ) GROUP BY part, e
        ), book{turn + 1} AS (
            SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM book{turn} b LEFT JOIN means{turn} m ON m.part = b.part AND m.e = b.e
        )""")
    return f"""
    WITH {', '.join(steps)}, coded AS (
        SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM assigned{ROUNDS} GROUP BY row
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM book{ROUNDS}) AS codebooks_sha256
    FROM kept JOIN coded USING (row)
    """


@query("op13_vector_codes", _codebooks_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.compressed(table(spark, folder, "embeddings"), PARTS, ENTRIES, ROUNDS)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline at the repository's top, over all its stages."""
    from corpus_pipeline import run

    rows = run(spark, folder)
    ids = F.concat_ws(",", F.transform("ids", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", "source", "n_chars", "n_tokens", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.sha2(ids, 256).alias("ids_sha256"),
    )
