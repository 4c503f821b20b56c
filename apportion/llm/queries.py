"""The operators as named queries on the tables, and SQL for those that it can express."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.llm import (
    bpe,
    chat,
    collocations,
    fingerprints,
    metric_tree,
    near_duplicates,
    packing,
    phrases,
    quality,
    reputation,
    suffix_arrays,
    warc,
    whitening,
)

RULES = (
    reputation.Rule("block", "net", "/"),
    reputation.Rule("allow", "example.net", "/en/"),
    reputation.Rule("block", "example.com", "/de/"),
    reputation.Rule("allow", "org", "/fr/"),
)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NEIGHBOURS, QUERY_EVERY = 5, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    carry(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carry(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if getattr(context, "_apportion_carried", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="apportion-"), "apportion.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    context._apportion_carried = True


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probes(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = reputation.page_outcomes(table(spark, sf_dir, "labels"))
    return reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_passages(table(spark, sf_dir, "documents"), digest=True)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"))


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.whole_vectors(table(spark, sf_dir, "embeddings"))
    return metric_tree.top_inner_products(vectors, F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.remove_repeats(table(spark, sf_dir, "documents"), suffix_arrays.BOTH, digest=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = functools.partial(packing.tokenizer_encoder, VOCABULARY)
    return packing.pack(table(spark, sf_dir, "documents"), encoder)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    added = spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.render(chat.fold(chat.as_events(rows.unionAll(added)))))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.with_ids(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decoded(ids, RANKS, bpe.digests)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_rows(warc.read_archives(manifest, with_payload=False))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_quality, op3_reputation, op4_passages, op5_near_duplicates,
        op6_top_products, op7_suffix_arrays, op8_packing, op9_chat, op10_bpe,
        op11_warc, op12_whitening, op13_collocations,
    )
}

_OP3_SQL = f"""
WITH parts AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), '{reputation.UPPER}', '{reputation.LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
    FROM parts
), outcomes AS (
    SELECT doc_id, count(*) AS n, sum(CAST(quality = 0 OR coalesce(toxic, 0) = 1 AS INT)) AS bad
    FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR coalesce(toxic, 0) = 1) IS NOT NULL
    GROUP BY doc_id
), hosts AS (
    SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
           array_to_string(string_split(host, '.')[-2:], '.') AS domain,
           string_split(host, '.')[-1] AS suffix
    FROM split LEFT JOIN outcomes ON page_id = doc_id GROUP BY host
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad,
           (sum(sum(bad)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS m
    FROM domains GROUP BY suffix
)
{{levels}}, ruled AS (
    SELECT *,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM split
)
SELECT page_id, ruled.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN mean - {reputation.DEVIATIONS} * sqrt(mean * (1 - mean) / (s + n + 1)) > {reputation.LIMIT}
            THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN hosts_p ON ruled.host = hosts_p.host
"""


def _level(name: str, source: str) -> str:
    """SQL for the posterior of one level, given the parents' means as ``m``."""
    return f""", {name}_s AS (
    SELECT CASE WHEN sum(power(bad - n * m, 2) - n * m * (1 - m)) > 0
                THEN least(greatest(sum(n * (n - 1) * m * (1 - m))
                     / sum(power(bad - n * m, 2) - n * m * (1 - m)) - 1, {reputation.WEAKEST}), {reputation.STRONGEST})
                ELSE {reputation.STRONGEST} END AS s
    FROM ({source})
), {name}_p AS (
    SELECT *, (m * s + bad) / (s + n) AS mean FROM ({source}), {name}_s
)"""


_LEVELS = (
    _level("suffixes", "SELECT * FROM suffixes")
    + _level("domains", "SELECT d.*, p.mean AS m FROM domains d JOIN suffixes_p p USING (suffix)")
    + _level("hosts", "SELECT h.*, p.mean AS m FROM hosts h JOIN domains_p p USING (domain)")
)

_OP6_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {NEIGHBOURS}
"""

_OP9_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(role) + length(text) + {len(chat.OPEN) + 1 + len(chat.CLOSE)}
           + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g'))
           + length(regexp_replace(role, '[^\\\\<\\[\\n]', '', 'g')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP11_SQL = f"""
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), first AS (
    SELECT payload_digest, min(page_id) AS first_id FROM sized
    WHERE payload_bytes >= {warc.LEAST_SHARED} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM sized LEFT JOIN first USING (payload_digest)
"""

_OP13_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{collocations.NO_LANGUAGE}') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{reputation.UPPER}', '{reputation.LOWER}'),
                                        '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM split, (VALUES (1), (2), (3)) AS sizes(k)
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w
    FROM f WHERE k > 1 AND f >= {collocations.LEAST_COUNT}
), parts AS (
    SELECT lang, words, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, words)) AS cut FROM candidates)
), scored AS (
    SELECT p.lang, p.words, p.phrase, p.a, p.cut, l.f AS l, r.f AS r,
           CAST((1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = head JOIN f r ON r.lang = p.lang AND r.phrase = tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM candidates WHERE words = 3
    ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT s.* FROM lowest s LEFT JOIN longer g ON s.lang = g.lang AND s.phrase = g.phrase
      WHERE g.a IS NULL OR 100 * g.a < {collocations.SUBSUMED_PERCENT} * s.a) JOIN n USING (lang)
QUALIFY rank <= {collocations.BEST}
"""

ORACLES = {
    "op3_reputation": _OP3_SQL.replace("{levels}", _LEVELS),
    "op6_top_products": _OP6_SQL,
    "op9_chat": _OP9_SQL,
    "op11_warc": _OP11_SQL,
    "op13_collocations": _OP13_SQL,
}
