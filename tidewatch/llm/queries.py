"""The queries of this subpackage: thin digests of the operators' real outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    decontaminate, fill_middle, html_extract, licenses, merkle, near_join, pieces, pii, quality, substring_dedup, suffix_dedup, token_counts, whitening,
)  # fmt: skip
from tidewatch.llm.base import table, text_of

PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")  # noqa: E731
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that holds a benchmark item: doc_id, n_hits, hits (item:start:end:edits, comma-joined)."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter(F.size("hits") > 0)
    row = lambda h: F.concat_ws(":", *[h[c].cast("string") for c in ("item_id", "start", "end", "edits")])  # noqa: E731
    return found.select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(F.transform("hits", row), ",").alias("hits"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )  # fmt: skip


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared", "longest_shared")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_licenses, licenses (template:start:end:coverage in thousandths, comma-joined)."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    row = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.floor(m["coverage"] * 1000).cast("string"))  # noqa: E731
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(F.transform("licenses", row), ",").alias("licenses"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.octet_length(text_of()).cast("bigint"))
    return token_counts.count_tokens(docs, tokenizer_path(WORD_MODEL), keep=("doc_id", "n_bytes")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.compared(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("key").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", *[F.coalesce(F.col(f"edit.{x}"), F.lit(-1)).alias(f"edit_{x}") for x in ("section", "paragraph")],
    )  # fmt: skip


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    back = fill_middle.restore(made, keep=(*columns, "output"))
    return back.select(*columns, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("residual", "passes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_substring_dedup, op3_decontamination, op4_sentencepiece, op5_suffix_dedup,
        op6_quality_rules, op7_near_join, op8_license_scan, op9_token_counts, op10_html_extract,
        op11_fingerprints, op12_fill_middle, op13_whitening,
    )
}  # fmt: skip

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS gram FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
), m AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM m) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source),
p AS (
  SELECT avg(failed / n) AS m, CASE WHEN var_pop(failed / n) <= 1e-12 THEN 1e6
    ELSE greatest(1.0, least(1e6, avg(failed / n) * (1 - avg(failed / n)) / var_pop(failed / n) - 1)) END AS weight FROM h
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((h.failed + m * weight) / (h.n + weight) > 0.9) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p
"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
dup AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM dup, unnest(range(0, 20)) AS u(k)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * shared >= 4 * (a.n + b.n)),
r(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, link.y FROM r JOIN link ON r.y = link.x)
SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM r WHERE x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM link WHERE x = doc_id) AS n_links FROM documents
"""

_PARAGRAPHS = r"regexp_extract_all(t, '[^.!?\n]{1,64}[^.!? \t\n\x0B\f\r]{0,32}[.!? \t\n\x0B\f\r]{0,64}|[.!? \t\n\x0B\f\r]{1,64}')"

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt, length(t) // 4 AS q
  FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (
  SELECT doc_id, kind, t, ps, len(ps) AS n,
    CASE WHEN len(ps) <= 64 AND len(regexp_extract_all(t, '[^ 	

]+')) <= 64
      THEN list_transform(regexp_extract_all(t, '[^ 	

]+'), lambda w: left(md5(w), 8)) ELSE [] END AS words,
    CASE WHEN length(t) BETWEEN 1 AND 48 THEN list_transform(range(1, greatest(1, length(t) - 1) + 1), lambda i: left(md5(substring(t, i, 2)), 8)) ELSE [] END AS pairs
  FROM (SELECT doc_id, kind, t, {_PARAGRAPHS} AS ps FROM (
    SELECT doc_id, 0 AS kind, t FROM n UNION ALL SELECT doc_id, 1, substring(t, 1, length(t) - q) || substring(nt, 1, q) FROM n))
),
p AS (SELECT doc_id, kind, n, i, ps[i] AS p, sha256(ps[i]) AS node FROM x, unnest(range(1, n + 1)) AS u(i)),
g AS (SELECT *, coalesce(sum((left(node, 1) IN ('0', '8') OR contains(p, chr(10) || chr(10)))::INT)
  OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p),
c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, kind, g ORDER BY i) - 1) // 32 AS c FROM g),
s AS (SELECT doc_id, kind, n, min(i) AS pos, sha256(string_agg(node, '' ORDER BY i)) AS node, list(left(node, 8) ORDER BY i) AS below FROM c GROUP BY doc_id, kind, n, g, c),
f AS (
  SELECT doc_id, kind, sha256(string_agg(node, '' ORDER BY pos)) AS root, list(left(node, 8) ORDER BY pos) AS sections,
    CASE WHEN n <= 256 THEN flatten(list(below ORDER BY pos)) ELSE [] END AS paragraphs, list(CASE WHEN n <= 256 THEN below ELSE NULL END ORDER BY pos) AS below,
    list(left(node, 8) || CASE WHEN n <= 256 THEN ':' || array_to_string(below, '.') ELSE '' END ORDER BY pos) AS printed
  FROM s GROUP BY doc_id, kind, n
),
w AS (
  SELECT x.doc_id, x.kind, x.t, coalesce(root, sha256('')) AS root, coalesce(sections, []) AS sections, coalesce(paragraphs, []) AS paragraphs, coalesce(below, []) AS below,
    coalesce(printed, []) AS printed, words, pairs,
    coalesce(root, sha256('')) || '/' || coalesce(array_to_string(printed, ','), '') || '/' || coalesce(array_to_string(words, '.'), '') || '/' || coalesce(array_to_string(pairs, '.'), '') AS fingerprint
  FROM x LEFT JOIN f USING (doc_id, kind)
),
two AS (
  SELECT a.doc_id, 'edited' AS how, a.root AS ra, b.root AS rb, a.pairs AS pa, b.pairs AS pb, a.words AS wa, b.words AS wb, a.paragraphs AS ga, b.paragraphs AS gb, a.sections AS sa, b.sections AS sb
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1
  UNION ALL SELECT a.doc_id, 'next', a.root, b.root, a.pairs, b.pairs, a.words, b.words, a.paragraphs, b.paragraphs, a.sections, b.sections
  FROM n JOIN w a ON n.doc_id = a.doc_id AND a.kind = 0 JOIN w b ON n.next_id = b.doc_id AND b.kind = 0
),
level AS (
  SELECT doc_id, how, ra = rb AS same,
    CASE WHEN len(pa) > 0 AND len(pb) > 0 THEN pa WHEN len(wa) > 0 AND len(wb) > 0 THEN wa WHEN len(ga) > 0 AND len(gb) > 0 THEN ga ELSE sa END AS a,
    CASE WHEN len(pa) > 0 AND len(pb) > 0 THEN pb WHEN len(wa) > 0 AND len(wb) > 0 THEN wb WHEN len(ga) > 0 AND len(gb) > 0 THEN gb ELSE sb END AS b
  FROM two
),
ca AS (SELECT doc_id, how, v, count(*) AS k FROM (SELECT doc_id, how, unnest(a) AS v FROM level) GROUP BY ALL),
cb AS (SELECT doc_id, how, v, count(*) AS k FROM (SELECT doc_id, how, unnest(b) AS v FROM level) GROUP BY ALL),
sh AS (SELECT doc_id, how, sum(least(ca.k, cb.k)) AS k FROM ca JOIN cb USING (doc_id, how, v) GROUP BY ALL),
near AS (
  SELECT doc_id, how, CASE WHEN same THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(k, 0)::DOUBLE / (len(a) + len(b))::DOUBLE END AS near
  FROM level LEFT JOIN sh USING (doc_id, how)
),
e AS (
  SELECT a.doc_id, a.below AS ba, b.below AS bb, CASE WHEN a.root <> b.root THEN coalesce(
    list_filter(range(1, len(a.printed) + 1), lambda i: a.printed[i] IS DISTINCT FROM b.printed[i])[1], len(a.printed) + 1) END AS pos
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1
)
SELECT a.doc_id, length(a.t)::BIGINT AS n_chars, sha256(b.t) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, x.near AS near_edited, y.near AS near_next,
  coalesce(e.pos - 1, -1)::INT AS edit_section, CASE WHEN ba[e.pos] IS NOT NULL AND bb[e.pos] IS NOT NULL THEN
    coalesce(list_filter(range(1, len(ba[e.pos]) + 1), lambda i: ba[e.pos][i] IS DISTINCT FROM bb[e.pos][i])[1] - 1, len(ba[e.pos]))::INT ELSE -1 END AS edit_paragraph
FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1 JOIN near x ON x.doc_id = a.doc_id AND x.how = 'edited' JOIN near y ON y.doc_id = a.doc_id AND y.how = 'next' JOIN e ON e.doc_id = a.doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents
), r AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r
), x AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL, "op6_quality_rules": OP6_SQL, "op7_near_join": OP7_SQL, "op11_fingerprints": OP11_SQL, "op12_fill_middle": OP12_SQL,
}  # fmt: skip
