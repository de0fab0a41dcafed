"""The thin queries over the given tables; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, dedup, divergence, flac, html, language, lm, mixing, prefix_trie, quality, secrets, tokens
from .shared import crc_bucket, table


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mixing.copies(docs)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = lm.split(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = lm.score_texts(docs, train, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.train_labels(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    model = chat.fit(chat.training_rows(talks))
    parsed = chat.parse_transcripts(talks.select("conv_id", "turn", "text"), model)
    return parsed.select("conv_id", "turn", "segment", (crc_bucket("conv_id", 5) == 0).alias("held_out"), "said", "rendered")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixing": op1_cube_mixing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_files": op4_token_files,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_flac_media": op9_flac_media,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_id": op13_language_id,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: crc32 of the decimal c: eight shifts for each digit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || flatten([[256 + unicode(a), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] FOR a IN string_split(c::VARCHAR, '')]), lambda acc, y: CASE WHEN y >= 0 THEN xor(acc, y - 256) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)"

ORACLES: dict[str, str] = {
    "op6_benchmark_decontamination": f"""WITH it AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
      win AS (SELECT DISTINCT item, w[s:least(s+9,len(w))] AS k FROM (SELECT item, w, unnest(range(1, greatest(2, len(w)-8))) AS s FROM it WHERE len(w)>0)),
      sizes AS (SELECT DISTINCT len(k) AS n FROM win), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      g AS (SELECT doc_id, n, w[s:s+n-1] AS k, s FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS s FROM d, sizes WHERE len(w)>=n)),
      hit AS (SELECT DISTINCT doc_id, item, s, n FROM g JOIN win USING (k)),
      pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s+n)) AS p FROM hit) GROUP BY doc_id),
      its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
      SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
      FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_source_divergence": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source, coalesce(text,'') AS text FROM documents),
      t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
      k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
      lv AS (SELECT lang, sum(ln) AS n, count(*) AS v FROM k GROUP BY lang),
      c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, source, term),
      g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(lv.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) LEFT JOIN lv USING (lang)),
      p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 5)) // (lv.n + 5 * lv.v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN lv ON lv.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
      s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
      x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
      SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x) WHERE part = 'pair' OR rank <= 50""",
    "op12_prefix_trie": f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r)||':'||r||x)) AS a, r, x
        FROM (SELECT conv_id, turn, coalesce(role,'') AS r, coalesce(text,'') AS x FROM conversations)),
      o AS (SELECT c, c - c % 5 AS f, {_CRC} % 9 AS h, count(*) AS own FROM t GROUP BY c),
      k AS (SELECT o.c, o.f, o.h, least(o.h, coalesce(b.own, 0)) AS taken FROM o LEFT JOIN o b ON b.c = o.f),
      r AS (SELECT k.c, t.a AS p, r, x FROM k JOIN t ON t.c = k.f AND t.a <= k.h
        UNION ALL SELECT k.c, k.taken + t.a - k.h, r, x FROM k JOIN t ON t.c = k.c AND t.a > k.h),
      l AS (SELECT k.c, list(md5(strlen(r)||':'||r||x) ORDER BY p) FILTER (p IS NOT NULL) AS s, list(strlen(x) ORDER BY p) FILTER (p IS NOT NULL) AS z FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
      m AS (SELECT c, coalesce(s, []) AS s, coalesce(z, []) AS z, coalesce(len(s), 0) AS n FROM l),
      e AS (SELECT c, n, d, array_to_string(s[1:d], '') AS u, array_to_string(s[1:d-1], '') AS v, CASE WHEN d > 0 THEN z[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM m)),
      g AS (SELECT d, u, any_value(v) AS v, min(c) AS conv, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM e GROUP BY d, u),
      w AS (SELECT d, v, count(*) AS n FROM g WHERE d > 0 GROUP BY d, v),
      q AS (SELECT g.*, coalesce(w.n, 0) AS n_children FROM g LEFT JOIN w ON w.d = g.d + 1 AND w.v = g.u),
      y AS (SELECT above, u, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT unnest(range(0, d + 1)) AS above, u AS full_u, (n_children = 0)::INT AS leaf, (n_convs - 1) * b AS saved, u[1:32*above] AS u FROM q) GROUP BY above, u)
      SELECT q.conv AS conv_id, q.d AS depth, p.conv AS parent_conv_id, q.n_convs, q.n_children, y.n_leaves::BIGINT AS n_leaves, y.saved::BIGINT AS saved_tokens, sha256(q.ends) AS ends_sha256
      FROM q JOIN y ON y.above = q.d AND y.u = q.u LEFT JOIN g p ON p.d = q.d - 1 AND p.u = q.v""",
}
