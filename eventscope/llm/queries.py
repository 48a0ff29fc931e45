"""Registration of the corpus operators: one query each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.llm import fill_middle, jaccard, language_id, mixing, near_dedup, page_text, quality_rules, secrets, sentencepiece_codec, site_quality, toxicity, url_filters, whitening
from eventscope.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures: the day of the fetch follows from the page's id."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.col("page_id") % 365, F.lit(0)).cast("int")))


def page_list(captures: DataFrame) -> DataFrame:
    """A dated block list derived from the captures: half of the domains are listed, some removed and listed again.

    All dates come from a digest of the domain, so that SQL can derive the same list.
    """
    domains = captures.select(F.regexp_replace(url_filters.host_of(F.col("url")), r"^(www|m)\.", "").alias("entry")).filter("entry is not null").distinct()
    made = domains.withColumn("h", F.md5("entry"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    first = F.date_add(F.lit("2023-12-01").cast("date"), (number(2, 3) % 300).cast("int"))
    gone = F.date_add(first, (F.lit(20) + number(5, 2) % 100).cast("int"))
    again = F.date_add(gone, (F.lit(10) + number(7, 2) % 60).cast("int"))
    event = lambda day, action, when: F.when(when, F.struct(day.alias("day"), F.lit(action).alias("action")))
    steps = F.array_compact(F.array(event(first, "add", F.lit(True)), event(gone, "remove", number(9, 1) % 2 == 0), event(again, "add", number(9, 1) % 4 == 0)))
    return made.filter(number(1, 1) < 8).select("entry", F.inline(steps))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    judged = url_filters.judge(captures, page_list(captures))
    return judged.select("page_id", "host", F.col("day").alias("fetched_on"), "blocked", "entry", "listed_on")


def tokenizer_model(path: str | None = None) -> bytes:
    """The tokenizer's file (about 0.5 MB), read by the driver and sent with the tasks."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, told = near_dedup.link(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumns({"recall": F.lit(float(told["recall"])), "n_queries": F.lit(told["n_queries"]).cast("long")})


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(read_table(spark, sf_dir, "documents"), tokenizer_model())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def sites_of(docs: DataFrame) -> DataFrame:
    """Documents have no address: the source stands for the host, source and language for the path."""
    return docs.withColumns({"host": F.col("source"), "path": F.concat_ws("/", "source", "lang")})


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sites_of(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    judged = site_quality.classify(docs, read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "p_document", "site_prior", "posterior", "accepted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read_table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_source_mix": op8_source_mix,
    "op9_language_id": op9_language_id,
    "op10_site_quality": op10_site_quality,
    "op11_whitening": op11_whitening,
    "op12_html_extraction": op12_html_extraction,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_SECRET_RULES = [(k, r.kind, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES)]


def _secret_sql() -> str:
    parts = []
    for k, kind, pattern, group, least in _SECRET_RULES:
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {k} AS ord, '{kind}' AS kind, unnest(list_zip(regexp_extract_all(t, '{p}', 0), regexp_extract_all(t, '{p}', {group}),
                regexp_split_to_array(t, '{p}')[1:-2], range(1, len(regexp_extract_all(t, '{p}', 0)) + 1))) AS m, {least} AS least
              FROM d WHERE regexp_matches(t, '{p}')"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      m AS ({" UNION ALL ".join(parts)}),
      s AS (SELECT doc_id, ord, kind, least, length(m[1]) AS n, length(m[2]) AS v, m[4] AS i,
              sum(length(m[3]) + length(m[1])) OVER (PARTITION BY doc_id, ord ORDER BY m[4]) AS e FROM m),
      k AS (SELECT doc_id, ord, kind, (e - n)::BIGINT AS b, e::BIGINT AS e FROM s WHERE v >= least),
      g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
              coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 3), '') AS base,
              string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans FROM k GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def _quality_sql() -> str:
    fails = {
        r.rule: " OR ".join([f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)) for r in quality_rules.RULES
    }
    names = ", ".join(f"CASE WHEN {f} THEN '{rule}' END" for rule, f in fails.items())
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
      win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
      key AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM win),
      rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM key) WHERE c > 1),
      cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
      l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
      m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
              len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
              coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
              len(list_filter(ws, lambda x: list_contains([{stop}], lower(x))))::DOUBLE AS n_stop
            FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
      r AS (SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio,
              coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
              n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
      f AS (SELECT *, concat_ws(',', {names}) AS failed_rules FROM r)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


_URL_SQL = r"""WITH c AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
        DATE '2024-01-01' + coalesce(page_id % 365, 0)::INT AS day FROM pages),
      n AS (SELECT entry, md5(entry) AS h FROM (SELECT DISTINCT regexp_replace(host, '^(www|m)\.', '') AS entry FROM c WHERE host IS NOT NULL)),
      x AS (SELECT entry, ('0x' || h[1:1])::INT AS a, ('0x' || h[2:4])::INT % 300 AS b, 20 + ('0x' || h[5:6])::INT % 100 AS g, 10 + ('0x' || h[7:8])::INT % 60 AS r, ('0x' || h[9:9])::INT AS z FROM n),
      iv AS (SELECT entry, DATE '2023-12-01' + b AS f, CASE WHEN z % 2 = 0 THEN DATE '2023-12-01' + (b + g) END AS t FROM x WHERE a < 8
        UNION ALL SELECT entry, DATE '2023-12-01' + (b + g + r), NULL FROM x WHERE a < 8 AND z % 4 = 0),
      hit AS (SELECT c.page_id, arg_max(iv.entry, length(iv.entry)) AS entry, arg_max(iv.f, length(iv.entry)) AS listed_on FROM c JOIN iv
        ON (c.host = iv.entry OR ends_with(c.host, '.' || iv.entry)) AND iv.f <= c.day AND (iv.t IS NULL OR c.day < iv.t) GROUP BY c.page_id)
      SELECT c.page_id, c.host, c.day AS fetched_on, hit.entry IS NOT NULL AS blocked, hit.entry, hit.listed_on FROM c LEFT JOIN hit ON c.page_id = hit.page_id"""

_MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
      s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
      w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size::DOUBLE AS cap FROM s),
      o AS (SELECT *, cap / weight AS level, sum(source_size) OVER () * 1.5 AS share FROM w),
      q AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS filled,
              sum(weight) OVER (ORDER BY level RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
      l AS (SELECT max(CASE WHEN (share - filled)::DOUBLE / rest <= level THEN (share - filled)::DOUBLE / rest END) AS level FROM q),
      t AS (SELECT source, source_size, least(cap, weight * l.level) AS target FROM w, l),
      r AS (SELECT *, coalesce(target / nullif(source_size::DOUBLE, 0), 0) AS rate FROM t)
      SELECT d.doc_id, d.size, r.source_size, r.target,
        (size * (floor(rate) + (('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null') || ':8')[1:13])::BIGINT::DOUBLE / 4503599627370496 < rate - floor(rate))::INT))::BIGINT AS taken,
        (floor(rate) + (('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null') || ':8')[1:13])::BIGINT::DOUBLE / 4503599627370496 < rate - floor(rate))::INT)::BIGINT AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""

_JACCARD_SQL = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      s AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS k FROM w)),
      n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
      r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
      m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

#: On tables as small as those that SQL is held against, every vector is a query of the audit, and the graph has every link.
_EMBEDDING_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
      r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
      c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
      n AS (SELECT x, count(DISTINCT y) AS n FROM l GROUP BY x)
      SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept, 1.0::DOUBLE AS recall, (SELECT count(DISTINCT e) FROM v)::BIGINT AS n_queries FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""

#: The pages of the tables all hold one article without lists of links, so nothing is left to their nearest pages.
_PAGES_SQL = r"""WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
      m AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(?:p|br|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM p),
      r AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM m),
      s AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x85\xA0\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM r)
      SELECT page_id, url, text, length(text)::BIGINT AS n_chars, 0::BIGINT AS n_deleted FROM s"""

_MIDDLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
      u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
      k AS (SELECT *, len(u)::BIGINT AS n, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS q FROM u),
      c AS (SELECT *, least(q[1] % (n + 1), q[2] % (n + 1)) AS a, greatest(q[1] % (n + 1), q[2] % (n + 1)) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR q[3] % 100 >= 90 THEN 'plain' WHEN q[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
      x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
      SELECT doc_id, n, form, (CASE WHEN form <> 'plain' THEN length(p) END)::BIGINT AS prefix_chars, (CASE WHEN form <> 'plain' THEN length(m) END)::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op2_quality_rules": _quality_sql(),
    "op4_url_filter": _URL_SQL,
    "op5_embedding_dedup": _EMBEDDING_SQL,
    "op7_ngram_jaccard": _JACCARD_SQL,
    "op8_source_mix": _MIX_SQL,
    "op12_html_extraction": _PAGES_SQL,
    "op13_fill_in_middle": _MIDDLE_SQL,
}
