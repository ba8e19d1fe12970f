"""Text, URL and redaction queries (X*, T*, H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import spread, table
from newsloom.functions import pii, text as t, url as u
from newsloom.operators import patterns

from .registry import query

TITLE = "<title[^>]*>([^<]*)</title>"
HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower({HOST}) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g') AS path,
      list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=') AND lower(string_split(x, '=')[1]) NOT IN ({', '.join(f"'{x}'" for x in u.TRACKING)}))) AS q FROM pages)
    SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")
def x1_canonical_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", u.canonical(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/haber/(\d+)(?:\.html?)?(?:/|\?|$)', 1), ''), nullif(regexp_extract(url, '\b(\d{6,})(?:\.html?)?(?:/|\?|$)', 1), '')) AS external_id FROM pages")
def x2_external_id(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", u.external_id(F.col("url")).alias("external_id"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '/video/1' WHEN 1 THEN replace(url, '.com/', '.com/LIVE-blog/') ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/live-blog/') THEN 'live-blog' WHEN regexp_matches(url, '(?i)/canli-(?:blog|haber|yayin|takip)/') THEN 'canli-blog'
      WHEN regexp_matches(url, '(?i)/canli-(?:altin|doviz|borsa|petrol|skor)') THEN 'canli-veri' WHEN regexp_matches(url, '(?i)/video/') THEN 'video' END AS reason FROM p""")
def x3_skip_discovery(spark, sf_dir):
    k = F.col("page_id") % 5
    p = pages(spark, sf_dir).withColumn("url", F.when(k == 0, F.concat("url", F.lit("/video/1"))).when(k == 1, F.replace("url", F.lit(".com/"), F.lit(".com/LIVE-blog/"))).otherwise(F.col("url")))
    return p.select("page_id", u.skip_reason(F.col("url")).alias("reason"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN substr(url, 8) WHEN 2 THEN 'http:///x' ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN trim(url) = '' THEN 'empty' WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'no_scheme' WHEN regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) = '' THEN 'no_hostname' ELSE 'ok' END AS validity FROM p""")
def x4_url_validity(spark, sf_dir):
    k = F.col("page_id") % 4
    c = F.when(k == 0, "").when(k == 1, F.substring("url", 8, 1000)).when(k == 2, "http:///x").otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", u.validity(c).alias("validity"))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1] AS s FROM pages)
    SELECT page_id, substr(trim(regexp_replace(regexp_replace(s, '(,\d+|-[0-9a-f]{8})$', ''), '[-_]+', ' ', 'g')), 1, 200) AS title FROM p""")
def x5_provisional_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", u.provisional_title(F.col("url")).alias("title"))


@query("SELECT n_nationkey, i AS page, 'http://h/' || n_name || '?page=' || i AS url FROM nation CROSS JOIN range(1, 6) r(i)")
def sc5_page_urls(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(u.page_urls(F.concat(F.lit("http://h/"), "n_name", F.lit("?page=9")), "page")).alias("i", "url"))
    return n.select("n_nationkey", (F.col("i") + 1).cast("long").alias("page"), "url")


SQUEEZED = r"trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(f"SELECT doc_id AS id, sha256({SQUEEZED}) AS content_hash, CAST(floor(len(list_filter(string_split({SQUEEZED}, ' '), lambda w: w <> '')) * 1.3) AS INTEGER) AS tokens FROM documents")
def t6_content_hash(spark, sf_dir):
    """T6 and T8."""
    return docs(spark, sf_dir).select("id", t.content_hash(F.col("text")).alias("content_hash"), t.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH h AS (SELECT doc_id AS id, source, sha256({SQUEEZED}) AS content_hash FROM documents) SELECT id, source, content_hash FROM h QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY id) = 1""")
def x7_deduplicate(spark, sf_dir):
    from newsloom.operators.ingest import deduplicate

    d = docs(spark, sf_dir).select("id", "source", t.content_hash(F.col("text")).alias("content_hash"), F.concat(F.lit("u"), "id").alias("canonical_url"), F.lit(None).cast("string").alias("external_id"))
    return deduplicate(d, ["id"]).select("id", "source", "content_hash")


EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IBAN = r"\bTR\d{2}(?:\s?\d{4}){5}\s?\d{2}\b|\bTR\d{24}\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
SPACE = r"[\s\x0B\x85\p{Z}]"
#: The last stage's pattern looks around itself, which this SQL can't: instead the text gets one mark after whatever is no digit (and at
#: the start) and another before it (and at the end); between the pattern's characters there may be marks, which are taken out afterwards.
AFTER, BEFORE = "\ue000", "\ue001"
PHONE = f"{AFTER}@(?:\\+@9@0@|0@)?(?:(?:{SPACE}|-)@)*(?:\\(@)?(?:\\p{{Nd}}@){{3}}(?:\\)@)?(?:(?:{SPACE}|-)@)*(?:\\p{{Nd}}@){{3}}(?:(?:{SPACE}|-)@)*(?:\\p{{Nd}}@){{2}}(?:(?:{SPACE}|-)@)*\\p{{Nd}}@\\p{{Nd}}{BEFORE}".replace("@", f"[{AFTER}{BEFORE}]*")
MARKED = f"'{AFTER}' || regexp_replace(regexp_replace(text, '(\\P{{Nd}})', '\\1{AFTER}', 'g'), '([^\\p{{Nd}}{AFTER}])', '{BEFORE}\\1', 'g') || '{BEFORE}'"
#: All stages of ``r0`` (key, text): r5 after the first five, r6 after the last.
REDACTED_SQL = ", ".join(
    f"r{i + 1} AS (SELECT * REPLACE (regexp_replace(text, '{p}', '[{m}_redacted]', 'g') AS text), len(regexp_extract_all(text, '{p}')) AS {n} FROM r{i})"
    for i, (n, p, m) in enumerate((("email", EMAIL, "email"), ("iban", IBAN, "iban"), ("uuid", UUID, "ref"), ("ip", IP, "ip")))
) + """, ids AS (SELECT *, list_filter(regexp_extract_all(text, '\\b\\d{11}\\b'), lambda s: s[1] <> '0'
        AND ((s[1]::INT + s[3]::INT + s[5]::INT + s[7]::INT + s[9]::INT) * 7 - (s[2]::INT + s[4]::INT + s[6]::INT + s[8]::INT)) % 10 = s[10]::INT
        AND (s[1]::INT + s[2]::INT + s[3]::INT + s[4]::INT + s[5]::INT + s[6]::INT + s[7]::INT + s[8]::INT + s[9]::INT + s[10]::INT) % 10 = s[11]::INT) AS valid FROM r4),
    r5 AS (SELECT * EXCLUDE (valid) REPLACE (list_reduce(list_prepend(text, valid), lambda a, i: replace(a, i, '[id_redacted]')) AS text), len(valid) AS tc FROM ids)"""
REDACTED_SQL += f""", marked AS (SELECT *, {MARKED} AS m FROM r5),
    r6 AS (SELECT * EXCLUDE (m) REPLACE (translate(regexp_replace(m, '{PHONE}', '[phone_redacted]', 'g'), '{AFTER}{BEFORE}', '') AS text), len(regexp_extract_all(m, '{PHONE}')) AS phone FROM marked)"""


@query(f"WITH r0 AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {REDACTED_SQL} SELECT id, sha256(text) AS redacted, email, iban, uuid, ip, tc FROM r5")
def t2_redaction_counts(spark, sf_dir):
    """The text after the first five stages, and their counts."""
    r = docs(spark, sf_dir).select("id", pii.redact(F.col("text"), pii.STAGES[:5]).alias("r"))
    return r.select("id", F.sha2("r.text", 256).alias("redacted"), "r.email", "r.iban", "r.uuid", "r.ip", "r.tc")


@query(f"WITH r0 AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {REDACTED_SQL} SELECT id, sha256(text) AS redacted, email, iban, uuid, ip, tc, phone FROM r6")
def t2_redacted(spark, sf_dir):
    """All six stages."""
    return docs(spark, sf_dir).select("id", pii.redact(F.col("text")).alias("r")).select("id", F.sha2("r.text", 256).alias("redacted"), *(f"r.{n}" for n, _, _ in pii.STAGES))


@query("""WITH d AS (SELECT DISTINCT l_orderkey * 97003 + 10000000000 AS n FROM lineitem), x AS (SELECT n::VARCHAR AS s, list_transform(string_split(n::VARCHAR, ''), lambda c: c::INTEGER) AS d FROM d)
    SELECT s, d[1] <> 0 AND len(d) = 11 AND ((d[1]+d[3]+d[5]+d[7]+d[9]) * 7 - (d[2]+d[4]+d[6]+d[8])) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS valid FROM x""")
def t3_national_id(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 97003 + 10000000000).cast("string").alias("s")).distinct()
    return n.select("s", pii.valid_national_id(F.col("s")).alias("valid"))


@query(f"""WITH r0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), {REDACTED_SQL}
    SELECT conv_id, turn, role, sha256(text) AS redacted, email + iban + uuid + ip + tc + phone AS n FROM r6""")
def t4_message_redaction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", pii.redact(F.col("text")).alias("r"))
    return c.select("conv_id", "turn", "role", F.sha2("r.text", 256).alias("redacted"), sum(F.col(f"r.{n}") for n, _, _ in pii.STAGES).alias("n"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM part")
def t19_cluster_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.kebab(F.concat_ws(" ", "p_brand", "p_type")).alias("key"))


GRAMS_SQL = " UNION ALL ".join(f"SELECT p_partkey, i AS pos, {n} AS n, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT p_partkey, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)" for n in (1, 2, 3))


@query(f"""WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), g AS ({GRAMS_SQL}), o AS (SELECT p_partkey, g, min(n * 1000 + pos) AS k FROM g GROUP BY ALL),
    c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) <= 60) SELECT p_partkey, string_agg(g, '|' ORDER BY k) AS grams FROM c GROUP BY 1""")
def t17_query_grams(spark, sf_dir):
    """Runs of one to three words, distinct, shorter ones first, at most 60."""
    g = F.slice(t.ngrams(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), 1, 3), 1, 60)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(g, "|").alias("grams"))


TRI = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(f"""WITH p AS (SELECT p_partkey, {TRI.format("p_name")} AS a, {TRI.format("p_type")} AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM p""")
def p3_trigram_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(t.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(f"""WITH t AS (SELECT DISTINCT regexp_extract(html, '{TITLE}', 1) AS title FROM pages), g AS (SELECT title, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda z: z <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM t)
    SELECT a.title AS title, b.title AS other, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.title < b.title
    WHERE len(list_intersect(a.g, b.g))::DOUBLE / nullif(len(list_distinct(list_concat(a.g, b.g))), 0) >= 0.3""")
def p3_similar_titles(spark, sf_dir):
    """All pairs of different titles that are alike by 0.3 or more."""
    titles = pages(spark, sf_dir).select(F.regexp_extract("html", TITLE, 1).alias("id")).distinct().select("id", t.trigrams(F.col("id")).alias("grams"))
    pairs = patterns.similar(titles, titles, 0.3, F.col("left_id") < F.col("right_id"))
    return pairs.select(F.col("left_id").alias("title"), F.col("right_id").alias("other"), F.round("similarity", 6).alias("similarity"))


@query("SELECT c_custkey, levenshtein(c_name, c_mktsegment) AS distance, round(levenshtein(c_name, c_mktsegment)::DOUBLE / greatest(length(c_name), length(c_mktsegment)), 6) AS normalized FROM customer")
def t23_levenshtein(spark, sf_dir):
    a, b = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(t.normalized_levenshtein(a, b), 6).alias("normalized"))


def _repaired_sql(text: str) -> str:
    for word, (left, right) in t.CITATIONS:
        text = f"regexp_replace({text}, '(?i)\\{left}{SPACE}*{word}{SPACE}*[:.\\-]?{SPACE}*(\\d+){SPACE}*\\{right}', '[#\\1]', 'g')"
    return text


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '[.]', CASE doc_id % 5 WHEN 0 THEN ' ( ID: ' || doc_id || ').' WHEN 1 THEN ' [Kaynak ' || doc_id || ' ].' WHEN 2 THEN ' (ref.' || doc_id || ') [REF 7].' WHEN 3 THEN ' [Source-' || doc_id || '].' ELSE ' (source 1) [' || doc_id || '].' END, 'g') AS text FROM documents),
    r AS (SELECT id, {_repaired_sql("text")} AS text FROM d) SELECT id, sha256(text) AS repaired, len(regexp_extract_all(text, '\\[#\\d+\\]'))::INTEGER AS n FROM r""")
def t27_citation_repair(spark, sf_dir):
    """Every full stop of the documents after a citation spoiled in one of several ways; a number alone in brackets is no citation, nor is a source in round ones."""
    n, k = F.col("id").cast("string"), F.col("id") % 5
    said = (
        F.when(k == 0, F.concat(F.lit(" ( ID: "), n, F.lit(")."))).when(k == 1, F.concat(F.lit(" [Kaynak "), n, F.lit(" ]."))).when(k == 2, F.concat(F.lit(" (ref."), n, F.lit(") [REF 7].")))
        .when(k == 3, F.concat(F.lit(" [Source-"), n, F.lit("]."))).otherwise(F.concat(F.lit(" (source 1) ["), n, F.lit("].")))
    )
    r = docs(spark, sf_dir).select("id", t.repair_citations(F.regexp_replace("text", F.lit("[.]"), said)).alias("text"))
    return r.select("id", F.sha2("text", 256).alias("repaired"), F.regexp_count("text", F.lit(r"\[#\d+\]")).alias("n"))


@query(r"""WITH d AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '([0-9]+(?:-[0-9]+)?)', '[#\1, W7]', 'g') || '[' || doc_id || '-' || doc_id + doc_id % 150 || ']' AS text FROM documents),
    p AS (SELECT id, unnest(flatten(list_transform(regexp_extract_all(text, '\[#?W?(\d+(?:\s*[-,]\s*#?W?\d+)*)\]', 1), lambda s: string_split(regexp_replace(s, '[#W\s]', '', 'g'), ',')))) AS p FROM d),
    e AS (SELECT id, try_cast(split_part(p, '-', 1) AS INTEGER) AS a, try_cast(split_part(p, '-', -1) AS INTEGER) AS b FROM p),
    n AS (SELECT DISTINCT id, unnest(CASE WHEN b >= a AND b - a < 100 THEN range(a, b + 1) ELSE [a] END) AS n FROM e WHERE a IS NOT NULL)
    SELECT id, string_agg(n, ',' ORDER BY n) AS cited FROM n GROUP BY 1""")
def t28_cited_numbers(spark, sf_dir):
    """Every number of the documents' texts, and every pair joined by a hyphen, as a citation, with a range of the document's own at the end."""
    n = F.col("id")
    own = F.concat(F.lit("["), n, F.lit("-"), n + n % 150, F.lit("]"))
    s = F.concat(F.regexp_replace("text", "([0-9]+(?:-[0-9]+)?)", r"[#$1, W7]"), own)
    return docs(spark, sf_dir).select("id", F.array_join(F.transform(t.cited_numbers(s), lambda x: x.cast("string")), ",").alias("cited"))


LOWER_SQL = "lower(replace({}, 'İ', 'i̇'))"  # as Unicode's full mapping has it
QUOTES_SQL = t.QUOTES.replace("'", "''")


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages UNION ALL SELECT -doc_id, coalesce(text, '') FROM documents)
    SELECT page_id, sha256(trim(regexp_replace(translate({LOWER_SQL.format("title")}, '{QUOTES_SQL}', ''), '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g'))) AS folded FROM p""")
def t14_normalized_query(spark, sf_dir):
    """Titles of all pages, and whole texts under negative numbers."""
    p = pages(spark, sf_dir).select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"))
    p = p.union(docs(spark, sf_dir).select(-F.col("id"), "text"))
    return p.select("page_id", F.sha2(t.normalize_query(F.col("title")), 256).alias("folded"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages),
    q AS (SELECT page_id, trim(trim(regexp_replace({LOWER_SQL.format("title")}, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')), ' .,;:!?-"' || chr(39)) AS title FROM p) SELECT page_id, title, sha256(title) AS title_hash FROM q""")
def t6_title_hash(spark, sf_dir):
    title = F.regexp_extract("html", TITLE, 1)
    return pages(spark, sf_dir).select("page_id", t.normalize_title(title).alias("title"), t.title_hash(title).alias("title_hash"))


ABBREVIATIONS_SQL = "|".join(t.ABBREVIATIONS)


@query(f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), s AS (SELECT id, regexp_replace(regexp_replace(text, '^[\\s\\x0B\\x85\\p{{Z}}]+|[\\s\\x0B\\x85\\p{{Z}}]+$', '', 'g'), '([.!?])[\\s\\x0B\\x85\\p{{Z}}]+([{t.CAPITALS}])', '\\1' || chr(1) || '\\2', 'g') AS text FROM d),
    j AS (SELECT id, regexp_replace(text, '(^|[^{t.LETTERS}])((?:{ABBREVIATIONS_SQL})[^{t.LETTERS}\\s\\x01]*)\\x01', '\\1\\2 ', 'g') AS text FROM s)
    SELECT id, len(list_filter(string_split(text, chr(1)), lambda x: x <> ''))::INTEGER AS n, sha256(text) AS cut FROM j""")
def t10_citation_sentences(spark, sf_dir):
    s = docs(spark, sf_dir).select("id", t.citation_sentences(F.col("text")).alias("s"))
    return s.select("id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\x01"), 256).alias("cut"))


@query()
def t11_chunks(spark, sf_dir):
    """Sentence-window chunks of every document under its source and language as titles. No SQL for the fold; ``test_chunks_of_all_documents``
    holds it against plain loops."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    return d.select("id", F.inline(t.chunk(F.col("text"), title=F.col("source"), subtitle=F.col("lang"))))


@query()
def t1_clean(spark, sf_dir):
    """The whole cleaning chain."""
    from newsloom.operators.ingest import clean

    return clean(docs(spark, sf_dir))


def _spans_sql() -> str:
    each = (f"list_filter(list_transform(regexp_extract_all(text, '{'' if i in t.CASED else '(?i)'}{p}')[1:5], lambda s: trim(s)), lambda s: length(s) BETWEEN 2 AND 60)" for i, p in enumerate(t.NUMERIC))
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), f AS (SELECT id, flatten([{", ".join(each)}]) AS f FROM d),
        k AS (SELECT id, f, list_transform(f, lambda s: regexp_replace(lower(s), '\\s+', ' ', 'g')) AS k FROM f)
        SELECT id, array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda i: list_position(k, k[i]) = i), lambda i: f[i]), '|') AS spans FROM k"""


@query(_spans_sql())
def t22_numeric_spans(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.array_join(t.numeric_spans(F.col("text")), "|").alias("spans"))


@query(r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS n, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS body FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(title, '(?i)sayfa\s*bulunamad[ıi]|page\s*not\s*found|hata\s*404|404\s*[-—|:]\s*(?:sayfa|page|hata|error|not)|içerik\s*bulunamad[ıi]|haber\s*bulunamad[ıi]|aradığınız\s*sayfa') OR regexp_matches(substr(html, 1, 2000), '(?is)aradığınız\s*sayfa.*bulunam|this\s*page\s*does\s*not\s*exist|sorry.*we\s*can[’'']t\s*find') THEN 'soft_404' WHEN length(html) = 0 THEN 'empty_body' WHEN n = 0 THEN 'no_paragraphs' WHEN body < 200 THEN 'short_text'
      WHEN length(html) > 5000 AND body::DOUBLE / length(html) < 0.005 THEN 'low_density' WHEN n < 2 THEN 'few_paragraphs' ELSE 'ok' END AS quality FROM p""")
def h12_page_quality(spark, sf_dir):
    """H11 and H12."""
    from newsloom.operators.ingest import page_quality

    body = F.regexp_replace("html", "<[^>]*>", "")
    return pages(spark, sf_dir).select("page_id", page_quality(F.col("html"), body).alias("quality"))


@query(r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS gone FROM pages""")
def h11_soft_404(spark, sf_dir):
    """Pages with a title or a beginning that says they are gone, with and without an article in their linked data; texts beyond the beginning don't count."""
    from newsloom.operators.ingest import soft_404

    k, said = F.col("page_id") % 6, "<p>Sorry, but\nwe can’t find it</p>"
    linked = '<script type="application/ld+json">{"@type": "NewsArticle", "articleBody": "text"}</script>'
    titled = lambda x: F.regexp_replace("html", "<title[^>]*>[^<]*</title>", f"<title>{x}</title>")
    html = (
        F.when(k == 0, titled("Sayfa bulunamadı")).when(k == 1, F.concat(F.lit(said), "html")).when(k == 2, F.concat(F.lit(linked), titled("404 - page")))
        .when(k == 3, F.concat(F.lit(linked.replace("NewsArticle", "WebPage")), titled("Page  not found"))).when(k == 4, F.concat(F.lit("x" * 2000 + said), "html")).otherwise(titled("Boeing 737-404 not found"))
    )
    return pages(spark, sf_dir).select("page_id", soft_404(html).alias("gone"))


GRAMS_SQL = """flatten(list_transform(list_filter(regexp_split_to_array(lower(substr({}, 1, 5000)), '[^\\p{{L}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"""


@query(f"""WITH g AS (SELECT doc_id, lang, text, unnest({GRAMS_SQL.format("text")}) AS gram FROM documents),
    known AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rank FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= 300),
    own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS own FROM g WHERE length(text) >= 50 GROUP BY doc_id, gram QUALIFY own <= 300),
    n AS (SELECT doc_id, count(*) * 300 AS farthest FROM own GROUP BY 1), far AS (SELECT doc_id, lang, sum(abs(own - rank) - 300) AS gain FROM own JOIN known USING (gram) GROUP BY ALL),
    d AS (SELECT doc_id, lang, (gain + farthest)::BIGINT AS distance FROM far JOIN n USING (doc_id)), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
    SELECT doc_id, coalesce(b.lang, 'tr') AS code, distance FROM documents LEFT JOIN b USING (doc_id)""")
def t5_languages(spark, sf_dir):
    """The language of every document by profiles of those whose id is not divisible by 5; ``test_languages`` measures the others."""
    from newsloom.operators import language

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.profiles(d.where("doc_id % 5 <> 0"))
    return language.detect(d, known, "doc_id").select(F.col("id").alias("doc_id"), "code", "distance")
