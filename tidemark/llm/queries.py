"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, dedup, fim, hmm, langid, merkle, mixing, pii, quality, simhash, sketch, toxicity, urlfilter
from tidemark.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.run(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.run(table(spark, sf_dir, "documents"))


#: `pages` has no list and no fetch dates. This log lists hosts that it does have; a page's date follows from its id.
URL_LIST = (
    ("spam-farm.example.com", "spam", "add", "2024-02-01"),
    ("spam-farm.example.com", "spam", "remove", "2024-05-15"),
    ("spam-farm.example.com", "spam", "add", "2024-09-01"),
    ("spam-farm.example.org", "spam", "add", "2024-02-01"),
    ("spam-farm.example.com", "malware", "add", "2024-08-10"),
    ("cheap-pills.example.com", "pharma", "add", "2024-01-15"),
    ("cheap-pills.example.com", "pharma", "add", "2024-03-01"),
    ("casino-win.example.com", "gambling", "add", "2024-01-01"),
    ("casino-win.example.com", "gambling", "remove", "2024-10-01"),
    ("casino-win.example.org", "gambling", "add", "2024-03-01"),
    ("free-bets.example.com", "gambling", "add", "2024-04-01"),
    ("ads-track.example.com", "ads", "add", "2024-01-01"),
    ("ads-track.example.com", "ads", "remove", "2024-07-01"),
    ("ads-track.example.org", "ads", "add", "2024-01-01"),
    ("adult-x.example.net", "adult", "add", "2024-07-01"),
    ("tionsh.example.net", "spam", "add", "2024-06-01"),
    ("tionsh.example.net", "spam", "remove", "2024-06-30"),
    ("example.org", "suspended", "add", "2024-12-24"),
)


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))
    entries = spark.createDataFrame(list(URL_LIST), "domain string, category string, action string, day string").withColumn("day", F.col("day").cast("date"))
    return urlfilter.judge(pages, entries).withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.run(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.run(table(spark, sf_dir, "documents"))


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_and_next(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.run(table(spark, sf_dir, "documents"))


def op12_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.run(table(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.run(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_hmm": op2_hmm, "op3_pii": op3_pii, "op4_decontaminate": op4_decontaminate, "op5_toxicity": op5_toxicity, "op6_mixing": op6_mixing, "op7_urlfilter": op7_urlfilter, "op8_simhash": op8_simhash, "op9_langid": op9_langid, "op10_sketch": op10_sketch, "op11_merkle": op11_merkle, "op12_dedup": op12_dedup, "op13_fim": op13_fim}

#: the sums by hash place of one source are a running window here; the operator never sorts documents
_MIX_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, 2.0 * source_size AS ceiling, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM sizes),
turns AS (SELECT *, row_number() OVER (ORDER BY ceiling / weight, source NULLS LAST) AS turn, 1.5 * sum(source_size) OVER () AS whole FROM weighed),
water AS (SELECT *, (whole - coalesce(sum(ceiling) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turns),
targets AS (SELECT source, source_size, least(ceiling, weight * coalesce((SELECT level FROM water WHERE level < ceiling / weight ORDER BY turn LIMIT 1), 1e300)) AS target FROM water),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
places AS (SELECT source, place, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY 1, 2),
runs AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
edges AS (SELECT r.source, min(CASE WHEN p.upto > r.target - r.repeats * r.source_size THEN p.place END) AS edge FROM rests r JOIN runs p ON p.source IS NOT DISTINCT FROM r.source GROUP BY 1),
below AS (SELECT r.*, CASE WHEN e.edge IS NULL THEN 1152921504606846976 ELSE e.edge + CASE WHEN p.upto - (r.target - r.repeats * r.source_size) < (r.target - r.repeats * r.source_size) - (p.upto - p.size) THEN 1 ELSE 0 END END AS below
  FROM rests r JOIN edges e ON e.source IS NOT DISTINCT FROM r.source LEFT JOIN runs p ON p.source IS NOT DISTINCT FROM r.source AND p.place = e.edge)
SELECT s.doc_id, s.size, b.source_size, b.target, s.size * least(b.repeats + CASE WHEN s.place < b.below THEN 1 ELSE 0 END, 2) AS taken FROM sized s JOIN below b ON b.source IS NOT DISTINCT FROM s.source
"""


def _url_sql() -> str:
    entries = ", ".join(f"('{d}', '{c}', DATE '{day}', {'true' if a == 'remove' else 'false'})" for d, c, a, day in URL_LIST)
    return f"""
WITH log(domain, category, day, ends) AS (VALUES {entries}),
turns AS (SELECT *, lag(ends) OVER (PARTITION BY domain, category ORDER BY day, ends) AS before FROM log),
spans AS (SELECT * FROM (SELECT domain, category, ends, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY domain, category ORDER BY day, ends), DATE '9999-12-31') AS valid_to FROM turns WHERE before IS NULL OR before <> ends) WHERE NOT ends AND valid_from < valid_to),
asked AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^/?#\\]]*\\]|[^/?#:@\\[]+)', 1), '\\.+$', ''), '') AS host, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on FROM pages),
held AS (SELECT a.page_id, s.domain, s.category FROM asked a JOIN spans s ON (a.host = s.domain OR a.host LIKE '%.' || s.domain AND NOT regexp_matches(a.host, '^[0-9.]+$|^\\[')) AND s.valid_from <= a.fetched_on AND a.fetched_on < s.valid_to)
SELECT a.page_id, a.host, strftime(a.fetched_on, '%Y-%m-%d') AS fetched_on, h.page_id IS NOT NULL AS blocked, coalesce(h.domain, '') AS domain, coalesce(h.categories, '') AS categories FROM asked a
LEFT JOIN (SELECT page_id, arg_max(domain, length(domain)) AS domain, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM held GROUP BY 1) h USING (page_id)
"""


_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_FIM_SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (SELECT doc_id, n, form, text, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut
"""


def _merkle_sql(height: int = 7, height_of_groups: int = 3) -> str:
    """Levels written out: for up to 8 ** height rows of a lang and 8 ** height_of_groups langs. The CRC-32 is one bit after the other."""
    value = lambda c, text="{}": f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {text.format(c)}, '-')"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: f"sha256({value('doc_id')} || {value('source')} || {value('lang')} || {value('n_chars')} || {value('text', text)})"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"
    steps = [
        f"hashed AS (SELECT doc_id, lang, {leaf('{}')} AS leaf, {leaf(f"translate({{}}, '{capitals}', '{capitals.lower()}')")} AS lowered, {crc} % 3 = 0 AS hit FROM documents)",
        "a0 AS (SELECT doc_id, lang AS of, leaf AS d, CASE WHEN hit THEN lowered ELSE leaf END AS fed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed)",
    ]

    def tree(t: str, levels: int) -> None:
        for k in range(levels):
            run = "PARTITION BY of, i // 8 ORDER BY i ROWS BETWEEN"
            steps.append(f"{t}{k}_side AS (SELECT of, i, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {t}{k} WHERE n > {8**k})")
            steps.append(f"{t}{k + 1} AS (SELECT of, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, n FROM {t}{k} WHERE n > {8**k} GROUP BY of, i // 8, n)")
        tops = " UNION ALL ".join(f"SELECT of, d FROM {t}{k} WHERE n <= {8**k}" + (f" AND n > {8 ** (k - 1)}" if k else "") for k in range(levels + 1))
        steps.append(f"{t}_top AS ({tops})")

    def folded(t: str, levels: int, rows: str) -> str:
        for k in range(levels):
            steps.append(f"{rows}_{t}{k} AS (SELECT r.* EXCLUDE (fed, proof), CASE WHEN s.i IS NULL THEN fed ELSE sha256(lft || fed || rgt) END AS fed, proof || coalesce(lft || rgt, '') AS proof FROM {rows}{f'_{t}{k - 1}' if k else ''} r LEFT JOIN {t}{k}_side s ON s.of IS NOT DISTINCT FROM r.of_{t} AND s.i = r.i_{t} // {8**k})")
        return f"{rows}_{t}{levels - 1}"

    tree("a", height)
    steps.append("b0 AS (SELECT 0 AS of, d, row_number() OVER (ORDER BY of NULLS FIRST) - 1 AS i, count(*) OVER () AS n, of AS lang FROM a_top)")
    tree("b", height_of_groups)
    steps.append("asked AS (SELECT a0.doc_id, a0.d AS leaf, b0.d AS subroot, a0.of AS of_a, a0.i AS i_a, 0 AS of_b, b0.i AS i_b, a0.fed, '' AS proof FROM a0 JOIN b0 ON b0.lang IS NOT DISTINCT FROM a0.of)")
    last = folded("b", height_of_groups, folded("a", height, "asked"))
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, b_top.d AS root, sha256(proof) AS proof_sha256, fed AS folded_root, fed = b_top.d AS verified FROM {last}, b_top"


ORACLE_SQL: dict[str, str] = {"op6_mixing": _MIX_SQL, "op7_urlfilter": _url_sql(), "op11_merkle": _merkle_sql(), "op12_dedup": _DEDUP_SQL, "op13_fim": _FIM_SQL}
