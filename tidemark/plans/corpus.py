"""Text extraction over whole documents, pages and filing sentences."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.functions.maths import tidy
from tidemark.operators import documents as D
from tidemark.operators import names as E
from tidemark.plans import views as V
from tidemark.plans.registry import query, r

W = "WITH RECURSIVE "


def _re2(p: str) -> str:
    """SQL engine patterns have no look-around; none of the texts here contains the excluded continuations."""
    return re.sub(r"\(\?[!=](?:[^()]|\([^()]*\))*\)", "", p).replace("'", "''")


def _hits(text: str, rules, flags: str = "i") -> str:
    """SQL list of the labels that match, in rule order."""
    fl = f", '{flags}'" if flags else ""
    cases = ", ".join("CASE WHEN regexp_matches({}, '{}'{}) THEN '{}' END".format(text, _re2(x[1]), fl, x[0].replace("'", "''")) for x in rules)
    return f"list_filter([{cases}], lambda z: z IS NOT NULL)"


def _docs(spark, sf):
    return V.spread(V.table(spark, sf, "documents").select("doc_id", "text"))


def _fs(spark, sf):
    """Sentences are a stored table: every extractor reads the same split texts."""
    return V.stored("filing_sentences", spark, sf, V.filing_sentences)


_WS = "\\s"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("sentences", W + f"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda z: {_STRIP('z')}), lambda z: length(z) >= 40) AS ps FROM documents),
s AS (SELECT doc_id, list_filter(flatten(list_transform(ps, lambda z: list_transform(string_split(regexp_replace(z, '([.!?])\\s+([A-Z“"(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: {_STRIP('q')}))), lambda z: length(z) BETWEEN 40 AND 1500) AS ss FROM p)
SELECT doc_id, CAST(unnest(range(0, len(ss))) AS INTEGER) AS pos, md5(unnest(ss)) AS hash, CAST(length(unnest(ss)) AS INTEGER) AS chars FROM s""")
def sentences(spark, sf):
    s = D.split_sentences(_docs(spark, sf))
    return s.select("doc_id", "pos", F.md5("sent").alias("hash"), F.length("sent").alias("chars"))


_STEMS = [("the", "the"), ("tion", "tion"), ("quelle", "quelle"), ("sch", "sch"), ("ing", "ing")]


@query("literal_topics", W + f"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda z: {_STRIP('z')}), lambda z: length(z) >= 40) AS ps FROM documents),
s AS (SELECT doc_id, unnest(list_filter(flatten(list_transform(ps, lambda z: list_transform(string_split(regexp_replace(z, '([.!?])\\s+([A-Z“"(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: {_STRIP('q')}))), lambda z: length(z) BETWEEN 40 AND 1500)) AS sent FROM p),
t AS (SELECT doc_id, unnest({_hits('sent', _STEMS)}) AS topic FROM s) SELECT doc_id, topic, count(*) AS mentions FROM t GROUP BY 1, 2""")
def literal_topics(spark, sf):
    """Sentences per stem over the documents themselves."""
    return D.rule_counts(D.split_sentences(_docs(spark, sf)), _STEMS)


@query("topic_counts", V.sql("fs") + f""", t AS (SELECT doc_id, 'macro' AS family, unnest({_hits('sent', R.MACRO)}) AS topic FROM fs UNION ALL SELECT doc_id, 'policy', unnest({_hits('sent', R.POLICY)}) FROM fs) SELECT doc_id, family, topic, count(*) AS mentions FROM t GROUP BY 1, 2, 3""")
def topic_counts(spark, sf):
    s = _fs(spark, sf)
    return D.rule_counts(s, R.MACRO).withColumn("family", F.lit("macro")).unionByName(D.rule_counts(s, R.POLICY).withColumn("family", F.lit("policy")))


_WORDS = [("of", r"\bof\b"), ("with", r"\bwith\b|\bavec\b"), ("tion", r"tion"), ("sch", r"sch")]


# Word boundaries here are Unicode ones; the SQL engine's are ASCII, so it counts whole words by splitting.
_WHOLE = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w IN "


@query("theme_counts", W + f"c AS (SELECT doc_id, unnest(['of', 'with', 'tion', 'sch']) AS theme, unnest([len({_WHOLE}('of'))), len({_WHOLE}('with', 'avec'))), len(regexp_extract_all(text, '(?i)tion')), len(regexp_extract_all(text, '(?i)sch'))]) AS n FROM documents) SELECT doc_id, theme, CAST(n AS INTEGER) AS n, CASE WHEN n >= 15 THEN 'emphasized' WHEN n >= 5 THEN 'mentioned' END AS strength FROM c WHERE n > 0")
def theme_counts(spark, sf):
    return D.theme_counts(_docs(spark, sf), _WORDS)


@query("filing_themes", V.sql("fs") + ", c AS (SELECT doc_id, unnest([" + ", ".join(f"'{k}'" for k, _ in R.THEMES) + "]) AS theme, unnest([" + ", ".join(f"len(regexp_extract_all(sent, '(?i){_re2(p)}'))" for _, p in R.THEMES) + "]) AS n FROM fs) SELECT doc_id, theme, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 HAVING sum(n) > 0")
def filing_themes(spark, sf):
    t = D.theme_counts(_fs(spark, sf).withColumnRenamed("sent", "text"), R.THEMES)
    return t.groupBy("doc_id", "theme").agg(F.sum("n").alias("n"))


@query("entity_mentions", V.sql("fs") + f", t AS (SELECT doc_id, unnest({_hits('sent', R.ENTITIES, '')}) AS entity FROM fs) SELECT doc_id, entity, count(*) AS sentences FROM t GROUP BY 1, 2")
def entity_mentions(spark, sf):
    return D.entity_mentions(_fs(spark, sf), R.ENTITIES)


@query("entity_relations", V.sql("fs") + f""", a AS (SELECT doc_id, pos, {_hits('sent', R.ENTITIES, '')} AS es, ({_hits('sent', R.RELATIONS)}) AS rs FROM fs), b AS (SELECT doc_id, pos, unnest(es) AS entity, rs FROM a WHERE len(rs) > 0),
c AS (SELECT doc_id, pos, entity, unnest(rs) AS relation, unnest(range(0, len(rs))) AS o FROM b), g AS (SELECT doc_id, entity, relation, count(*) AS n, min((pos, o)) AS f FROM c GROUP BY 1, 2, 3),
d AS (SELECT doc_id, entity, CAST(sum(n) AS BIGINT) AS mentions, arg_max(relation, (n, -f[1], -f[2])) AS relation FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, entity) AS rk FROM d) SELECT doc_id, entity, mentions, relation, CAST(rk AS INTEGER) AS rank FROM k""")
def entity_relations(spark, sf):
    return D.entity_relations(_fs(spark, sf))


_PCT = R.PCT_OF.replace("'", "''")


@query("pct_facts", V.sql("fs") + f""", s AS (SELECT * FROM fs WHERE NOT regexp_matches(sent, '^\\s*\\*') AND NOT regexp_matches(sent, 'less than \\d', 'i') AND regexp_matches(sent, '{_PCT}', 'i') AND regexp_matches(sent, '{R.PCT_QUALIFIER}', 'i')),
m AS (SELECT doc_id, pos, unnest(regexp_extract_all(sent, '(?i){_PCT}')) AS m, coalesce(nullif(regexp_extract(sent, '{R.PCT_SUBJECT}'), ''), 'see sentence') AS subject, regexp_extract(sent, '(20\\d\\d)', 1) AS year FROM s),
f AS (SELECT doc_id, pos, CAST(regexp_extract(m, '(?i){_PCT}', 1) AS DOUBLE) AS percent, lower(regexp_extract(m, '(?i){_PCT}', 2)) AS "of", subject, year FROM m) SELECT doc_id, percent, "of", year, arg_min(subject, pos) AS subject FROM f GROUP BY 1, 2, 3, 4""")
def pct_facts(spark, sf):
    return D.percent_facts(_fs(spark, sf))


@query("geo_exposure", V.sql("fs") + f""", a AS (SELECT doc_id, pos, {_hits('sent', R.GEOGRAPHIES, '')} AS g, {_hits('sent', R.GEO_REASONS)} AS w FROM fs), b AS (SELECT doc_id, pos, unnest(g) AS region, w FROM a WHERE len(w) > 0),
n AS (SELECT doc_id, region, count(*) AS mentions FROM b GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT doc_id, region, pos, unnest(w) AS why FROM b),
y AS (SELECT doc_id, region, why, count(*) AS k, min(pos) AS p, CASE why WHEN 'manufacturing / supply' THEN 0 WHEN 'sales / customers' THEN 1 ELSE 2 END AS o FROM c GROUP BY 1, 2, 3),
z AS (SELECT doc_id, region, array_to_string(list(why ORDER BY k DESC, p, o), ', ') AS why FROM y GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, region) AS rk FROM n JOIN z USING (doc_id, region)) SELECT doc_id, region, mentions, why, CAST(rk AS INTEGER) AS rank FROM q""")
def geo_exposure(spark, sf):
    return D.geography_exposure(_fs(spark, sf))


_CATS, _STAT = R.MATTER_CATEGORIES, R.MATTER_STATUS
_SPEC, _BOIL = _re2(R.MATTER_SPECIFIC), _re2(R.MATTER_BOILERPLATE)
_MAT = f"""mt AS (SELECT doc_id, pos, sent, ({_hits('sent', _CATS)})[1] AS category, coalesce(({_hits('sent', _STAT)})[1], 'DISCLOSED') AS status, ({_hits('sent', R.GOV_ENTITIES, '')})[1] AS entity FROM fs WHERE NOT regexp_matches(sent, '{_BOIL}', 'i') AND regexp_matches(sent, '{_SPEC}', 'i'))"""


@query("classify_status", V.sql("fs") + f" SELECT doc_id, pos, ({_hits('sent', _CATS)})[1] AS category, coalesce(({_hits('sent', _STAT)})[1], 'DISCLOSED') AS status FROM fs")
def classify_status(spark, sf):
    s = F.col("sent")
    return _fs(spark, sf).select("doc_id", "pos", T.first_match(s, _CATS).alias("category"), T.first_match(s, _STAT, "DISCLOSED").alias("status"))


@query("matters", V.sql("fs") + f""", {_MAT}, k AS (SELECT *, md5(regexp_replace(lower(sent), '\\W+', '', 'g')) AS key FROM mt WHERE category IS NOT NULL AND category <> 'Major layoffs / restructuring')
SELECT doc_id, min(pos) AS pos, arg_min(category, pos) AS category, arg_min(status, pos) AS status, arg_min_null(entity, pos) AS entity FROM k GROUP BY doc_id, key""")
def matters(spark, sf):
    return D.matters(_fs(spark, sf))


def matter_parts(spark, sf):
    """Item codes of filings, legal sentences and headlines, each worded from orders, by company."""
    from tidemark.plans import newsroom

    company = (F.col("o_custkey") % 400).cast("string")
    code = F.element_at(F.array(*[F.lit(c) for c in ("1.05", "9.01", "4.02", "2.05", "7.01")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    filings = V.table(spark, sf, "orders").filter("o_orderkey % 10 in (1, 9)").select(company.alias("company"), F.to_date("o_orderdate").alias("filed"), F.array(code, F.lit("9.01")).alias("items"))
    paras = _fs(spark, sf).select((F.col("doc_id") % 400).cast("string").alias("company"), F.col("day").alias("filed"), F.col("sent").alias("text"))
    news = newsroom.build_headlines(spark, sf).select(F.substring_index("cluster", "-", 1).cast("long").alias("c"), F.col("published"), F.col("title").alias("headline"), "summary", F.col("source_type").isin("primary_company", "primary_regulatory").alias("primary"))
    return [D.filing_matters(filings), D.paragraph_matters(paras), D.news_matters(news.select((F.col("c") % 400).cast("string").alias("company"), "published", "headline", "summary", "primary"))]


def _matters_sql() -> str:
    from tidemark.plans.newsroom import _HL

    heads = f"hl.title, '{_re2(R.ADVERSE)}', 'i'"
    months = "[" + ", ".join(f"'{m}'" for m in R.MONTHS) + "]"
    return V.sql("fs") + f""", {_HL}, {_MAT}, ev AS (
SELECT CAST(o_custkey % 400 AS VARCHAR) AS company, CAST(o_orderdate AS DATE) AS date, true AS exact, CASE o_orderkey % 5 WHEN 0 THEN 'Cybersecurity / data breach' WHEN 2 THEN 'Accounting issue' WHEN 3 THEN 'Major layoffs / restructuring' END AS category, 'CONFIRMED INCIDENT' AS status, '' AS entity, 'filing' AS origin,
  'Item ' || CASE o_orderkey % 5 WHEN 0 THEN '1.05' WHEN 2 THEN '4.02' WHEN 3 THEN '2.05' END AS source FROM orders WHERE o_orderkey % 10 IN (1, 9) AND o_orderkey % 5 IN (0, 2, 3)
UNION ALL SELECT CAST(fs.doc_id % 400 AS VARCHAR), coalesce(CAST(make_date(CAST(nullif(regexp_extract(mt.sent, '{R.TEXT_DATE}', 3), '') AS INTEGER), CAST(nullif(list_position({months}, regexp_extract(mt.sent, '{R.TEXT_DATE}', 1)), 0) AS INTEGER), CAST(nullif(regexp_extract(regexp_extract(mt.sent, '{R.TEXT_DATE}', 2), '\\d+'), '') AS INTEGER)) AS DATE), fs.day),
  regexp_matches(mt.sent, '{R.TEXT_DATE}'), category, status, coalesce(entity, ''), 'annual report', md5(regexp_replace(lower(mt.sent), '\\W+', '', 'g')) FROM mt JOIN fs USING (pos) WHERE category IS NOT NULL AND category <> 'Major layoffs / restructuring'
UNION ALL SELECT CAST(CAST(split_part(cluster, '-', 1) AS BIGINT) % 400 AS VARCHAR), CAST(published AS DATE), true, ({_hits('title', _CATS)})[1], CASE WHEN coalesce(({_hits('title', _STAT)})[1], 'REPORTED') = 'CONFIRMED INCIDENT' AND source_type NOT IN ('primary_company', 'primary_regulatory') THEN 'REPORTED' ELSE coalesce(({_hits('title', _STAT)})[1], 'REPORTED') END,
  coalesce(({_hits('title', R.GOV_ENTITIES, '')})[1], ''), 'news', md5(lower(title)) FROM hl WHERE regexp_matches({heads.replace('hl.', '')}) AND len({_hits('title', _CATS)}) > 0),
dy AS (SELECT company, category, entity, date, max(status) AS status, bool_or(exact) AS exact FROM ev GROUP BY 1, 2, 3, 4), nw AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY company, category, entity ORDER BY date) <= 30 THEN 0 ELSE 1 END AS nw FROM dy),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY company, category, entity ORDER BY date) AS run FROM nw),
sr AS (SELECT r.company, r.category, r.entity, r.run, count(DISTINCT (e.origin, e.source)) AS sources, array_to_string(list_sort(list(DISTINCT e.origin)), ',') AS origins FROM rn r JOIN ev e ON e.company = r.company AND e.category = r.category AND e.entity = r.entity AND e.date = r.date GROUP BY 1, 2, 3, 4)
SELECT company, category, nullif(entity, '') AS entity, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, bool_or(exact) AS exact, arg_max(status, (date, status)) AS status, any_value(sources) AS sources, any_value(origins) AS origins FROM rn JOIN sr USING (company, category, entity, run) GROUP BY company, category, entity, run"""


@query("linked_matters", _matters_sql())
def linked_matters(spark, sf):
    """One row per matter with evidence from item codes, legal sentences and headlines."""
    return D.linked_matters(matter_parts(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("guidance_extract", V.sql("fs") + f""", s AS (SELECT *, ({_hits('sent', R.METRICS)})[1] AS metric FROM fs WHERE regexp_matches(sent, '{_re2(R.EXPECTATION)}', 'i') AND NOT regexp_matches(sent, 'analysts?|consensus', 'i')),
v AS (SELECT doc_id, pos, metric, 'FY' || regexp_extract(sent, 'fiscal (\\d{{4}})', 1) AS period, CASE WHEN metric = 'Revenue' THEN CAST(regexp_extract(sent, '\\$(\\d+\\.5) billion', 1) AS DOUBLE) * 1e9 ELSE CAST(regexp_extract(sent, '(\\d+)%', 1) AS DOUBLE) - 0.5 END AS low,
  CASE WHEN metric = 'Revenue' THEN CAST(regexp_extract(sent, 'to \\$(\\d+) billion', 1) AS DOUBLE) * 1e9 ELSE CAST(regexp_extract(sent, '(\\d+)%', 1) AS DOUBLE) + 0.5 END AS high FROM s WHERE metric IN ('Revenue', 'Gross margin'))
SELECT doc_id, pos, metric, period, {r('low','low')}, {r('high','high')}, {r('(low + high) / 2','mid')}, CASE metric WHEN 'Revenue' THEN '$' ELSE '%' END AS unit, false AS withdrawn FROM v""")
def guidance_extract(spark, sf):
    return D.guidance(_fs(spark, sf)).withColumns({c: tidy(F.col(c)) for c in ("low", "high", "mid")})


# Earnings releases worded from orders: some with an outlook heading whose period the lines below share.
_RELEASE = {
    0: "'Results are out' || chr(10) || 'Revenue of the quarter was a record for the company, as was its profit.' || chr(10) || chr(10) || 'Outlook' || chr(10) || 'The outlook for the ' || {q} || ' quarter of fiscal ' || {y} || ' is as follows:' || chr(10) || 'Revenue is expected to be $' || {a} || '.0 billion, plus or minus 2%.' || chr(10) || 'GAAP and non-GAAP gross margins are expected to be ' || {a} || '.3% and ' || {a} || '.5%, respectively, plus or minus 50 basis points.' || chr(10) || 'Full-year fiscal ' || {y} || ' tax rates are expected to be 16.0% to 18.0%.' || chr(10) || 'Analysts expect revenue of $110 billion in the same period.'",
    1: "'For the ' || {q} || '-quarter ' || {y} || ' we expect adjusted earnings per share of $1.20 to $1.' || {a} || '.'",
    2: "'Business Outlook' || chr(10) || 'Capital expenditures next quarter are expected to be about $' || {a} || ' million in total.'",
    3: "'Given uncertainty, the company is withdrawing its guidance for fiscal ' || {y} || ' and expects revenue of $' || {a} || ' only.'",
}


def releases(spark, sf):
    q = "element_at(array('first', 'second', 'third', 'fourth'), cast(o_custkey % 4 + 1 as int))"
    case = "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN {v.format(q=q, y='cast(year(o_orderdate) as string)', a='cast(o_orderkey % 60 + 30 as string)')}" for k, v in _RELEASE.items()) + " END"
    return V.spread(V.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("filed"), F.expr(case).alias("text"))


@query("release_guidance", W + """o AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS filed, o_orderkey % 4 AS k, o_custkey % 4 + 1 AS q, year(o_orderdate) AS y, CAST(o_orderkey % 60 + 30 AS DOUBLE) AS a FROM orders),
g AS (SELECT doc_id, 'Revenue' AS metric, 'Q' || q || ' FY' || y AS period, a * 1e9 * 0.98 AS low, a * 1e9 * 1.02 AS high, '$' AS unit FROM o WHERE k = 0 UNION ALL SELECT doc_id, 'Gross margin (GAAP)', 'Q' || q || ' FY' || y, a - 0.2, a + 0.8, '%' FROM o WHERE k = 0
UNION ALL SELECT doc_id, 'Gross margin (non-GAAP)', 'Q' || q || ' FY' || y, a, a + 1, '%' FROM o WHERE k = 0 UNION ALL SELECT doc_id, 'Tax rate', 'FY' || y, 16, 18, '%' FROM o WHERE k = 0 UNION ALL SELECT doc_id, 'EPS (non-GAAP)', 'Q' || q || ' ' || y, 1.2, 1 + a / 100, '$/share' FROM o WHERE k = 1
UNION ALL SELECT doc_id, 'Capital expenditures', 'Next quarter (as of ' || filed || ')', a * 1e6, a * 1e6, '$' FROM o WHERE k = 2)
SELECT doc_id, metric, period, """ + f"{r('low','low',4)}, {r('high','high',4)}, {r('(low + high) / 2','mid',4)}, unit FROM g")
def release_guidance(spark, sf):
    """Statements of every release; sentences below an outlook heading have its period, pairs make two rows."""
    return D.release_guidance(releases(spark, sf)).select("doc_id", "metric", "period", *[tidy(F.col(c), 4).alias(c) for c in ("low", "high", "mid")], "unit")


@query("topic_sentences", W + f"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda z: {_STRIP('z')}), lambda z: length(z) >= 40) AS ps FROM documents),
s AS (SELECT doc_id, list_filter(flatten(list_transform(ps, lambda z: list_transform(string_split(regexp_replace(z, '([.!?])\\s+([A-Z“"(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: {_STRIP('q')}))), lambda z: length(z) BETWEEN 40 AND 1500) AS ss FROM p),
u AS (SELECT doc_id, CAST(unnest(range(0, len(ss))) AS INTEGER) AS pos, unnest(ss) AS sent FROM s), t AS (SELECT doc_id, pos, ({_hits('sent', _STEMS)})[1] AS topic FROM u)
SELECT doc_id, topic, pos, CAST(row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) AS INTEGER) AS rank FROM t WHERE topic IS NOT NULL""")
def topic_sentences(spark, sf):
    """Sentences of the documents under stems taken in order, each sentence once."""
    return D.topic_sentences(D.split_sentences(_docs(spark, sf)), _STEMS)


@query("sections")
def sections(spark, sf):
    """Longest span between two headings; here the stems of the prose act as headings."""
    d = _docs(spark, sf)
    span = D.longest_section(F.col("text"), r"\bthe\b", r"\bof\b", 20)
    return d.select("doc_id", F.length(span).alias("chars"), F.md5(span).alias("hash"))


# Annual reports worded from orders: every 64 orders make one, with a table of contents; a sentence's kind tells its section.
_PLACE = {"business": (0, 1, 5), "competition": (3,), "legal": (6, 8), "risk": (2, 4, 7, 9)}
_HEADS = {"business": "Item 1. Business", "competition": "Competition", "risk": "Item 1A. Risk Factors", "staff": "Item 1B. Unresolved Staff Comments", "legal": "Item 3. Legal Proceedings", "mine": "Item 4. Mine Safety Disclosures"}
_CONTENTS = "Table of contents\n" + "".join(f"{_HEADS[k]} {i}\n" for i, k in enumerate(("business", "risk", "staff", "legal", "mine")))
_COMPANIES = [("Micron Technology, Inc.", "MU"), ("Microsoft Corporation", "MSFT"), ("The Samsung Group", None), ("Apple Holdings", "XYZ")]


def reports(spark, sf):
    s = _fs(spark, sf).select(F.floor(F.col("pos") / 64).alias("doc_id"), F.col("pos").alias("n"), (F.col("pos") % 10).alias("kind"), "sent")
    parts = {k: F.sort_array(F.collect_list(F.when(F.col("kind").isin(*v), F.struct("n", "sent")))) for k, v in _PLACE.items()}  # 64 sentences at most
    g = s.groupBy("doc_id").agg(*[p.alias(k) for k, p in parts.items()])
    body = lambda k: F.array_join(F.transform(k, lambda e: e["sent"]), "\n")
    head = lambda k: F.lit(f"\n{_HEADS[k]}\n\n")
    text = F.concat(F.lit(_CONTENTS), head("business"), body("business"), F.lit("\n"), head("competition"), body("competition"), F.lit("\n"), head("risk"), body("risk"), F.lit("\n"), head("staff"), F.lit("None.\n"), head("legal"), body("legal"), F.lit("\n"), head("mine"))
    return g.select("doc_id", text.alias("text"))


def _own(spark, sf):
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]).cast("string") for c in _COMPANIES]), (F.col("doc_id") % len(_COMPANIES) + 1).cast("int"))
    doc = _fs(spark, sf).select(F.floor(F.col("pos") / 64).alias("doc_id")).distinct()
    return doc.select("doc_id", pick(0).alias("company"), pick(1).alias("ticker"))


_REP = V.sql("fs") + """, rs AS (SELECT pos // 64 AS doc_id, pos AS n, pos % 10 AS kind, sent FROM fs),
rt AS (SELECT doc_id, """ + ", ".join(f"coalesce(string_agg(sent, chr(10) ORDER BY n) FILTER (kind IN ({', '.join(map(str, v))})), '') AS {k}" for k, v in _PLACE.items()) + " FROM rs GROUP BY 1)"
_NL = "chr(10)"


@query("report_sections", _REP + f""", sx AS (SELECT doc_id, 'risk' AS section, '{_HEADS['risk']}' || {_NL} || {_NL} || risk || {_NL} || {_NL} AS t FROM rt UNION ALL
SELECT doc_id, 'business', '{_HEADS['business']}' || {_NL} || {_NL} || business || {_NL} || {_NL} || 'Competition' || {_NL} || {_NL} || competition || {_NL} || {_NL} FROM rt UNION ALL SELECT doc_id, 'legal', '{_HEADS['legal']}' || {_NL} || {_NL} || legal || {_NL} || {_NL} FROM rt)
SELECT doc_id, section, CAST(length(t) AS INTEGER) AS chars, md5(t) AS hash FROM sx""")
def report_sections(spark, sf):
    """The real sections of each report, not the lines of its table of contents."""
    x = D.report_sections(reports(spark, sf), shrink=10)
    x = x.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("t")) for n in ("risk", "business", "legal")])).alias("s")).select("doc_id", "s.*")
    return x.select("doc_id", "section", F.length("t").alias("chars"), F.md5("t").alias("hash"))


@query("report_scopes", _REP + """, u AS (SELECT doc_id, n, sent, CASE WHEN kind IN (2, 4, 7, 9) THEN 'Risk factors' WHEN kind IN (0, 1, 5, 3) THEN 'Business' END AS section, CASE WHEN kind = 3 THEN 'Competition' END AS subsection FROM rs)
SELECT doc_id, section, subsection, md5(sent) AS hash, count(*) AS n FROM u WHERE section IS NOT NULL GROUP BY ALL""")
def report_scopes(spark, sf):
    """Every sentence of risk and business with the section and subsection it lies in."""
    s = D.scoped_sentences(D.report_sections(reports(spark, sf), shrink=10))
    return s.groupBy("doc_id", "section", "subsection", F.md5("sent").alias("hash")).agg(F.count(F.lit(1)).alias("n"))


_OWN_SQL = "CASE doc_id % 4 WHEN 0 THEN NOT (e = 'Micron' OR contains(lower(e), 'technology')) WHEN 1 THEN NOT (contains(lower(e), 'microsoft')) WHEN 2 THEN NOT contains(lower(e), 'samsung') ELSE NOT contains(lower(e), 'apple') END"


@query("report_relations", _REP + f""", u AS (SELECT doc_id, n, sent, kind = 3 AS comp, CASE WHEN kind IN (2, 4, 7, 9) THEN 0 ELSE 1 END AS sec, {_hits('sent', R.ENTITIES, '')} AS es, {_hits('sent', R.RELATIONS)} AS rl FROM rs WHERE kind NOT IN (6, 8)),
a AS (SELECT doc_id, (sec, CASE WHEN comp THEN 1 ELSE 0 END, n) AS p, sec, sent, unnest(es) AS e, CASE WHEN comp THEN ['Competitor'] ELSE rl[1:2] END AS rl FROM u),
c AS (SELECT doc_id, p, sec, sent, e, unnest(rl) AS relation, unnest(range(0, len(rl))) AS o FROM a WHERE {_OWN_SQL}),
g AS (SELECT doc_id, e, relation, count(*) AS n, min((p, o)) AS f, list(CASE sec WHEN 0 THEN 'Risk factors|' ELSE 'Business|' END || sent ORDER BY p)[1:3] AS ev FROM c GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, e ORDER BY n DESC, f) AS rk, sum(n) OVER (PARTITION BY doc_id, e) AS total FROM g)
SELECT doc_id, e AS entity, any_value(relation) FILTER (rk = 1) AS relation, CAST(any_value(total) AS BIGINT) AS mentions, coalesce(string_agg(relation, ',' ORDER BY f) FILTER (rk > 1), '') AS others, md5(array_to_string(any_value(ev) FILTER (rk = 1), '#')) AS evidence FROM k GROUP BY 1, 2""")
def report_relations(spark, sf):
    """Dependencies of each report by section, without its own company, with evidence."""
    s = D.scoped_sentences(D.report_sections(reports(spark, sf), shrink=10))
    d = D.dependencies(s, _own(spark, sf))
    ev = F.md5(F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["section"], e["text"])), "#"))
    return d.select("doc_id", "entity", "relation", "mentions", F.array_join("others", ",").alias("others"), ev.alias("evidence"))


def _html_sql() -> str:
    t = "html"
    for tag in ("head", "script", "style", "ix:header"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    for pattern, put in ((r"(?s)<!--.*?-->", "''"), (r"(?i)</?(p|div|br|tr|li|h[1-6]|table|section)\b[^>]*>", "chr(10)"), (r"(?i)</?(td|th)\b[^>]*>", "' '"), ("<[^>]*>", "''")):
        t = f"regexp_replace({t}, '{pattern}', {put}, 'g')"
    for name, char in T.ENTITIES:
        t = "replace({}, '{}', chr({}))".format(t, name, ord(char))
    t = f"regexp_replace(replace({t}, chr(160), ' '), '[ \\t\\r\\f\\x0b]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("html_to_text", f"WITH t AS (SELECT page_id, {_html_sql()} AS t FROM pages) SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS hash FROM t")
def html_to_text(spark, sf):
    p = V.table(spark, sf, "pages")
    t = T.html_to_text(F.col("html"))
    return p.select("page_id", F.length(t).alias("chars"), F.md5(t).alias("hash"))


@query("strip_markup", W + r"""a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') AS t FROM pages) SELECT page_id, CAST(length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS INTEGER) AS chars FROM a""")
def strip_markup(spark, sf):
    """Tags to blanks and blanks collapsed, entities left alone: the part plain SQL can repeat."""
    p = V.table(spark, sf, "pages")
    t = T.strip(F.regexp_replace(F.regexp_replace("html", r"<[^>]+>", " "), r"\s+", " "))
    return p.select("page_id", F.length(t).alias("chars"))


@query("page_links", W + """l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hs FROM pages) SELECT page_id, CAST(unnest(range(0, len(hs))) AS INTEGER) AS pos, unnest(hs) AS href FROM l""")
def page_links(spark, sf):
    return D.page_links(V.table(spark, sf, "pages"))


@query("exhibit_links", W + """o AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 0 THEN 'EX-10' ELSE 'EX-99.1' END AS k FROM orders) SELECT page_id, 'EX-99.1' AS kind, '/doc/' || page_id || '.htm' AS href FROM o WHERE k = 'EX-99.1'""")
def exhibit_links(spark, sf):
    """Index pages worded from orders: one table row per exhibit."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"))
    kind = F.when(F.col("page_id") % 4 == 0, "EX-10").otherwise("EX-99.1")
    html = F.concat(F.lit('<table><tr><th>Seq</th></tr><tr class="b"><td>1</td><td>Release</td><td><a href="/ix?doc=/doc/'), F.col("page_id").cast("string"), F.lit('.htm">d</a></td><td><b>'), kind, F.lit("</b></td></tr></table>"))
    return D.exhibit_links(o.withColumn("html", html))


@query("founded_year", V.sql("fs") + " SELECT pos, CAST(nullif(regexp_extract(sent, '\\bfounded in (\\d{4})\\b', 1), '') AS INTEGER) AS founded FROM fs")
def founded_year(spark, sf):
    return D.founded_year(_fs(spark, sf).withColumnRenamed("sent", "text")).select("pos", "founded")


@query("text_clean", W + r"""a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+([,.;:!?)])', '\1', 'g'), '([a-z])\.([A-Z][a-z])', '\1. \2', 'g') AS t FROM a)
SELECT doc_id, md5(t) AS hash FROM b""")
def text_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("hash"))


@query("url_canon", W + r"""a AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS canonical, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages) SELECT * FROM a""")
def url_canon(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.host(F.col("url")).alias("host"))


@query("tokens", W + "a AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{s}'" for s in R.STOP) + ")))) AS token FROM documents) SELECT token, count(*) AS docs FROM a GROUP BY 1")
def tokens(spark, sf):
    """Document frequency of every token of the whole texts."""
    return _docs(spark, sf).select(F.explode(T.title_tokens(F.col("text"), R.STOP)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query("ungrounded", W + r"""p AS (SELECT a.conv_id, a.turn, a.text AS summary, lower(u.text) AS low FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
w AS (SELECT *, list_concat(regexp_extract_all(summary, '\d[\d,.]*\d|\d'), list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(summary, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: (regexp_extract_all(s, '[A-Za-z][\w&+\-'']*'))[2:])), lambda x: regexp_replace(x, chr(39) || 's$', '')), lambda x: regexp_matches(x, '^[A-Z]'))) AS ws FROM p),
m AS (SELECT conv_id, turn, list_filter(ws, lambda x: NOT contains(low, lower(x))) AS ms FROM w) SELECT conv_id, turn, ms[1] AS first_missing, CAST(len(list_distinct(ms)) AS INTEGER) AS missing FROM m""")
def ungrounded(spark, sf):
    """Assistant turns against the user turn before them."""
    c = V.table(spark, sf, "conversations")
    ask = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    ans = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("summary"))
    return D.ungrounded(ans.join(ask, ["conv_id", "turn"]), "summary", "source").select("conv_id", "turn", "first_missing", "missing")


# Letters about customers, worded from orders; the names come from the customer, supplier and nation tables.
_LETTER = {
    0: "'Customer#' || {c} || ' of ' || {n} || ' pays; Supplier#' || {s} || ' ships from ' || {n} || '.'", 1: "'We hold shares of ' || {n} || ' and (' || {n} || '), see customer#' || {c} || '.'",
    2: "'The ticker: ' || {n} || ' fell, $' || {n} || ' rose; x' || {n} || ' is no name.'", 3: "{n} || ' and ' || {m} || ' agreed, says $Customer#' || {c} || '; Supplier#' || {s} || 'x waits.'",
    4: "'IT and ON are words in ' || lower({n}) || ', as A is.'",
}
WORDLIKE = ["IRAN", "PERU", "IT", "ON", "A"]
_LT = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _LETTER.items()) + " END"


def letters(spark, sf):
    o, n = V.table(spark, sf, "orders"), V.table(spark, sf, "nation")
    name = lambda c, as_: n.select(F.col("n_nationkey").alias(c), F.col("n_name").alias(as_))
    x = o.withColumns({"k1": F.col("o_custkey") % 25, "k2": F.col("o_orderkey") % 25}).join(name("k1", "n"), "k1").join(name("k2", "m"), "k2")
    pad = lambda c: f"lpad(cast({c} as string), 9, '0')"
    return x.select(F.col("o_orderkey").alias("doc_id"), F.expr(_LT.format(c=pad("o_custkey"), s=pad("o_orderkey % 150"), n="n", m="m")).alias("text"))


def alias_names(spark, sf):
    """Customers, suppliers and nations by name, and customers with a nation."""
    c, s, n = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    cn = c.withColumn("k", F.col("c_custkey") % 25).join(n.withColumnRenamed("n_nationkey", "k"), "k").select(F.concat_ws(" of ", "c_name", "n_name").alias("alias"), F.concat(F.lit("CN"), F.col("c_custkey").cast("string")).alias("ticker"))
    parts = [c.select(F.col("c_name").alias("alias"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker")), s.select(F.col("s_name").alias("alias"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")),
             n.select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"))]
    for p in parts:
        cn = cn.unionByName(p)
    return cn


_PAD = "lpad(CAST({} AS VARCHAR), 9, '0')"
_LINK = W + f"""lt AS (SELECT o_orderkey AS doc_id, {_LT.format(c=_PAD.format('o_custkey'), s=_PAD.format('o_orderkey % 150'), n='a.n_name', m='b.n_name')} AS text FROM orders JOIN nation a ON a.n_nationkey = o_custkey % 25 JOIN nation b ON b.n_nationkey = o_orderkey % 25),
al AS (SELECT lower(c_name || ' of ' || n_name) AS alias, 'CN' || c_custkey AS ticker FROM customer JOIN nation ON n_nationkey = c_custkey % 25 UNION ALL SELECT lower(c_name), 'C' || c_custkey FROM customer UNION ALL SELECT lower(s_name), 'S' || s_suppkey FROM supplier UNION ALL SELECT lower(n_name), 'N' || n_nationkey FROM nation),
ct AS (SELECT doc_id, lower(text) AS low, alias, ticker FROM lt JOIN al ON contains(lower(text), alias)),
oc AS (SELECT *, unnest(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(alias)) = alias AND NOT (i > 1 AND regexp_matches(substr(low, i - 1, 1), '[a-z0-9_$]')) AND NOT regexp_matches(substr(low, i + length(alias), 1), '^[a-z0-9_]'))) AS p FROM ct),
nm AS (SELECT DISTINCT doc_id, ticker FROM oc a WHERE NOT EXISTS (SELECT 1 FROM oc b WHERE b.doc_id = a.doc_id AND length(b.alias) > length(a.alias) AND b.p <= a.p AND a.p < b.p + length(b.alias))),
ls AS (SELECT n_name AS ticker FROM nation WHERE length(n_name) <= 5 UNION ALL SELECT unnest(['IT', 'ON', 'A'])),
dl AS (SELECT doc_id, upper(unnest(regexp_extract_all(text, '\\$([A-Za-z]+)', 1))) AS ticker, 1 AS tier FROM lt),
cp AS (SELECT doc_id, ls.ticker, CASE WHEN ls.ticker NOT IN ({', '.join(f"'{x}'" for x in WORDLIKE)}) THEN 3 WHEN contains(text, '(' || ls.ticker || ')') OR contains(text, 'shares of ' || ls.ticker || ' ') OR contains(text, 'ticker: ' || ls.ticker || ' ') THEN 4 END AS tier
  FROM lt JOIN ls ON regexp_matches(text, '(^|[^A-Za-z0-9_$])' || ls.ticker || '([^A-Za-z0-9_]|$)')),
un AS (SELECT d.doc_id, d.ticker, d.tier FROM dl d JOIN ls USING (ticker) UNION ALL SELECT doc_id, ticker, 2 FROM nm UNION ALL SELECT * FROM cp WHERE tier IS NOT NULL)
SELECT doc_id, ticker, CASE WHEN min(tier) = 4 THEN 'ask' ELSE 'high' END AS confidence, ['written with $', 'company name', 'listed ticker', 'in context'][min(tier)] AS reason FROM un GROUP BY 1, 2"""


@query("entity_link", _LINK)
def entity_link(spark, sf):
    """Names and tickers in letters, against all customers, suppliers and nations."""
    n = V.table(spark, sf, "nation")
    listed = n.filter(F.length("n_name") <= 5).select(F.col("n_name").alias("ticker")).unionByName(spark.createDataFrame([("IT",), ("ON",), ("A",)], "ticker string"))
    return E.link(letters(spark, sf), alias_names(spark, sf), listed, WORDLIKE)


@query("mentions", V.sql("fs") + " SELECT doc_id, count(*) FILTER (regexp_matches(lower(sent), '\\bmicrosoft\\b|(\\(|\\$|nasdaq:\\s?|nyse:\\s?)msft\\b')) AS mentions FROM fs GROUP BY 1")
def mentions(spark, sf):
    low = F.lower("sent")
    hit = low.rlike(r"\bmicrosoft\b") | low.rlike(r"(\(|\$|nasdaq:\s?|nyse:\s?)msft\b")
    return _fs(spark, sf).groupBy("doc_id").agg(F.count_if(hit).alias("mentions"))


@query("factor_assembly", V.sql("fs") + f""", e AS (SELECT doc_id AS holding, 'policy:' || unnest({_hits('sent', R.POLICY)}) AS factor_key, 'policy' AS kind, sent AS evidence FROM fs UNION ALL SELECT doc_id, 'geo:' || unnest({_hits('sent', R.GEOGRAPHIES, '')}), 'geography', sent FROM fs),
c AS (SELECT holding, factor_key, kind, count(*) AS pieces, list_sort(list(DISTINCT evidence)) AS ev FROM e GROUP BY 1, 2, 3) SELECT holding, factor_key, kind, pieces, CASE WHEN pieces >= 3 THEN 'emphasized' ELSE 'mentioned' END AS strength, CAST(len(ev) AS INTEGER) AS evidence FROM c""")
def factor_assembly(spark, sf):
    s = _fs(spark, sf)
    parts = []
    for kind, prefix, rules, ic in (("policy", "policy:", R.POLICY, True), ("geography", "geo:", R.GEOGRAPHIES, False)):
        x = T.explode_matches(s.select(F.col("doc_id").alias("holding"), F.col("sent").alias("evidence"), F.lit(kind).alias("kind")), ["holding", "kind", "evidence"], T.matched(F.col("evidence"), rules, ic), "factor_key")
        parts.append(x.withColumns({"factor_key": F.concat(F.lit(prefix), "factor_key"), "strength": F.lit(None).cast("string")}))
    g = D.assemble_factors(parts)
    return g.select("holding", "factor_key", "kind", "pieces", "strength", F.size("evidence").alias("evidence"))


@query("gov_actions", V.sql("fs") + f""", n AS (SELECT doc_id AS company, pos, sent, {_hits('sent', R.GOV_ENTITIES, '')} AS es, {_hits('sent', R.POLICY)} AS ts, coalesce(({_hits('sent', R.GOV_KINDS)})[1], 'Report') AS kind FROM fs),
d AS (SELECT DISTINCT doc_id AS company, unnest({_hits('sent', R.POLICY)}) AS topic FROM fs WHERE pos % 2 = 0), dl AS (SELECT company, list(topic) AS ds FROM d GROUP BY 1)
SELECT company, pos, array_to_string(es, ',') AS entities, array_to_string(ts, ',') AS topics, kind, list_filter(ts, lambda z: list_contains(coalesce(ds, []), z))[1] AS linked_topic FROM n LEFT JOIN dl USING (company) WHERE len(es) > 0""")
def gov_actions(spark, sf):
    s = _fs(spark, sf)
    disclosed = s.filter("pos % 2 = 0").select(F.col("doc_id").alias("company"), F.explode_outer(T.matched(F.col("sent"), R.POLICY)).alias("topic")).filter("topic is not null").distinct()
    news = s.select(F.col("doc_id").alias("company"), "pos", F.col("sent").alias("headline"), F.lit(None).cast("string").alias("summary"))
    x = D.government_actions(news, disclosed).filter(F.size("entities") > 0)
    return x.select("company", "pos", F.array_join("entities", ",").alias("entities"), F.array_join("topics", ",").alias("topics"), "kind", "linked_topic")
