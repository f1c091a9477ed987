"""News operators over articles made from whole documents and headlines worded from orders."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.functions.maths import tidy
from tidemark.operators import news as N
from tidemark.plans import views as V
from tidemark.plans.corpus import _hits, _re2
from tidemark.plans.registry import query, r
from tidemark.session import checkpoint_dir
from tidemark.sources import archive as A
from tidemark.sources import providers as SRC

W = "WITH RECURSIVE "
NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def articles(spark, sf):
    """Every document as an article: its first line is the title, three neighbours share an address, hours spread over six weeks."""
    flat = lambda c: T.strip(F.regexp_replace(c, r"\s+", " "))
    d = V.spread(V.table(spark, sf, "documents")).withColumn("_text", T.strip(F.col("text"))).withColumn("_line", F.substring_index("_text", "\n", 1))
    hours = (F.col("doc_id") * 37 % 1000).cast("long")
    return d.select(
        F.col("doc_id").alias("id"), flat(F.col("_line")).alias("title"), flat(F.expr("substr(_text, length(_line) + 1)")).alias("summary"),
        F.concat(F.lit("http://www.src"), (F.floor(F.col("doc_id") / 3) % 20).cast("string"), F.lit(".example.com/a/"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("/?id="), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("source_name"), F.col("source").alias("provider"), F.when(F.col("doc_id") % 50 != 0, F.timestamp_seconds(F.lit(1704067200) + hours * 3600)).alias("published"))


_ART = r"""f0 AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), f1 AS (SELECT *, split_part(t, chr(10), 1) AS line FROM f0),
fl AS (SELECT doc_id, source, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS title, regexp_replace(regexp_replace(substr(t, length(line) + 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS summary FROM f1),
ar AS (SELECT doc_id AS id, title, summary, 'http://www.src' || (doc_id // 3 % 20) || '.example.com/a/' || (doc_id // 3) || '/?id=' || doc_id AS url, source AS source_name, CASE WHEN doc_id % 50 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id * 37 % 1000) END AS published FROM fl)"""


@query("normalize_articles", W + _ART + r""", s AS (SELECT *, regexp_replace(summary, '^\s+|\s+$', '', 'g') AS s FROM ar) SELECT id, md5(title) AS title, md5(CASE WHEN length(s) >= 30 AND NOT starts_with(lower(s), lower(title)) THEN s END) AS summary, regexp_extract(url, '://www\.([^/]*)', 1) AS source_domain FROM s""")
def normalize_articles(spark, sf):
    n = N.normalize(articles(spark, sf))
    return n.select("id", F.md5("title").alias("title"), F.md5("summary").alias("summary"), "source_domain")


@query("article_filter", W + _ART + f""", f AS (SELECT CASE WHEN published IS NULL THEN 'undated' WHEN published < TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR published > TIMESTAMP '{NOW}' + INTERVAL 3 HOUR THEN 'old_or_future' WHEN NOT (contains(lower(title), 'tion') OR contains(lower(summary), 'tion')) THEN 'not_about_company' ELSE 'kept' END AS reason FROM ar)
SELECT reason, count(*) AS n FROM f GROUP BY 1""")
def article_filter(spark, sf):
    a = articles(spark, sf)
    about = F.lower("title").contains("tion") | F.lower("summary").contains("tion")
    return a.groupBy(F.coalesce(N.drop_reason(F.col("published"), about, _now()), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("retain", W + _ART + f", k AS (SELECT regexp_replace(url, '[?].*$', '') AS u, id FROM ar WHERE published >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) SELECT u AS url, min(id) AS id FROM k GROUP BY 1")
def retain(spark, sf):
    a = articles(spark, sf).withColumn("url", F.regexp_replace("url", r"[?].*$", "")).withColumn("arrival", F.col("id"))
    return A.retain(a, _now()).select("url", "id")


@query("provider_status", W + _ART + ", c AS (SELECT source_name AS provider, count(*) AS n FROM ar GROUP BY 1), p AS (SELECT 'src' || range AS provider FROM range(0, 25)) SELECT p.provider, coalesce(n, 0) AS n, CASE WHEN p.provider = 'src3' THEN 'error' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM p LEFT JOIN c USING (provider)")
def provider_status(spark, sf):
    return N.provider_status(articles(spark, sf), [f"src{i}" for i in range(25)], ["src3"])


FEEDS = {"wire": "json_wire", "archive": "csv_table", "feed": "rss"}


def feeds(spark, sf):
    """The articles as three providers deliver them: JSON, CSV and RSS files in the shared folder, beside a file that is none of these."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/feeds_{os.urandom(6).hex()}"
    a = articles(spark, sf).select("id", F.regexp_replace("title", r"\p{Cntrl}", " ").alias("title"), "url", "source_name", "published")
    part = lambda i: a.filter(F.floor(F.col("id") / 3) % 3 == i)
    part(0).write.json(f"{root}/wire")
    part(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{root}/archive")
    part(2).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(f"{root}/feed")
    spark.createDataFrame([("no article",)], "value string").write.text(f"{root}/broken")
    return root


def _fetched(spark, sf):
    root = feeds(spark, sf)
    return SRC.fetch(spark, [*[(n, k, f"{root}/{n}") for n, k in FEEDS.items()], ("broken", "json_wire", f"{root}/broken"), ("gone", "rss", f"{root}/gone"), ("unheard", "carrier pigeon", root)])


@query("provider_articles", W + _ART + " SELECT ['wire', 'archive', 'feed'][CAST(id // 3 % 3 AS INTEGER) + 1] AS provider, id, url, source_name, CAST(epoch(published) AS BIGINT) AS published FROM ar")
def provider_articles(spark, sf):
    """Articles read back from three formats; the providers that fail take nothing from the others."""
    return _fetched(spark, sf)[0].select("provider", "id", "url", "source_name", F.unix_seconds("published").alias("published"))


@query("provider_reads", W + _ART + ", c AS (SELECT ['wire', 'archive', 'feed'][CAST(id // 3 % 3 AS INTEGER) + 1] AS provider, count(*) AS n FROM ar GROUP BY 1) SELECT provider, n, 'ok' AS status FROM c UNION ALL SELECT unnest(['broken', 'gone', 'unheard']), 0, 'error'")
def provider_reads(spark, sf):
    """One status row for each provider, from reading it."""
    return _fetched(spark, sf)[1].select("provider", "n", "status")


_DED = W + _ART + r""", k AS (SELECT id, row_number() OVER (ORDER BY id) AS n, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS u, md5(trim(regexp_replace(lower(title), '\W+', ' ', 'g')) || '|' || lower(source_name)) AS t FROM ar),
st AS (SELECT n, id, true AS keep, [u] AS us, [t] AS ts FROM k WHERE n = 1 UNION ALL SELECT k.n, k.id, NOT (list_contains(us, k.u) OR list_contains(ts, k.t)), CASE WHEN list_contains(us, k.u) OR list_contains(ts, k.t) THEN us ELSE list_append(us, k.u) END,
  CASE WHEN list_contains(us, k.u) OR list_contains(ts, k.t) THEN ts ELSE list_append(ts, k.t) END FROM st JOIN k ON k.n = st.n + 1)"""


@query("news_dedupe", _DED + " SELECT id FROM st WHERE keep")
def news_dedupe(spark, sf):
    a = articles(spark, sf)
    title_key = F.md5(F.concat_ws("|", F.trim(F.regexp_replace(F.lower("title"), r"\W+", " ")), F.lower("source_name")))
    return N.first_seen(a, T.canonical_url(F.col("url")), title_key, "id").select("id")


def tokenised(spark, sf):
    """Token sets of all titles, stored once: weighting, blocking and assignment each read them."""
    return V.stored("tokenised", spark, sf, build_tokenised)


def build_tokenised(spark, sf):
    return articles(spark, sf).filter("published is not null").select("id", "published", T.title_tokens(F.col("title"), R.STOP).alias("tokens"), (F.col("source_name") == FILINGS).alias("filing"))


_STOPL = ", ".join(f"'{s}'" for s in R.STOP)
_TOK = W + _ART + f""", tk AS (SELECT id, CAST(epoch(published) AS BIGINT) AS t, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPL})))) AS ts FROM ar WHERE published IS NOT NULL),
fq AS (SELECT token, count(*) AS df FROM (SELECT unnest(ts) AS token FROM tk) GROUP BY 1), idf AS (SELECT token, df, ln((1 + (SELECT count(*) FROM tk)) / (1 + df)) + 1 AS w FROM fq)"""


@query("idf", _TOK + f" SELECT token, df, {r('w','idf')} FROM idf")
def idf(spark, sf):
    return N.token_weights(tokenised(spark, sf)).withColumn("idf", tidy(F.col("idf")))


_NODE = _TOK + """, kx AS (SELECT id, t, array_to_string(ts, ' ') AS key, ts FROM tk WHERE len(ts) >= 3), bx AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, id) <= 259200 THEN 0 ELSE 1 END AS nw FROM kx), ix AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY t, id) AS rn FROM bx),
nd AS (SELECT key, rn, min(id) AS node, min(t) AS t0, max(t) AS t1, any_value(ts) AS ts FROM ix GROUP BY 1, 2), nw AS (SELECT node, sum(w) AS total FROM (SELECT node, unnest(ts) AS token FROM nd) JOIN idf USING (token) GROUP BY 1),
pr AS (SELECT a.node AS a, b.node AS b, list_intersect(a.ts, b.ts) AS sh, least(wa.total, wb.total) AS mn FROM nd a JOIN nd b ON a.node < b.node AND b.t0 <= a.t1 + 259200 AND a.t0 <= b.t1 + 259200 AND len(list_intersect(a.ts, b.ts)) >= 2 JOIN nw wa ON wa.node = a.node JOIN nw wb ON wb.node = b.node),
sm AS (SELECT a, b, len(sh) AS shared, (SELECT sum(w) FROM (SELECT unnest(sh) AS token) JOIN idf USING (token)) / mn AS sim FROM pr), eg AS (SELECT * FROM sm WHERE sim >= 0.5 - 1e-12)"""


_PAIRS = _TOK + """, kx AS (SELECT DISTINCT id, t, ts FROM tk WHERE len(ts) >= 3), kw AS (SELECT ts, sum(w) AS total FROM (SELECT ts, unnest(ts) AS token FROM (SELECT DISTINCT ts FROM kx)) JOIN idf USING (token) GROUP BY 1),
kt AS (SELECT id, t, ts, total FROM kx JOIN kw USING (ts)), pr AS (SELECT a.id AS a, b.id AS b, list_intersect(a.ts, b.ts) AS sh, least(a.total, b.total) AS mn FROM kt a JOIN kt b ON a.id < b.id AND abs(a.t - b.t) <= 259200 AND len(list_intersect(a.ts, b.ts)) >= 2),
eg AS (SELECT * FROM (SELECT a, b, len(sh) AS shared, (SELECT sum(w) FROM (SELECT unnest(sh) AS token) JOIN idf USING (token)) / mn AS sim FROM pr) WHERE sim >= 0.5 - 1e-12)"""


@query("headline_sim", _PAIRS + f" SELECT a, b, CAST(shared AS INTEGER) AS shared, {r('sim','similarity')} FROM eg")
def headline_sim(spark, sf):
    """Every pair of articles, copies of one headline too."""
    a = tokenised(spark, sf)
    nodes, members = N.headline_nodes(a, N.token_weights(a))
    return N.similar_nodes(nodes, members=members).withColumn("similarity", tidy(F.col("similarity")))


@query("news_clusters", _NODE + """, e2 AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg UNION SELECT node, node FROM nd), re AS (SELECT a, b FROM e2 UNION SELECT re.a, e2.b FROM re JOIN e2 ON e2.a = re.b), cp AS (SELECT a AS node, min(b) AS cluster FROM re GROUP BY 1)
SELECT tk.id, coalesce(cp.cluster, tk.id) AS cluster FROM tk LEFT JOIN ix ON ix.id = tk.id LEFT JOIN nd ON nd.key = ix.key AND nd.rn = ix.rn LEFT JOIN cp ON cp.node = nd.node""")
def news_clusters(spark, sf):
    """Components at similarity 0.5 (before the vocabulary merge)."""
    return N.clusters(tokenised(spark, sf).drop("filing"), merge=False)


FILINGS = "src3"  # this source's articles count as filings
MERGE_ROUNDS = 4  # rounds written out in SQL; one more than the given tables need changes nothing


def _merge_round(k: int) -> str:
    """SQL of one round: clusters c{k} to c{k + 1}."""
    return f""", sz{k} AS (SELECT cluster, count(*) AS n, min(t) AS t0 FROM c{k} GROUP BY 1), vw{k} AS (SELECT cluster, token, count(*) AS c FROM (SELECT cluster, unnest(ts) AS token FROM c{k}) GROUP BY 1, 2),
vo{k} AS (SELECT cluster, t0, list(token) AS vs, list(token) FILTER (w >= 2.5) AS vr, sum(w) AS total FROM vw{k} JOIN sz{k} USING (cluster) JOIN idf USING (token) WHERE c >= greatest(1, n // 3) GROUP BY 1, 2),
pa{k} AS (SELECT a.cluster AS a, b.cluster AS b, list_intersect(a.vs, b.vs) AS sh, least(a.total, b.total) AS mn FROM vo{k} a JOIN vo{k} b ON a.cluster < b.cluster AND abs(a.t0 - b.t0) <= 259200 AND len(list_intersect(a.vr, b.vr)) >= 2 AND len(list_intersect(a.vs, b.vs)) >= 3),
ed{k} AS (SELECT a, b FROM pa{k} WHERE (SELECT sum(w) FROM (SELECT unnest(sh) AS token) JOIN idf USING (token)) / mn >= 0.45 - 1e-12),
ee{k} AS (SELECT a, b FROM ed{k} UNION SELECT b, a FROM ed{k} UNION SELECT a, a FROM ed{k} UNION SELECT b, b FROM ed{k}), rc{k} AS (SELECT a, b FROM ee{k} UNION SELECT rc{k}.a, ee{k}.b FROM rc{k} JOIN ee{k} ON ee{k}.a = rc{k}.b),
to{k} AS (SELECT a AS cluster, min(b) AS target FROM rc{k} GROUP BY 1), c{k + 1} AS MATERIALIZED (SELECT id, t, ts, coalesce(target, cluster) AS cluster FROM c{k} LEFT JOIN to{k} USING (cluster))"""


_MERGED = _NODE.replace("tk AS (SELECT id,", f"tk AS (SELECT id, source_name = '{FILINGS}' AS filing,").replace("FROM tk WHERE len(ts) >= 3", "FROM tk WHERE NOT filing AND len(ts) >= 3") + """, e2 AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg UNION SELECT node, node FROM nd), re AS (SELECT a, b FROM e2 UNION SELECT re.a, e2.b FROM re JOIN e2 ON e2.a = re.b), cp AS (SELECT a AS node, min(b) AS cluster FROM re GROUP BY 1),
c0 AS MATERIALIZED (SELECT tk.id, tk.t, tk.ts, coalesce(cp.cluster, tk.id) AS cluster FROM tk LEFT JOIN ix ON ix.id = tk.id LEFT JOIN nd ON nd.key = ix.key AND nd.rn = ix.rn LEFT JOIN cp ON cp.node = nd.node WHERE NOT filing)""" + "".join(_merge_round(k) for k in range(MERGE_ROUNDS))


@query("news_clusters_merged", _MERGED + f" SELECT id, cluster FROM c{MERGE_ROUNDS} UNION ALL SELECT id, id FROM tk WHERE filing")
def news_clusters_merged(spark, sf):
    """Clusters after merging by vocabulary until nothing merges; filings stay their own records."""
    return N.clusters(tokenised(spark, sf))


# --- events from headlines worded from orders ----------------------------------------------------------

_HEAD = {
    0: "'Rigetti wins contract award from Department of Energy worth ' || {p} || ' million'", 1: "'Rigetti quarterly results: revenue up ' || {p} || '% and outlook raised'", 2: "'Fund buys ' || {p} || ' shares of Rigetti'",
    3: "'White House weighs export controls on quantum chips'", 4: "'Rigetti sued over patent infringement, jury verdict expected'", 5: "'5 stocks to buy now including Rigetti'", 6: "'Rigetti unveils new processor with ' || {p} || ' qubits'",
    7: "'Analysts lift price target for Rigetti to ' || {p}", 8: "'Quantum sector peers rally'", 9: "'Rigetti shares drift in quiet session'",
}
_TYPES = ["primary_company", "reporting", "aggregator", "primary_regulatory", "aggregator"]
_DOMAINS = ["reuters.com", "example.com", "fool.com", "cnbc.com", "src.example.com"]


def headlines(spark, sf):
    """Categorised headlines, stored once for the event operators."""
    return V.stored("headlines", spark, sf, build_headlines)


def build_headlines(spark, sf):
    """One headline per order; the orders of a customer in a year form one development."""
    case = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {v.format(p='cast(o_orderkey % 89 + 1 as string)')}" for k, v in _HEAD.items()) + " END"
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = V.spread(V.table(spark, sf, "orders"))
    x = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).cast("string").alias("company"), F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("cluster"), F.expr(case).alias("title"), F.lit(None).cast("string").alias("summary"),
                 F.col("o_orderdate").cast("timestamp").alias("published"), pick(_TYPES).alias("source_type"), pick(_DOMAINS).alias("source_domain"), F.concat(F.lit("Desk "), (F.col("o_orderkey") % 7).cast("string")).alias("source_name"))
    return x.withColumns({"categories": N.categories(F.col("title"), F.col("summary")), "in_title": F.lower("title").contains("rigetti"), "own_record": F.col("id") % 11 == 0})


EV_NOW = "2001-08-02 00:00:00"
_HL = "hl AS (SELECT o_orderkey AS id, CAST(o_custkey % 20 AS VARCHAR) AS company, o_custkey || '-' || year(o_orderdate) AS cluster, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {v.format(p='CAST(o_orderkey % 89 + 1 AS VARCHAR)')}" for k, v in _HEAD.items()) + \
    f" END AS title, o_orderdate AS published, ({_TYPES})[o_orderkey % 5 + 1] AS source_type, ({_DOMAINS})[o_orderkey % 5 + 1] AS source_domain, 'Desk ' || (o_orderkey % 7) AS source_name, o_orderkey % 11 = 0 AS own FROM orders)"
_CATX = f"CASE WHEN regexp_matches(title, '{_re2(R.OWNERSHIP)}', 'i') THEN ['Ownership filings'] WHEN len({_hits('title', R.NEWS_CATEGORIES)}) > 0 THEN {_hits('title', R.NEWS_CATEGORIES)} ELSE ['Other'] END"
_EVT = W + _HL + f""", hc AS (SELECT *, {_CATX} AS cats FROM hl),
lead1 AS (SELECT cluster, arg_min(list_filter(cats, lambda z: z <> 'Other')[1], (CASE source_type WHEN 'primary_company' THEN 0 WHEN 'primary_regulatory' THEN 1 WHEN 'reporting' THEN 2 ELSE 3 END, CASE WHEN source_domain IN ('reuters.com', 'cnbc.com') THEN 0 ELSE 1 END, published, id)) FILTER (len(list_filter(cats, lambda z: z <> 'Other')) > 0) AS named, arg_min(id, (CASE source_type WHEN 'primary_company' THEN 0 WHEN 'primary_regulatory' THEN 1 WHEN 'reporting' THEN 2 ELSE 3 END, CASE WHEN source_domain IN ('reuters.com', 'cnbc.com') THEN 0 ELSE 1 END, published, id)) AS lead, min(published) AS first, bool_or(contains(lower(title), 'rigetti')) AS t, bool_or(own) AS o,
  bool_or(source_type IN ('primary_company', 'primary_regulatory')) AS p, bool_or(source_domain IN ('reuters.com', 'cnbc.com')) AS m, count(DISTINCT lower(source_name)) AS publishers, list_sort(list_distinct(flatten(list(cats)))) AS c0 FROM hc GROUP BY 1),
ev1 AS (SELECT l.*, h.title, h.cats AS lc, h.company, CASE WHEN len(c0) > 1 THEN list_filter(c0, lambda z: z <> 'Other') ELSE c0 END AS cs, (epoch(TIMESTAMP '{EV_NOW}') - epoch(first)) / 3600 AS age FROM lead1 l JOIN hc h ON h.id = l.lead),
ev2 AS (SELECT *, list_transform(cs, lambda z: coalesce(map([{', '.join(chr(39) + k + chr(39) for k in R.CATEGORY_WEIGHT)}], [{', '.join(str(float(v)) for v in R.CATEGORY_WEIGHT.values())}])[z], 0.0)::DOUBLE) AS ws FROM ev1),
ev AS (SELECT *, CASE WHEN t THEN 4.0 WHEN o THEN 2.0 ELSE -2.0 END + CASE WHEN p THEN 3 ELSE 0 END + CASE WHEN list_min(ws) < 0 THEN list_min(ws) ELSE list_max(ws) END + CASE WHEN publishers > 1 THEN least(log2(publishers) * 1.5, 4) ELSE 0 END + CASE WHEN m THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(title, '{_re2(R.LISTICLE)}', 'i') THEN -2 ELSE 0 END + CASE WHEN age <= 24 THEN 1 WHEN age <= 168 THEN 0.5 ELSE 0 END AS score FROM ev2)"""


def events(spark, sf):
    return N.relevance(headlines(spark, sf), F.lit(EV_NOW).cast("timestamp"))


@query("news_category", W + _HL + f" SELECT id, array_to_string({_CATX}, ',') AS categories, coalesce(({_hits('title', R.GOV_KINDS)})[1], 'Report') AS gov_kind FROM hl")
def news_category(spark, sf):
    h = build_headlines(spark, sf)
    return h.select("id", F.array_join("categories", ",").alias("categories"), T.first_match(F.col("title"), R.GOV_KINDS, "Report").alias("gov_kind"))


@query("relevance", _EVT + f" SELECT cluster, lead, CASE WHEN lc[1] <> 'Other' THEN lc[1] ELSE coalesce(named, 'Other') END AS category, array_to_string(cs, ',') AS categories, publishers, {r('score','score')}, score >= 5 AND NOT list_contains(cs, 'Ownership filings') AS material, CASE WHEN age <= 24 THEN 'today' WHEN age <= 168 THEN 'week' ELSE 'month' END AS bucket FROM ev")
def relevance(spark, sf):
    return events(spark, sf).select("cluster", "lead", "category", "categories", "publishers", tidy(F.col("score")).alias("score"), "material", "bucket")


@query("topk_news", _EVT + f""", q AS (SELECT company, cluster, score, first, unnest(list_filter([CASE WHEN age <= 24 THEN 'today' END, CASE WHEN age <= 168 THEN 'week' END, CASE WHEN age <= 720 THEN 'month' END], lambda z: z IS NOT NULL)) AS list FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY company, list ORDER BY round(score, 1) DESC, first DESC, cluster) AS rank FROM q) SELECT company, list, CAST(rank AS INTEGER) AS rank, cluster, {r('score','score')} FROM k WHERE rank <= CASE list WHEN 'today' THEN 5 WHEN 'week' THEN 8 ELSE 10 END""")
def topk_news(spark, sf):
    return N.top_news(events(spark, sf), F.lit(EV_NOW).cast("timestamp")).withColumn("score", tidy(F.col("score")))


@query("event_store", _EVT + f""", al AS (SELECT cluster AS id, 1 AS stored_at, score, first FROM ev WHERE score >= 5 AND NOT list_contains(cs, 'Ownership filings') UNION ALL SELECT cluster, 2, score + 1, first FROM ev WHERE score >= 5 AND NOT list_contains(cs, 'Ownership filings') AND publishers > 2),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stored_at DESC) AS rn FROM al) SELECT id, stored_at, {r('score','score')} FROM k WHERE rn = 1 AND CAST(first AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'""")
def event_store(spark, sf):
    e = V.stored("material_events", spark, sf, lambda spark, sf: events(spark, sf).filter("material").select("cluster", "published", "publishers", "score"))  # read by both batches
    old = e.select(F.col("cluster").alias("id"), F.lit(1).alias("stored_at"), "score", "published")
    new = e.filter("publishers > 2").select(F.col("cluster").alias("id"), F.lit(2).alias("stored_at"), (F.col("score") + 1).alias("score"), "published")
    return A.events_between(A.store_events(old, new), "1999-01-01", "2000-12-31").select("id", "stored_at", tidy(F.col("score")).alias("score"))


# --- search results ------------------------------------------------------------------------------------

_HOSTS = ["www.sec.gov", "ir.example.com", "prnewswire.com", "uk.reuters.com", "techcrunch.com", "old.reddit.com", "fool.com", "unknown.example.org"]


def results(spark, sf):
    """Search results worded from pages: eight hosts in turn, five pages sharing a path."""
    p = V.table(spark, sf, "pages")
    k = F.col("page_id")
    host = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (k % 8 + 1).cast("int"))
    scheme = F.when(k % 13 == 0, "ftp").otherwise("https")
    return p.select(k.alias("position"), F.concat(scheme, F.lit("://"), host, F.lit("/p/"), (k % 40).cast("string"), F.lit("/?q="), k.cast("string")).alias("url"), F.lit("Page").alias("title"), (F.length("html") % 3 != 0).alias("relevant"),
                    F.when(k % 4 == 0, "today").when(k % 4 == 1, "week").when(k % 4 == 2, "older").otherwise("undated").alias("bucket"), F.when(k % 4 != 3, F.timestamp_seconds(k * 3600)).alias("published"))


_QL = [0, 0, 0, 1, 2, 4, 3, 3]
_RES = W + f"""rs AS (SELECT page_id AS position, CASE WHEN page_id % 13 = 0 THEN 'ftp' ELSE 'https' END AS scheme, ({_HOSTS})[page_id % 8 + 1] AS host, page_id % 40 AS pa, length(html) % 3 <> 0 AS relevant, page_id % 4 AS b, ({_QL})[page_id % 8 + 1] AS quality FROM pages),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, pa ORDER BY position) AS rn FROM rs WHERE scheme = 'https') WHERE rn = 1)"""


@query("source_quality", _RES + " SELECT position, quality FROM rs")
def source_quality(spark, sf):
    return results(spark, sf).select("position", N.source_quality(T.host(F.col("url"))).alias("quality"))


@query("search_rank", _RES + " SELECT position, quality FROM cl ORDER BY relevant DESC, b, quality, position LIMIT 12")
def search_rank(spark, sf):
    return N.rank_results(N.clean_results(results(spark, sf), "position")).select("position", "quality")


@query("ingest_results", _RES + " SELECT position, CASE quality WHEN 0 THEN 'primary_company' WHEN 1 THEN 'reporting' ELSE 'aggregator' END AS source_type FROM cl WHERE b <> 3 AND quality < 4 AND relevant")
def ingest_results(spark, sf):
    return N.results_to_articles(N.clean_results(results(spark, sf), "position")).select("position", "source_type")
