"""News: normalising, filtering, de-duplication, clustering into events, relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import ordered as O
from tidemark.operators import similar as S
from tidemark.operators.graph import connected_components
from tidemark.session import cut_lineage, release

# Fixed values.
WINDOW_DAYS, FUTURE_HOURS = 30, 3
CLUSTER_SECONDS = 72 * 3600
SIMILARITY, MERGE_SIMILARITY, RARE_IDF = 0.5, 0.45, 2.5
MIN_TOKENS = 3
OFTEN = 64  # more titles than these hold a frequent token
SUMMARY_MIN, PREVIEW = 30, 400
PRIMARY_TYPES = ["primary_company", "company", "primary_regulatory", "primary_government"]


def normalize(raw: DataFrame) -> DataFrame:
    """Clean title and summary; a summary that begins with the title or is too short is dropped.  ``preview`` is its beginning."""
    title, s = T.strip_tags(F.col("title")), T.strip_tags(F.col("summary"))
    x = raw.withColumn("title", title).withColumn("summary", s).filter(F.col("title").isNotNull() & F.col("url").isNotNull() & (F.col("url") != ""))
    repeats = F.startswith(F.lower("summary"), F.lower("title"))
    short = F.length("summary") < SUMMARY_MIN
    x = x.withColumn("summary", F.when(~repeats & ~short, F.col("summary"))).withColumn("preview", F.substring("summary", 1, PREVIEW))
    dom = T.host(F.col("url"))
    return x.withColumn("url", T.strip(F.col("url"))).withColumn("source_domain", F.nullif(dom, F.lit(""))).withColumn("source_name", F.coalesce(F.nullif(T.strip(F.col("source_name")), F.lit("")), F.nullif(dom, F.lit("")), F.lit("Unknown")))


def drop_reason(published: Column, about: Column, now: Column) -> Column:
    """undated / old_or_future / not_about_company, or null when the article stays."""
    old = published < now - F.expr(f"interval {WINDOW_DAYS} days")
    ahead = published > now + F.expr(f"interval {FUTURE_HOURS} hours")
    return F.when(published.isNull(), "undated").when(old | ahead, "old_or_future").when(~about, "not_about_company")


def first_seen(articles: DataFrame, key_a: Column, key_b: Column, order: str) -> DataFrame:
    """Greedy first-seen: an article stays unless an earlier *kept* one shares either key.

    Articles agreeing in both keys are reduced to the first by a map-side aggregate, so copies cost
    nothing.  Each round keeps the articles that lead both of their groups and removes whatever
    shares a key with them; only narrow (keys, order) rows circulate, checkpointed per round, until none is open.
    """
    keyed = articles.select(key_a.alias("_a"), key_b.alias("_b"), F.col(order).alias("_o"))
    open_ = cut_lineage(keyed.groupBy("_a", "_b").agg(F.min("_o").alias("_o")))
    kept = None
    while True:
        fa = open_.groupBy("_a").agg(F.min("_o").alias("_fa"))
        fb = open_.groupBy("_b").agg(F.min("_o").alias("_fb"))
        win = open_.join(fa, "_a").join(fb, "_b").filter("_o = _fa and _o = _fb").select("_a", "_b", "_o")
        win = cut_lineage(win)
        kept = win if kept is None else kept.unionByName(win)
        before, open_ = open_, cut_lineage(open_.join(win.select("_a"), "_a", "left_anti").join(win.select("_b"), "_b", "left_anti"))
        release(before)
        if not open_.limit(1).count():
            return articles.join(kept.select(F.col("_o").alias(order)), order, "left_semi")


def categories(title: Column, summary: Column) -> Column:
    """Ownership first, then every headline rule, else the summary rules that do not mention in passing."""
    body, soft = F.coalesce(summary, F.lit("")), [r for r in R.NEWS_CATEGORIES if r[0] not in R.SUMMARY_SKIPS]
    x = F.when(title.rlike("(?i)" + R.OWNERSHIP), F.array(F.lit("Ownership filings"))).when(T.any_rule(title, R.NEWS_CATEGORIES), T.each_rule(title, R.NEWS_CATEGORIES))  # each rule once for a title
    return x.when(T.any_rule(body, soft), T.each_rule(body, soft)).otherwise(F.array(F.lit("Other")))


def token_weights(articles: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Inverse document frequency over the batch: ln((1 + N) / (1 + df)) + 1."""
    n = articles.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = articles.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def _weighed() -> Column:
    return F.expr(f"struct(-idf as neg, token, df > {OFTEN} as often)")


def headline_nodes(articles: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct token sets with a stretch of time in which neighbours lie within 72 hours, and the articles that have them.

    All copies of a headline become one node before any comparison.  Two such nodes hold a pair of
    articles within 72 hours exactly when their time ranges lie within 72 hours of each other; ``members(id, node, k, t, n)`` tells which.
    """
    x = articles.filter(F.size("tokens") >= MIN_TOKENS).withColumn("key", F.md5(F.array_join(F.array_sort("tokens"), " ")))
    x = x.withColumn("t", F.unix_seconds("published")).withColumn("_day", F.to_date("published"))
    # Copies in the same second are one row for the time islands, however many there are.
    s = x.groupBy("key", "_day", "t").agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"))
    s = cut_lineage(O.islands(cut_lineage(s), ["key"], "_day", "t", CLUSTER_SECONDS))
    n = s.groupBy("key", "run_no").agg(F.min("rep").alias("node"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.first("tokens").alias("tokens"))
    n = n.withColumn("k", F.xxhash64("key"))  # rows of one id may have several titles
    w = n.select("node", "k", F.explode("tokens").alias("token")).join(weights.select("token", "idf", "df"), "token")
    w = w.groupBy("node", "k").agg(F.sort_array(F.collect_list(_weighed())).alias("tw"), F.sum("idf").alias("total"))  # the tokens of one title
    n = cut_lineage(n.drop("tokens").join(w.hint("merge"), ["node", "k"]))
    members = x.join(s.select("key", "t", "run_no"), ["key", "t"]).join(n.select("key", "run_no", "node", "k"), ["key", "run_no"]).select("id", "node", "k", "t", F.size("tokens").alias("n"))
    return n.select("node", "k", "t0", "t1", "tw", "total"), members


def similar_nodes(nodes: DataFrame, threshold: float = SIMILARITY, min_shared: int = 2, rare: float | None = None, linked: bool = False, members: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes within 72 hours sharing enough weight of the lighter one: (a, b, shared, similarity).

    With ``members`` the pairs are those of their articles, each within 72 hours, copies of one headline too.
    ``linked``: pairs (a, b) that connect the same components, in every cell of the product one less than it connects nodes.
    Where nodes have a column ``fresh``, pairs of two that are not are left out.
    """
    x = nodes.withColumns({"k": F.col("k") if "k" in nodes.columns else F.xxhash64("node"), "fresh": F.col("fresh") if "fresh" in nodes.columns else F.lit(True)})
    if members is None:
        packed = S.blocks(x.withColumns({"id": F.col("node"), "n": F.size("tw")}), CLUSTER_SECONDS)
    else:
        packed = S.blocks(cut_lineage(members.select("node", "k", "id", F.col("t").alias("t0"), F.col("t").alias("t1"), "n")), CLUSTER_SECONDS, x)
    found = S.pairs(packed, nodes.schema["node"].dataType.simpleString(), CLUSTER_SECONDS, threshold, min_shared, rare, linked)
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *found.columns[2:])


def clusters(articles: DataFrame, merge: bool = True) -> DataFrame:
    """(id, cluster): articles linked through similar headlines, then clusters with overlapping rare vocabulary merged until none is left.

    Order-independent: components of the similarity graph instead of a first-come assignment.
    Articles with fewer than three tokens stay alone, and so do filings (where there is a column ``filing``): each is its own record, though its words
    count for the weights.
    """
    weights = cut_lineage(token_weights(articles))
    news = articles.filter(~F.col("filing")) if "filing" in articles.columns else articles
    nodes, members = headline_nodes(news, weights)
    comp = connected_components(similar_nodes(nodes, linked=True), nodes.select(F.col("node").alias("id"))).select(F.col("id").alias("node"), "component")
    own = cut_lineage(news.select("id", "published", "tokens").join(members.select("id", "node"), "id", "left").join(comp, "node", "left").select("id", "published", "tokens", F.coalesce("component", "id").alias("cluster")))
    out = merge_until_stable(own, weights)[0] if merge else own.select("id", "cluster")
    return out.unionByName(articles.filter("filing").select("id", F.col("id").alias("cluster"))) if "filing" in articles.columns else out


def vocabularies(own: DataFrame, weights: DataFrame) -> DataFrame:
    """Clusters as nodes: the words of at least a third of their articles, and the time of the first one."""
    size = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds("published")).alias("t0"))
    vocab = own.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("c")).join(size, "cluster")
    vocab = vocab.filter(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3))).join(weights.select("token", "idf", "df"), "token")
    n2 = vocab.groupBy("cluster", "t0").agg(F.sort_array(F.collect_list(_weighed())).alias("tw"), F.sum("idf").alias("total"))
    return n2.select(F.col("cluster").alias("node"), "t0", F.col("t0").alias("t1"), "tw", "total")


def merge_until_stable(own: DataFrame, weights: DataFrame) -> tuple[DataFrame, list[int]]:
    """((id, cluster), clusters merged away in each round): ``own(id, published, tokens, cluster)`` merged round by round.

    A round links clusters whose vocabularies overlap on rare words and gives each component its smallest name; the vocabularies of
    what was merged are then taken anew and compared with all; what was not merged has no partner among the others.  Every round but the last merges something, so rounds end; the counts show how fast.
    """
    rounds, held = [], own
    nodes = cut_lineage(vocabularies(held, weights).withColumn("fresh", F.lit(True)))
    while True:
        edges = cut_lineage(similar_nodes(nodes, MERGE_SIMILARITY, 3, RARE_IDF, linked=True))
        if not edges.limit(1).count():
            release(edges), release(nodes)
            return held.select("id", "cluster"), rounds
        names = connected_components(edges, edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))))
        names = cut_lineage(names.select(F.col("id").alias("cluster"), F.col("component").alias("_to")))
        rounds.append(names.filter("cluster <> _to").count())
        before, held = held, cut_lineage(held.join(names, "cluster", "left").select("id", "published", "tokens", F.coalesce("_to", "cluster").alias("cluster")))
        merged = vocabularies(held.join(names.select(F.col("_to").alias("cluster")).distinct(), "cluster", "left_semi"), weights).withColumn("fresh", F.lit(True))
        others = nodes.join(names.select(F.col("cluster").alias("node")), "node", "left_anti").withColumn("fresh", F.lit(False))
        old, nodes = nodes, cut_lineage(others.unionByName(merged))
        for t in (old, edges, names, before if len(rounds) > 1 else None):
            release(t)


def source_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in R.SOURCE_RANK.items()], F.lit(3))


def relevance(articles: DataFrame, now: Column) -> DataFrame:
    """One event per cluster: lead article, points with their reasons, material or not.

    All inputs of the score are associative aggregates, so a cluster of any size combines map-side.
    """
    major = F.col("source_domain").isin(R.MAJOR_OUTLETS)
    a = articles.withColumn("_major", F.coalesce(major, F.lit(False))).withColumn("_primary", F.col("source_type").isin(PRIMARY_TYPES))
    rank = F.struct(source_rank(F.col("source_type")).alias("r"), F.when(F.col("_major"), 0).otherwise(1).alias("m"), F.col("published").alias("t"), F.col("id").alias("i"))
    named = F.get(F.filter("categories", lambda c: c != "Other"), F.lit(0))  # an article's first category with a name
    g = a.groupBy("cluster").agg(
        F.min_by(named, F.when(named.isNotNull(), rank)).alias("_named"), F.min_by(F.struct("id", "title", "categories", "company"), rank).alias("lead"), F.min("published").alias("first"), F.bool_or("in_title").alias("_t"), F.bool_or("own_record").alias("_o"),
        F.bool_or("_primary").alias("_p"), F.bool_or("_major").alias("_m"), F.count_distinct(F.lower("source_name")).alias("publishers"), F.array_distinct(F.flatten(F.collect_set("categories"))).alias("_cats"))
    cats = F.when(F.size("_cats") > 1, F.filter("_cats", lambda c: c != "Other")).otherwise(F.col("_cats"))
    weight = F.create_map(*[v for k, w in R.CATEGORY_WEIGHT.items() for v in (F.lit(k), F.lit(float(w)))])
    g = g.withColumn("cats", F.array_sort(cats)).withColumn("_w", F.transform("cats", lambda c: F.coalesce(F.try_element_at(weight, c), F.lit(0.0))))
    cat_points = F.when(F.array_min("_w") < 0, F.array_min("_w")).otherwise(F.array_max("_w"))
    age = (F.unix_seconds(now) - F.unix_seconds("first")) / 3600
    points = {
        "headline": F.when(F.col("_t"), 4.0).when(F.col("_o"), 2.0).otherwise(-2.0), "primary": F.when(F.col("_p"), 3.0).otherwise(0.0), "category": cat_points,
        "publishers": F.when(F.col("publishers") > 1, F.least(F.log2("publishers") * 1.5, F.lit(4.0))).otherwise(0.0), "outlet": F.when(F.col("_m"), 1.0).otherwise(0.0),
        "listicle": F.when(F.col("lead.title").rlike("(?i)" + R.LISTICLE), -2.0).otherwise(0.0), "recency": F.when(age <= 24, 1.0).when(age <= 168, 0.5).otherwise(0.0),
    }
    score = sum(points.values(), F.lit(0.0))
    why = F.filter(F.array(*[F.when(v != 0, F.lit(k)) for k, v in points.items()]), lambda r: r.isNotNull())
    lead_cat = F.col("lead.categories")[0]
    primary = F.when(lead_cat != "Other", lead_cat).otherwise(F.coalesce("_named", F.lit("Other")))  # else of the next source in order
    return g.select(
        "cluster", F.col("lead.company").alias("company"), F.col("lead.id").alias("lead"), F.col("lead.title").alias("headline"), primary.alias("category"), F.array_join("cats", ",").alias("categories"), F.col("first").alias("published"),
        "publishers", score.alias("score"), F.array_join(why, ",").alias("reasons"), ((score >= 5) & ~F.array_contains("cats", "Ownership filings")).alias("material"), F.when(age <= 24, "today").when(age <= 168, "week").otherwise("month").alias("bucket"))


# List name -> (days back, size).
TOP_LISTS = {"today": (1, 5), "week": (7, 8), "month": (30, 10)}


def top_news(events: DataFrame, now: Column) -> DataFrame:
    """The most relevant events of the day, week and month per company (a top-k report).

    Ranked inside hash slices first, so a company with most of the news does not sort it in one task.
    """
    age = F.unix_seconds(now) - F.unix_seconds("published")
    lists = F.filter(F.array(*[F.when(age <= d * 86400, F.struct(F.lit(k).alias("list"), F.lit(n).alias("size"))) for k, (d, n) in TOP_LISTS.items()]), lambda x: x.isNotNull())
    x = events.select("company", "cluster", "score", "published", F.explode(lists).alias("l")).select("company", "cluster", "score", "published", "l.*")
    order = [F.desc(F.round("score", 1)), F.desc("published"), F.col("cluster")]
    x = x.withColumn("_s", F.pmod(F.xxhash64("cluster"), F.lit(32)))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("company", "list", "_s").orderBy(*order))).filter("_r <= size")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("company", "list").orderBy(*order))).filter("rank <= size")
    return x.select("company", "list", "rank", "cluster", "score")


def provider_status(articles: DataFrame, providers: Sequence[str], errors: Sequence[str] = ()) -> DataFrame:
    """ok / error / empty and the count for every registered provider."""
    c = articles.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    p = articles.sparkSession.createDataFrame([(x,) for x in providers], "provider string")
    x = p.join(c, "provider", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("status", F.when(F.col("provider").isin(list(errors)), "error").when(F.col("n") == 0, "empty").otherwise("ok"))


# --- search results ------------------------------------------------------------------------------------

def _under(domain: Column, names: Sequence[str]) -> Column:
    return domain.rlike("(^|\\.)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$")


def source_quality(domain: Column, company_domain: str | None = None) -> Column:
    """0 primary record, 1 wire or major outlet, 2 industry press, 3 commentary or unknown, 4 social."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    gov = _under(d, ["sec.gov", "europa.eu"]) | d.rlike(r"\.(gov|mil|gov\.uk)$")
    own = _under(d, [company_domain]) if company_domain else F.lit(False)
    ir = d.rlike(r"^(ir|investors?|investor-relations|press|newsroom|news)\.")
    return F.when(gov | own | ir | _under(d, R.WIRES), 0).when(_under(d, R.REPORTING), 1).when(_under(d, R.INDUSTRY), 2).when(_under(d, R.SOCIAL), 4).otherwise(3)


def clean_results(results: DataFrame, order: str) -> DataFrame:
    """http(s) results only, the first of every host + path."""
    x = results.filter(F.col("url").rlike(r"^https?://") & (T.strip(F.col("title")) != ""))
    key = F.concat(T.host(F.col("url")), F.lower(F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")))
    rest = [c for c in results.columns]
    return O.first_rows(x.withColumn("_key", key), ["_key"], F.col(order), rest).drop("_key").withColumn("domain", T.host(F.col("url")))


def rank_results(results: DataFrame, limit: int = 12) -> DataFrame:
    """Relevant first, then recent buckets, better sources, arrival; the first twelve (a global top-k)."""
    bucket = F.when(F.col("bucket") == "today", 0).when(F.col("bucket") == "week", 1).when(F.col("bucket") == "older", 2).otherwise(3)
    x = results.withColumn("quality", source_quality(F.col("domain")))
    return x.orderBy(F.desc("relevant"), bucket, "quality", "position").limit(limit)


def results_to_articles(results: DataFrame) -> DataFrame:
    """Search results that may join the news: dated, relevant, not social; source type from the quality rank."""
    q = source_quality(F.col("domain"))
    x = results.withColumn("quality", q).filter(F.col("published").isNotNull() & (F.col("quality") < 4) & F.col("relevant"))
    return x.withColumn("source_type", F.when(F.col("quality") == 0, "primary_company").when(F.col("quality") == 1, "reporting").otherwise("aggregator"))
