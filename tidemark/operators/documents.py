"""Evidence from texts.  Work on sentences (doc_id, pos, sent); rules run inside projections, groups are per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import ordered as O
from tidemark.session import cut_lineage


def split_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence of each document."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(T.sentences(F.col(text))).alias("pos", "sent"))


def upto(df: DataFrame, top: int | None, rank: str = "rank") -> DataFrame:
    """All rows, or those up to a rank where a top-k is wanted."""
    return df if top is None else df.filter(F.col(rank) <= top)


def longest_section(text: Column, start: str, end: str, min_len: int) -> Column:
    """Longest span from a heading to the next end heading (which skips a table of contents).

    The text is cut at the end headings; inside each piece the longest span begins at the first
    heading, so one pass over the pieces is enough.
    """
    spans = F.transform(F.split(text, f"(?i)(?:{end})"), lambda piece: F.regexp_extract(piece, f"(?is)(?:{start}).*", 0))
    longest = F.array_max(F.transform(spans, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return F.when(longest["n"] >= min_len, longest["s"]).otherwise("")


def report_sections(docs: DataFrame, text: str = "text", shrink: int = 1) -> DataFrame:
    """risk / business / legal sections of annual reports; ``shrink`` divides the minimum lengths for short texts."""
    cols = {n: longest_section(F.col(text), a, b, m // shrink) for n, (a, b, m) in R.SECTIONS.items()}
    x = docs.withColumns(cols)
    a, b, m = R.SECTION_FALLBACK
    return x.withColumn("risk", F.when(F.col("risk") == "", longest_section(F.col(text), a, b, m // shrink)).otherwise(F.col("risk")))


def scoped_sentences(sections: DataFrame) -> DataFrame:
    """Sentences of the risk and business sections (of the whole text where there is neither) with their scope.

    (doc_id, pos, section, subsection, sent): ``pos`` runs over risk, then business; a business sentence in the reach of a
    Competition heading has that subsection.  Row-local: the headings cut the text into intervals.
    """
    reach = F.regexp_extract("business", r"\n\s*(?:" + "|".join(R.COMPETITION_HEADINGS) + r")\s*\n([\s\S]{0," + str(R.COMPETITION_REACH) + "})", 1)
    listed = T.sentences(reach)
    part = lambda where, sents: F.transform(sents, lambda s: F.struct(F.lit(where).alias("section"), F.when(F.lit(where == "Business") & F.array_contains("_listed", s), "Competition").alias("subsection"), s.alias("sent")))
    x = sections.withColumn("_listed", listed)
    both = F.concat(part("Risk factors", T.sentences(F.col("risk"))), part("Business", T.sentences(F.col("business"))))
    pool = F.when(F.size("_both") > 0, F.col("_both")).otherwise(part("Annual report", T.sentences(F.col("text"))))
    return x.withColumn("_both", both).select("doc_id", F.posexplode(pool).alias("pos", "s")).select("doc_id", "pos", "s.*")


def dependencies(scoped: DataFrame, own: DataFrame, evidence: int = 3) -> DataFrame:
    """What each document depends on: entity, ticker, kind, relation, other relations, mentions and the first pieces of evidence.

    ``own(doc_id, company, ticker)`` is the reporting company: entities with its ticker or a word of its name are left out.  A sentence gives
    the first two relations its wording states; where it stands under Competition the entity competes, whatever the wording.
    """
    rels = F.when(F.col("subsection") == "Competition", F.array(F.lit("Competitor"))).otherwise(F.slice(T.matched(F.col("sent"), R.RELATIONS), 1, 2))
    x = T.explode_matches(scoped, ["doc_id", "pos", "section", "subsection", "sent"], T.matched(F.col("sent"), R.ENTITIES, ignore_case=False), "entity")
    words = F.filter(F.regexp_extract_all(F.lower("company"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(R.COMPANY_WORDS))
    x = x.join(own.select("doc_id", words.alias("_own"), F.col("ticker").alias("_t")), "doc_id", "left")
    about = F.create_map(*[v for n, _, t, k in R.ENTITIES for v in (F.lit(n), F.struct(F.lit(t).cast("string").alias("ticker"), F.lit("government" if k == "government" else "company").alias("kind")))])
    x = x.withColumn("_a", F.try_element_at(about, F.col("entity")))
    x = x.filter(~F.coalesce(F.col("_a.ticker") == F.col("_t"), F.lit(False)) & ~F.coalesce(F.exists("_own", lambda w: F.lower("entity").contains(w)), F.lit(False)))
    x = x.select("doc_id", "entity", F.col("_a.ticker").alias("ticker"), F.col("_a.kind").alias("kind"), "pos", "section", "sent", F.posexplode_outer(rels).alias("_o", "relation")).filter(F.col("relation").isNotNull())
    # The sections are cut and read once: counts and evidence come from one aggregate over the sentences of one document.
    pieces = F.slice(F.sort_array(F.collect_list(F.struct("pos", "section", "sent"))), 1, evidence)
    g = x.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "entity", "ticker", "kind", "relation").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "_o")).alias("first"), pieces.alias("pieces"))
    order = F.struct((-F.col("n")).alias("n"), F.col("first.pos").alias("p"), F.col("first._o").alias("o"), F.col("relation").alias("relation"), F.col("pieces").alias("pieces"))
    d = g.groupBy("doc_id", "entity", "ticker", "kind").agg(F.sort_array(F.collect_list(order)).alias("_r"), F.sum("n").alias("mentions"))  # at most the known relations
    d = d.withColumns({"relation": F.get("_r", F.lit(0))["relation"], "_p": F.get("_r", F.lit(0))["pieces"]})
    later = F.sort_array(F.transform(F.filter("_r", lambda r: r["relation"] != F.col("relation")), lambda r: F.struct(r["p"].alias("p"), r["o"].alias("o"), r["relation"].alias("relation"))))
    d = d.withColumn("others", F.transform(later, lambda r: r["relation"])).drop("_r")
    return d.withColumn("evidence", F.transform("_p", lambda e: F.struct(e["section"].alias("section"), T.clip(e["sent"]).alias("text")))).drop("_p")


def rule_counts(sents: DataFrame, rules: Sequence[tuple], ignore_case: bool = True) -> DataFrame:
    """Sentences of each document matching each rule (macro topics, policy topics)."""
    x = T.explode_matches(sents, ["doc_id"], T.matched(F.col("sent"), rules, ignore_case), "topic")
    return x.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("mentions"))


def theme_counts(docs: DataFrame, rules: Sequence[tuple], text: str = "text") -> DataFrame:
    """Occurrences of each theme's terms per document with its strength: 5 mentioned, 15 emphasised."""
    parts = F.array(*[F.struct(F.lit(k).alias("theme"), F.regexp_count(F.col(text), F.lit("(?i)" + p)).alias("n")) for k, p in rules])
    x = docs.select("doc_id", F.explode(parts).alias("t")).select("doc_id", "t.*").filter("n > 0")
    return x.withColumn("strength", F.when(F.col("n") >= 15, "emphasized").when(F.col("n") >= 5, "mentioned"))


def entity_mentions(sents: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    x = T.explode_matches(sents, ["doc_id"], T.matched(F.col("sent"), rules, ignore_case=False), "entity")
    return x.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("sentences"))


def entity_relations(sents: DataFrame, own: Column | None = None, top: int | None = None) -> DataFrame:
    """Dominant relation of every named entity per document, with its rank by mentions; ``top`` keeps the first ranks only.

    ``own`` is the document's own company name; entities contained in it are left out.
    """
    ents = T.matched(F.col("sent"), R.ENTITIES, ignore_case=False)
    rels = T.matched(F.col("sent"), R.RELATIONS)
    x = sents.withColumns({"_e": ents, "_r": rels})
    if own is not None:
        x = x.withColumn("_e", F.filter("_e", lambda e: ~F.lower(own).contains(F.lower(e))))
    x = T.explode_matches(x, ["doc_id", "pos", "_r"], F.col("_e"), "entity")
    x = x.select("doc_id", "pos", "entity", F.posexplode_outer("_r").alias("_o", "relation")).filter("relation is not null")
    g = x.groupBy("doc_id", "entity", "relation").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "_o")).alias("first"))
    d = g.groupBy("doc_id", "entity").agg(F.sum("n").alias("mentions"), F.max_by("relation", F.struct(F.col("n"), (-F.col("first.pos")).alias("p"), (-F.col("first._o")).alias("o"))).alias("relation"))
    rk = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "entity"))  # at most one row per known entity
    return upto(d.withColumn("rank", rk), top)


def percent_facts(sents: DataFrame) -> DataFrame:
    """Stated concentrations ("22% of our revenue"): percent, base, subject and year, one per document."""
    s = F.col("sent")
    ok = ~s.rlike(r"^\s*\*") & ~s.rlike(r"(?i)less than \d") & s.rlike("(?i)" + R.PCT_OF) & s.rlike("(?i)" + R.PCT_QUALIFIER)
    x = sents.filter(ok)
    whole = F.regexp_extract_all(s, F.lit("(?i)" + R.PCT_OF), F.lit(0))
    x = x.select("doc_id", "pos", F.explode(whole).alias("m"), F.coalesce(F.nullif(F.regexp_extract(s, R.PCT_SUBJECT, 0), F.lit("")), F.lit("see sentence")).alias("subject"), F.regexp_extract(s, r"(20\d\d)", 1).alias("year"))
    x = x.select("doc_id", "pos", F.regexp_extract("m", "(?i)" + R.PCT_OF, 1).cast("double").alias("percent"), F.lower(F.regexp_extract("m", "(?i)" + R.PCT_OF, 2)).alias("of"), "subject", "year")
    return x.groupBy("doc_id", "percent", "of", "year").agg(F.min_by("subject", "pos").alias("subject"))


def geography_exposure(sents: DataFrame, minimum: int = 2, top: int | None = None) -> DataFrame:
    """Regions named in at least two sentences that also give a reason, ranked by mentions; all reasons, the main one first."""
    regs, whys = T.matched(F.col("sent"), R.GEOGRAPHIES, ignore_case=False), T.matched(F.col("sent"), R.GEO_REASONS)
    x = T.explode_matches(sents.withColumns({"_g": regs, "_w": whys}), ["doc_id", "pos", "_w"], F.col("_g"), "region").filter(F.size("_w") > 0)
    n = x.groupBy("doc_id", "region").agg(F.count(F.lit(1)).alias("mentions")).filter(F.col("mentions") >= minimum)
    order = {label: i for i, (label, _) in enumerate(R.GEO_REASONS)}
    w = x.select("doc_id", "region", "pos", F.explode("_w").alias("why")).groupBy("doc_id", "region", "why").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("_p"))
    o = F.coalesce(*[F.when(F.col("why") == k, F.lit(v)) for k, v in order.items()])
    best = w.groupBy("doc_id", "region").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "_p", o.alias("o"), "why"))).alias("s"))  # three reasons at most
    j = n.join(best, ["doc_id", "region"]).select("doc_id", "region", "mentions", F.array_join(F.transform("s", lambda e: e["why"]), ", ").alias("why"))
    rk = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "region"))
    return upto(j.withColumn("rank", rk), top)


def matters(paras: DataFrame) -> DataFrame:
    """Specific legal or regulatory matters with category and status; boilerplate and layoffs are left out, repeats merged."""
    s = F.col("sent")
    x = paras.filter(~s.rlike("(?i)" + R.MATTER_BOILERPLATE) & s.rlike("(?i)" + R.MATTER_SPECIFIC))
    x = x.withColumn("category", T.first_match(s, R.MATTER_CATEGORIES)).filter("category is not null and category <> 'Major layoffs / restructuring'")
    key = F.md5(F.regexp_replace(F.lower(s), r"\W+", ""))  # of the whole paragraph
    x = x.withColumn("status", T.first_match(s, R.MATTER_STATUS, "DISCLOSED")).withColumn("entity", T.first_match(s, R.GOV_ENTITIES, ignore_case=False))
    g = x.groupBy("doc_id", key.alias("_k")).agg(F.min_by(F.struct("pos", "category", "status", "entity"), "pos").alias("m"))
    return g.select("doc_id", "m.*")


def text_date(text: Column, fallback: Column) -> tuple[Column, Column]:
    """(date, whether its day is stated) of the first "Month day, year" or "Month year" in a text, else the fallback."""
    part = lambda g: F.nullif(F.regexp_extract(text, R.TEXT_DATE, g), F.lit(""))
    month = F.array_position(F.array(*[F.lit(m) for m in R.MONTHS]), part(1))
    day = F.regexp_extract(part(2), r"\d+", 0)
    found = F.try_make_timestamp(part(3).cast("int"), month.cast("int"), F.coalesce(day, F.lit("1")).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(found, fallback), found.isNotNull() & day.isNotNull()


def filing_matters(filings: DataFrame) -> DataFrame:
    """Matters that a filing's item codes (company, filed, items) report by themselves."""
    known = F.create_map(*[v for code, (c, s) in R.ITEM_MATTERS.items() for v in (F.lit(code), F.struct(F.lit(c).alias("category"), F.lit(s).alias("status")))])
    x = filings.select("company", "filed", F.explode("items").alias("code")).withColumn("m", F.try_element_at(known, F.col("code"))).filter("m is not null")
    return x.select("company", F.col("filed").alias("date"), F.lit(True).alias("exact"), "m.category", "m.status", F.lit(None).cast("string").alias("entity"), F.lit("filing").alias("origin"), F.concat(F.lit("Item "), "code").alias("source"))


def paragraph_matters(paragraphs: DataFrame) -> DataFrame:
    """Specific matters in legal paragraphs (company, filed, text), dated by their own wording."""
    s = F.col("text")
    x = paragraphs.filter(~s.rlike("(?i)" + R.MATTER_BOILERPLATE) & s.rlike("(?i)" + R.MATTER_SPECIFIC))
    x = T.explode_matches(x, x.columns, F.array(T.first_match(s, R.MATTER_CATEGORIES)), "category").filter("category <> 'Major layoffs / restructuring'")
    when, exact = text_date(s, F.col("filed"))
    return x.select("company", when.alias("date"), exact.alias("exact"), "category", T.first_match(s, R.MATTER_STATUS, "DISCLOSED").alias("status"), T.first_match(s, R.GOV_ENTITIES, ignore_case=False).alias("entity"), F.lit("annual report").alias("origin"), F.md5(F.regexp_replace(F.lower(s), r"\W+", "")).alias("source"))


def news_matters(news: DataFrame) -> DataFrame:
    """Adverse headlines (company, published, headline, summary, primary); only a primary source confirms an incident."""
    h, both = F.col("headline"), F.concat_ws(" ", "headline", "summary")
    x = news.filter(h.rlike("(?i)" + R.ADVERSE))
    x = T.explode_matches(x, x.columns, F.array(F.coalesce(T.first_match(h, R.MATTER_CATEGORIES), T.first_match(both, R.MATTER_CATEGORIES))), "category")
    status = T.first_match(h, R.MATTER_STATUS, "REPORTED")
    status = F.when((status == "CONFIRMED INCIDENT") & ~F.coalesce("primary", F.lit(False)), "REPORTED").otherwise(status)
    return x.select("company", F.to_date("published").alias("date"), F.lit(True).alias("exact"), "category", status.alias("status"), T.first_match(both, R.GOV_ENTITIES, ignore_case=False).alias("entity"), F.lit("news").alias("origin"), F.md5(F.lower(h)).alias("source"))


def linked_matters(parts: Sequence[DataFrame], days: int = 30) -> DataFrame:
    """One row per matter: evidence of one company, category and body whose dates follow each other within ``days``.

    (company, category, entity, first_date, last_date, exact, status, sources, origins): the status of the latest evidence (of one day the
    last by name), the number of distinct sources, the origins in order of name.  Undated evidence is a matter of its own.  Texts are read
    once: each source of a day is stored, days are counted from these before anything is ordered, and months are walked by their summaries.
    """
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.withColumn("entity", F.coalesce("entity", F.lit("")))
    keys = ["company", "category", "entity"]
    both = [F.max("status").alias("status"), F.bool_or("exact").alias("exact")]
    sources = cut_lineage(x.groupBy(*keys, "date", "origin", "source").agg(*both))
    day = sources.groupBy(*keys, "date").agg(*both)
    dated = day.filter("date is not null").withColumns({"_key": F.concat_ws("|", *keys), "_m": F.trunc("date", "month"), "_d": F.unix_date("date")})
    runs = O.islands(dated, ["_key"], "_m", "_d", days, "_run").select(*keys, "date", "status", "exact", "_run")
    runs = cut_lineage(runs.unionByName(day.filter("date is null").select(*keys, "date", "status", "exact", F.lit(None).cast("long").alias("_run"))))
    run = F.coalesce("_run", F.lit(-1)).alias("_run")
    same = lambda a: F.coalesce(a, F.lit("1900-01-01").cast("date"))
    seen = runs.select(*keys, run, same(F.col("date")).alias("_at")).join(sources.select(*keys, "origin", "source", same(F.col("date")).alias("_at")), [*keys, "_at"])
    seen = seen.groupBy(*keys, "_run").agg(F.count_distinct("origin", "source").alias("sources"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))  # three origins
    m = runs.groupBy(*keys, run).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.bool_or("exact").alias("exact"), F.max_by("status", F.struct("date", "status")).alias("status"))
    return m.join(seen, [*keys, "_run"]).select("company", "category", F.nullif("entity", F.lit("")).alias("entity"), "first_date", "last_date", "exact", "status", "sources", "origins")


def money(number: Column, unit: Column) -> Column:
    x = F.regexp_replace(number, ",", "").try_cast("double")
    return x * F.when(unit == "billion", 1e9).when(unit == "million", 1e6).otherwise(1.0)


def guided_values(s: Column, metric: Column) -> Column:
    """(low, high, unit) that a guidance sentence states for a metric: a range, a value with a tolerance, or one value; null without a number."""
    part = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    bps = r"(\d{1,2}(?:\.\d+)?)%\s*(?:,\s*)?plus or minus\s*(\d+)\s*basis points"
    pr, p1 = r"(\d{1,2}(?:\.\d+)?)%\s*(?:to|and|-|–)\s*(\d{1,2}(?:\.\d+)?)%", r"(\d{1,2}(?:\.\d+)?)%"
    mp, mr = R.MONEY + r"\s*,?\s*plus or minus\s*(\d+(?:\.\d+)?)%", R.MONEY + r"\s*(?:to|and|-|–)\s*" + R.MONEY
    num = lambda c: c.cast("double")
    pct = metric.isin("Gross margin", "Operating margin", "Tax rate")
    mid, off = num(part(bps, 1)), num(part(bps, 2)) / 100
    plow = F.coalesce(mid - off, num(part(pr, 1)), num(part(p1, 1)))
    phigh = F.coalesce(mid + off, num(part(pr, 2)), num(part(p1, 1)))
    share = metric == "EPS"
    mm, mv = money(part(mp, 1), part(mp, 2)), num(part(mp, 3)) / 100
    unit2 = F.coalesce(part(mr, 4), part(mr, 2))
    lo2, hi2 = money(part(mr, 1), F.coalesce(part(mr, 2), unit2)), money(part(mr, 3), unit2)
    one = money(part(R.MONEY, 1), part(R.MONEY, 2))
    mlow = F.coalesce(F.when(~share, mm * (1 - mv)), lo2, one)
    mhigh = F.coalesce(F.when(~share, mm * (1 + mv)), hi2, one)
    low = F.when(pct, plow).otherwise(mlow)
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.when(pct, phigh).otherwise(mhigh).alias("high"), F.when(pct, "%").when(share, "$/share").otherwise("$").alias("unit")))


def _small_revenue(metric: Column, v: Column) -> Column:
    return (metric == "Revenue") & (v["unit"] == "$") & (v["high"] < 1e6)


def guidance(sents: DataFrame) -> DataFrame:
    """Expectation sentences with a metric and a number: low and high of the range, unit, fiscal year."""
    s = F.col("sent")
    x = sents.filter(s.rlike("(?i)" + R.EXPECTATION) & ~s.rlike("(?i)analysts?|consensus")).withColumn("metric", T.first_match(s, R.METRICS)).filter("metric is not null")
    x = x.withColumn("_v", guided_values(s, F.col("metric"))).filter(F.col("_v").isNotNull() & ~_small_revenue(F.col("metric"), F.col("_v")))
    year = F.nullif(F.regexp_extract(s, r"(?i)(?:full[- ]year|fiscal(?: year)?|for the year)\s*(\d{4})", 1), F.lit(""))
    return x.select("doc_id", "pos", "metric", F.concat(F.lit("FY"), year).alias("period"), F.col("_v.low").alias("low"), F.col("_v.high").alias("high"), ((F.col("_v.low") + F.col("_v.high")) / 2).alias("mid"), F.col("_v.unit").alias("unit"), s.rlike("(?i)" + R.WITHDRAWN).alias("withdrawn"))


def guidance_period(text: Column, filed: Column) -> Column:
    """The quarter or fiscal year that a wording names, the next quarter as of the filing, or null."""
    part = lambda p, g: F.nullif(F.regexp_extract(text, "(?i)" + p, g), F.lit(""))
    nth = lambda p: F.concat(F.lit("Q"), F.coalesce(*[F.when(F.lower(part(p, 1)) == w, F.lit(str(i + 1))) for i, w in enumerate(R.QUARTERS)]))
    fiscal, plain, year, ahead = R.PERIODS["fiscal quarter"], R.PERIODS["quarter"], R.PERIODS["year"], R.PERIODS["next"]
    return F.coalesce(F.concat(nth(fiscal), F.lit(" FY"), part(fiscal, 2)), F.concat(nth(plain), F.lit(" "), part(plain, 2)), F.concat(F.lit("FY"), F.coalesce(part(year, 1), part(year, 2))),
                      F.when(text.rlike("(?i)" + ahead), F.concat(F.lit("Next quarter (as of "), filed.cast("string"), F.lit(")"))))


def release_guidance(releases: DataFrame) -> DataFrame:
    """Guidance of whole releases (doc_id, filed, text): a row per statement with metric, period, low, high, mid, unit, text and ``withdrawn`` of the release.

    The reach of an outlook heading is read, or the whole text where there is none; a sentence without a period has the heading's.  A
    sentence that gives GAAP and non-GAAP values "respectively" makes two rows, each with what follows both.
    """
    start = F.regexp_instr(F.concat(F.lit("\n"), "text"), F.lit(R.OUTLOOK_HEADING))
    region = F.when(start > 0, F.expr(f"substr(concat('\n', text), _start, {R.OUTLOOK_REACH})")).otherwise(F.col("text"))
    x = releases.withColumn("_start", start).withColumn("_region", region).withColumn("_hint", guidance_period(F.substring("_region", 1, 400), F.col("filed")))
    x = x.select("doc_id", "filed", "_hint", F.coalesce(F.col("text").rlike("(?i)" + R.WITHDRAWN), F.lit(False)).alias("withdrawn"), F.posexplode(T.sentences(F.col("_region"))).alias("pos", "sent"))
    s = F.col("sent")
    x = x.filter(s.rlike("(?i)" + R.EXPECTATION) & ~s.rlike("(?i)analysts?|consensus"))
    x = x.withColumn("period", F.coalesce(guidance_period(s, F.col("filed")), "_hint"))
    of = lambda g: F.nullif(F.regexp_extract(s, "(?i)" + R.GAAP_PAIR + r"([\s\S]*)", g), F.lit(""))
    x = x.withColumns({"_both": of(1), "_gaap": of(2), "_non": of(3), "_tail": F.coalesce(of(4), F.lit("")), "_first": T.first_match(s, R.METRICS)})
    x = x.withColumn("_m", F.when(F.col("_both").isNotNull(), T.first_match(F.col("_both"), R.METRICS)).otherwise(F.col("_first")))
    alone = F.when(s.rlike("(?i)non-GAAP|adjusted"), "non-GAAP").when(s.rlike(r"\bGAAP\b"), "GAAP")
    item = lambda qual, text: F.struct(F.concat(F.col("_m"), F.coalesce(F.concat(F.lit(" ("), qual, F.lit(")")), F.lit(""))).alias("metric"), guided_values(text, F.col("_m")).alias("v"))
    pair = F.array(item(F.lit("GAAP"), F.concat("_gaap", "_tail")), item(F.lit("non-GAAP"), F.concat("_non", "_tail")))
    x = x.filter("_m is not null").withColumn("i", F.explode(F.when(F.col("_both").isNotNull(), pair).otherwise(F.array(item(alone, s)))))
    x = x.filter(F.col("i.v").isNotNull() & (F.col("_both").isNotNull() | ~_small_revenue(F.col("_m"), F.col("i.v"))))
    return x.select("doc_id", "filed", "pos", F.col("i.metric").alias("metric"), "period", F.col("i.v.low").alias("low"), F.col("i.v.high").alias("high"), ((F.col("i.v.low") + F.col("i.v.high")) / 2).alias("mid"), F.col("i.v.unit").alias("unit"), T.clip(s, 400).alias("text"), "withdrawn")


def _free_hit(k: int):
    return lambda e: e["h"][k] & ~F.array_contains(F.col("_used"), e["pos"])


def topic_sentences(sents: DataFrame, rules: Sequence[tuple] = tuple(R.BUSINESS_TOPICS), per_topic: int | None = None) -> DataFrame:
    """Sentences under topics taken in rule order, each sentence once, ranked within its topic; with ``per_topic`` the others stay for later topics.

    A document's sentences are one bounded group, so the few topics are walked in one fold over them.
    """
    hits = F.array(*[F.coalesce(F.col("sent").rlike("(?i)" + p), F.lit(False)) for _, p in rules])
    g = sents.select("doc_id", "pos", hits.alias("h")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("s"))
    used = F.array().cast("array<int>")
    out = []
    for k, (label, _) in enumerate(rules):
        taken = F.transform(F.filter("s", _free_hit(k)), lambda e: e["pos"])
        taken = taken if per_topic is None else F.slice(taken, 1, per_topic)
        g = (g.withColumn("_used", used) if k == 0 else g).withColumn(f"_t{k}", taken).withColumn("_used", F.concat("_used", f"_t{k}"))
        out.append(F.struct(F.lit(label).alias("topic"), F.col(f"_t{k}").alias("p")))
    x = g.select("doc_id", F.explode(F.array(*out)).alias("t")).select("doc_id", "t.topic", F.posexplode("t.p").alias("_i", "pos"))
    return x.select("doc_id", "topic", "pos", (F.col("_i") + 1).alias("rank"))


def _after_first(words: Column) -> Column:
    return F.filter(words, lambda w, i: i > 0)


def ungrounded(pairs: DataFrame, summary: str, source: str) -> DataFrame:
    """Numbers and proper names of a summary that its source does not contain; row-local."""
    low = F.lower(F.col(source))
    numbers = F.regexp_extract_all(F.col(summary), F.lit(r"\d[\d,.]*\d|\d"), F.lit(0))
    sents = F.split(F.col(summary), r"(?<=[.!?])\s+")
    words = F.flatten(F.transform(sents, lambda s: _after_first(F.regexp_extract_all(s, F.lit(r"[A-Za-z][\w&+\-']*"), F.lit(0)))))
    names = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "'s$", "")), lambda w: w.rlike("^[A-Z]"))
    missing = F.filter(F.concat(numbers, names), lambda w: ~low.contains(F.lower(w)))
    return pairs.withColumn("first_missing", F.try_element_at(missing, F.lit(1))).withColumn("missing", F.size(F.array_distinct(missing)))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every href of a page in order."""
    links = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(links).alias("pos", "href"))


def exhibit_links(pages: DataFrame, wanted: Sequence[str] = ("EX-99.1", "EX-99"), html: str = "html") -> DataFrame:
    """Filing index rows whose fourth cell names a wanted exhibit; the link comes from the third cell."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    x = pages.select("page_id", F.posexplode(rows).alias("pos", "row")).withColumn("c", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))).filter(F.size("c") >= 4)
    kind = F.upper(T.strip(F.regexp_replace(F.element_at("c", 4), r"<[^>]+>", "")))
    link = F.coalesce(F.nullif(F.regexp_extract(F.element_at("c", 3), r'href="([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("row", r'href="([^"]+)"', 1), F.lit("")))
    x = x.select("page_id", "pos", kind.alias("kind"), F.replace(link, F.lit("/ix?doc="), F.lit("")).alias("href")).filter(F.col("href").isNotNull() & F.col("kind").rlike("^(" + "|".join(w.replace(".", r"\.") for w in wanted) + ")"))
    return x.groupBy("page_id").agg(F.min_by(F.struct("kind", "href"), "pos").alias("l")).select("page_id", "l.*")


def founded_year(docs: DataFrame, text: str = "text") -> DataFrame:
    y = F.nullif(F.regexp_extract(F.col(text), r"\bfounded in (\d{4})\b", 1), F.lit(""))
    return docs.withColumn("founded", y.cast("int"))


def chief_executive(officers: Column) -> Column:
    """Name of the first officer whose title says CEO."""
    hit = F.filter(officers, lambda o: F.lower(o["title"]).rlike("ceo|chief executive officer"))
    return F.nullif(T.strip(F.regexp_replace(F.try_element_at(hit, F.lit(1))["name"], r"\s+", " ")), F.lit(""))


# Strength of evidence, strongest first.
STRENGTH = {"disclosed": 3, "emphasized": 2, "classification": 2, "measured": 2, "mentioned": 1}
EMPHASIZED = 3  # fixed value: so many pieces without a strength of their own emphasise


def assemble_factors(parts: Sequence[DataFrame]) -> DataFrame:
    """Evidence rows (holding, factor_key, kind, strength, evidence) merged: strongest strength, all distinct pieces of evidence, ascending.

    Rows without a strength get it from their number: ``EMPHASIZED`` rows of a (holding, factor, kind) emphasise, fewer mention.  The evidence
    moves once: a factor of several kinds joins their lists.  A (holding, factor) has at most one piece for each of the holding's own
    sentences, so its list is bounded by one document.
    """
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    rank = F.coalesce(*[F.when(F.col("strength") == k, F.lit(v)) for k, v in STRENGTH.items()])
    unrated = F.count_if(F.col("strength").isNull())
    g = x.filter(F.col("holding").isNotNull() & F.col("factor_key").isNotNull()).groupBy("holding", "factor_key", "kind").agg(
        F.max(F.when(F.col("strength").isNotNull(), F.struct(rank.alias("r"), F.col("strength").alias("s")))).alias("_given"), unrated.alias("_n"), F.count(F.lit(1)).alias("pieces"), F.collect_set("evidence").alias("evidence"))
    counted = F.when(F.col("_n") > 0, F.when(F.col("_n") >= EMPHASIZED, "emphasized").otherwise("mentioned"))
    both = F.struct(F.coalesce(*[F.when(counted == k, F.lit(v)) for k, v in STRENGTH.items()]).alias("r"), counted.alias("s"))
    g = g.withColumn("strength", F.greatest("_given", F.when(counted.isNotNull(), both))["s"])
    lists = g.groupBy("holding", "factor_key").agg(F.collect_list(F.struct("kind", "strength", "pieces", "evidence")).alias("k"))  # the kinds of one factor
    lists = lists.withColumn("all", F.sort_array(F.array_distinct(F.flatten(F.transform("k", lambda e: e["evidence"])))))
    return lists.select("holding", "factor_key", F.explode("k").alias("k"), F.col("all").alias("evidence")).select("holding", "factor_key", "k.kind", "k.strength", "k.pieces", "evidence")


def government_actions(news: DataFrame, disclosed: DataFrame) -> DataFrame:
    """News on government wording with the bodies and topics named, linked to topics the company itself discloses."""
    t = F.concat_ws(" ", "headline", "summary")
    head = T.matched(F.col("headline"), R.GOV_ENTITIES, ignore_case=False)
    x = news.withColumn("entities", F.when(F.size(head) > 0, head).otherwise(T.matched(t, R.GOV_ENTITIES, ignore_case=False))).withColumn("topics", T.matched(t, R.POLICY)).withColumn("kind", T.first_match(t, R.GOV_KINDS, "Report"))
    d = disclosed.groupBy("company").agg(F.collect_set("topic").alias("_d"))  # at most ten topics
    x = x.join(d, "company", "left")
    link = F.try_element_at(F.filter("topics", lambda z: F.array_contains(F.coalesce("_d", F.array().cast("array<string>")), z)), F.lit(1))
    return x.withColumn("linked_topic", link).drop("_d")
