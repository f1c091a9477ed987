"""Names and tickers in prose, against alias tables of any size.

Every run of words that is as long as some alias (and, where aliases begin with few different words, begins with one of these) becomes a
phrase, exactly as written between its first and last word, and one hash join with the alias table finds all mentions.  Overlaps are settled per text: a longer alias first, and a mention that starts
inside a kept one goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
FIRST_WORDS = 1000  # up to so many different first words of aliases are looked for in the text itself; with more, all runs meet the table
# Wording before a ticker, and the reasons in their order.
ASKING = r"(?i)(?:ticker|symbol|shares of|stock)\s*:?\s*$"
REASONS = ["written with $", "company name", "listed ticker", "in context"]


def _parts(text: Column) -> tuple[Column, Column]:
    """Words of a text and what stands before each of them and after the last."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)


def alias_table(aliases: DataFrame) -> DataFrame:
    """``aliases(alias, ticker)`` with the phrase to join on, its words, and signs before its first and after its last word."""
    a = aliases.select(F.lower("alias").alias("alias"), "ticker").distinct()
    words, gaps = _parts(F.col("alias"))
    a = a.withColumns({"n_words": F.size(words), "lead": F.element_at(gaps, 1), "trail": F.element_at(gaps, -1)}).filter("n_words > 0")
    return a.withColumn("phrase", F.expr("substr(alias, length(lead) + 1, length(alias) - length(lead) - length(trail))"))


def name_mentions(texts: DataFrame, aliases: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Mentions of aliases: key, ticker, alias, at (number of the first word); any case, whole words, not after ``$``.

    Of overlapping mentions the longer alias is settled first (of equals the earlier); one that begins inside a kept mention is dropped.
    Null and empty texts and aliases give nothing; an alias of several tickers gives each.
    """
    key = list(key)
    a = alias_table(aliases)
    sizes = sorted(r.n_words for r in a.select("n_words").distinct().collect())  # a handful of lengths
    firsts = [r.w for r in a.select(F.regexp_extract("phrase", WORD, 0).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()]
    begins = (lambda i: F.element_at("w", i).isin(firsts)) if len(firsts) <= FIRST_WORDS else (lambda i: F.lit(True))
    words, gaps = _parts(F.lower(F.col(text)))
    x = texts.select(*key, words.alias("w"), gaps.alias("g"))

    def phrases(n: int) -> Column:
        run = lambda i: F.concat(F.element_at("w", i), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda j: F.concat(F.element_at("g", i + j), F.element_at("w", i + j))), "") if n > 1 else F.lit(""))
        one = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n_words"), run(i).alias("phrase"), F.element_at("g", i).alias("_before"), F.element_at("g", i + n).alias("_after"))
        return F.when(F.size("w") >= n, F.transform(F.filter(F.sequence(F.lit(1), F.size("w") - n + 1), begins), one)).otherwise(F.array())

    if not sizes:
        return texts.select(*key).withColumns({"ticker": F.lit(None).cast("string"), "alias": F.lit(None).cast("string"), "at": F.lit(None).cast("int")}).limit(0)
    found = x.select(*key, F.explode_outer(F.concat(*[phrases(n) for n in sizes])).alias("p")).filter(F.col("p").isNotNull()).select(*key, "p.*")  # each text is read once; outer as in T.explode_matches
    hit = found.join(a, ["n_words", "phrase"]).filter(F.endswith("_before", F.col("lead")) & F.startswith("_after", F.col("trail")))
    outside = F.expr("substr(_before, 1, length(_before) - length(lead))")
    hit = hit.filter(~outside.endswith("$"))
    w = Window.partitionBy(*key).orderBy("at")  # the mentions of one text
    reach = F.max(F.col("at") + F.col("n_words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("_new", F.when(F.col("at") < reach, 0).otherwise(1))
    hit = hit.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    hit = hit.withColumn("_island", F.min("_island").over(Window.partitionBy(*key, "at")))
    order = F.struct((-F.length("alias")).alias("o"), "at", "n_words", "alias", "ticker")
    g = hit.groupBy(*key, "_island").agg(F.sort_array(F.collect_list(order)).alias("m"))  # mentions that overlap
    inside = lambda kept, m: F.exists(kept, lambda k: (k["at"] <= m["at"]) & (m["at"] < k["at"] + k["n_words"]) & (k["alias"] != m["alias"]))
    kept = F.aggregate("m", F.filter("m", lambda m: F.lit(False)), lambda acc, m: F.when(inside(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
    return g.select(*key, F.explode(kept).alias("m")).select(*key, "m.ticker", "m.alias", "m.at")


def link(texts: DataFrame, aliases: DataFrame, listed: DataFrame, wordlike: Sequence[str], key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Tickers a text names: key, ticker, confidence (high or ask) and reason.

    ``$TICKER`` and names by ``aliases(alias, ticker)`` count, as do ALL-CAPS tokens in ``listed(ticker)``.  A token that is also a word (``wordlike``, or
    one letter) is only a question, and only in brackets or after wording like "shares of" or "ticker:".  The best reason of a ticker stays.
    """
    key = list(key)
    t = F.col(text)
    known = listed.select("ticker").distinct()
    dollar = F.transform(F.regexp_extract_all(t, F.lit(r"\$([A-Za-z]{1,5}(?:[.-][A-Za-z])?)\b"), F.lit(1)), lambda m: F.struct(F.replace(F.upper(m), F.lit("."), F.lit("-")).alias("ticker"), F.lit(1).alias("tier")))
    token = r"(?<![\p{L}\p{N}_$])[A-Z]{1,5}(?:-[A-Z])?(?![\p{L}\p{N}_])"
    caps, around = F.regexp_extract_all(t, F.lit(token), F.lit(0)), F.split(t, token, -1)

    def judged(m, i):
        before, after = F.element_at(around, i + 1), F.element_at(around, i + 2)
        close = F.substring(before, -12, 12)
        asks = (F.endswith(before, F.lit("(")) & F.startswith(after, F.lit(")"))) | close.rlike(ASKING)
        word = m.isin(list(wordlike)) | (F.length(m) == 1)
        return F.struct(m.alias("ticker"), F.when(~word, 3).when(asks, 4).alias("tier"))

    tokens = texts.select(*key, F.explode_outer(F.concat(dollar, F.transform(caps, judged))).alias("h")).select(*key, "h.*").filter("tier is not null").join(known, "ticker")
    names = name_mentions(texts, aliases, key, text).select(*key, "ticker", F.lit(2).alias("tier"))
    best = tokens.select(*key, "ticker", "tier").unionByName(names).groupBy(*key, "ticker").agg(F.min("tier").alias("tier"))
    return best.select(*key, "ticker", F.when(F.col("tier") == 4, "ask").otherwise("high").alias("confidence"), F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("tier")).alias("reason"))
