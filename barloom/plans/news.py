"""Queries on news: documents stand in for articles, pages for feed bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded
from barloom.operators import news as n
from barloom.plans.registry import query


def articles(spark, sf):
    """Documents as articles: the first sentence is the title, a minute a document the time."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    at = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    return d.select(F.col("doc_id").alias("item_id"), "source", title.alias("title"), F.col("text").alias("body"), at.alias("published_at"))


_TITLE = "regexp_extract(text, '^([^.\\n]*)', 1)"
_NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({_TITLE})), '\\s+[-|–—]\\s+[a-z0-9 .'']{{2,30}}$', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in n.STOPWORDS)
_TOKENS = f"list_filter(string_split({_NORMAL}, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"


@query("normal_titles", f"SELECT doc_id AS item_id, {_NORMAL} AS title, len({_TOKENS})::INT AS tokens FROM documents")
def normal_titles(spark, sf):
    return articles(spark, sf).select("item_id", n.normal_title(F.col("title")).alias("title"), F.size(n.title_tokens(F.col("title"))).alias("tokens"))


@query(
    "token_weights",
    f"WITH t AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS token FROM documents) SELECT token, count(*) AS df, round(greatest(0.15, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1))), 6) AS weight FROM t GROUP BY token",
)
def token_weights(spark, sf):
    return rounded(n.token_weights(articles(spark, sf)))


def _like(words) -> str:
    return " OR ".join(f"contains(p, '{w}')" for w in words)


@query(
    "news_categories",
    f"WITH a AS (SELECT doc_id, ' ' || lower({_TITLE} || ' ' || text) || ' ' AS p FROM documents) SELECT doc_id AS item_id, CASE {' '.join(f'WHEN {_like(ws)} THEN {chr(39)}{c}{chr(39)}' for c, ws in n.RULES.items())} ELSE 'other' END AS category FROM a",
)
def news_categories(spark, sf):
    return articles(spark, sf).select("item_id", n.category(F.concat_ws(" ", "title", "body")).alias("category"))


_LEX = ", ".join(f"('{w}', {v})" for w, v in n.LEXICON.items())
_NEG = ", ".join(f"'{w}'" for w in n.NEGATIONS)


@query(
    "lexicon_scores",
    f"""WITH lex(w, v) AS (VALUES {_LEX}), l AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z\\-]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l), g AS (SELECT *, coalesce(bool_or(w IN ({_NEG})) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS neg FROM w),
    h AS (SELECT doc_id, CASE WHEN neg THEN -v ELSE v END AS v FROM g JOIN lex USING (w))
    SELECT d.doc_id AS item_id, round(coalesce(avg(v), 0), 6) AS score, count(v)::INT AS hits FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""",
)
def lexicon_scores(spark, sf):
    return rounded(articles(spark, sf).select("item_id", n.lexicon(F.col("body")).alias("x")).select("item_id", "x.score", "x.hits"))


@query("news_stories")
def news_stories(spark, sf):
    """Articles gathered into stories within each day, with the stories' extent and outlets."""
    e = n.recycled(n.story_events(n.stories(articles(spark, sf))))
    return e.select("cycle", "story", "cluster_id", "earliest", "latest", "articles", "coverage", "recycled_from")


@query("news_events")
def news_events(spark, sf):
    """The stories classified: category, sentiment, importance, confidence."""
    e = n.story_events(n.stories(articles(spark, sf))).withColumn("body", F.col("titles")).withColumn("source_weight", F.lit(0.5))
    out = n.classified(e)
    return rounded(out.select("cycle", "story", "category", "sentiment", "sentiment_score", "importance", "confidence", F.size("relevance").alias("assets")))


@query(
    "clean_pages",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""",
)
def clean_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", n.clean_html(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(
    "feed_items",
    """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS url FROM pages) SELECT page_id, url, count(*) AS n FROM x WHERE url <> '' GROUP BY 1, 2""",
)
def feed_items(spark, sf):
    """Links of pages, delivered as the entries of Atom bodies and parsed from these."""
    p = spark.read.parquet(f"{sf}/pages.parquet").withColumn("hrefs", F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)))
    entries = F.array_join(F.transform("hrefs", lambda h: F.concat(F.lit("<entry><title>t</title><link href=\""), h, F.lit("\"/><updated>2024-01-01T00:00:00Z</updated></entry>"))), "")
    bodies = p.select(F.col("page_id").cast("string").alias("source"), F.concat(F.lit("<feed>"), entries, F.lit("</feed>")).alias("body"), F.current_timestamp().alias("now"))
    return n.parse_feed(bodies).groupBy(F.col("source").cast("long").alias("page_id"), "url").agg(F.count("*").alias("n"))


_CAT = f"cat AS (SELECT doc_id, n_chars, source, TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS at_, CASE {' '.join(f'WHEN {_like(ws)} THEN {chr(39)}{c}{chr(39)}' for c, ws in n.RULES.items())} ELSE 'other' END AS category FROM (SELECT *, ' ' || lower({_TITLE} || ' ' || text) || ' ' AS p FROM documents))"


def _stored_news(spark, sf):
    """Stored stories: category from the text, relevance and importance from its length."""
    a = articles(spark, sf).withColumn("size", F.length("body"))
    sizes = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), "n_chars")
    a = a.join(sizes, "item_id")
    share = F.col("n_chars") % 100 / 100
    return a.select("item_id", "published_at", n.category(F.concat_ws(" ", "title", "body")).alias("category"), F.create_map(F.lit("BTC"), share).alias("relevance"), (F.col("n_chars") % 10 / 10).alias("importance"), F.array("source").alias("outlets"), (F.col("item_id") % 9 == 0).alias("is_recycled"))


@query("news_category_counts", f"WITH {_CAT} SELECT category, count(*) AS n FROM cat WHERE at_ >= TIMESTAMP '2024-01-01 02:00:00' GROUP BY category")
def news_category_counts(spark, sf):
    from barloom.operators.store import fetch_range

    return fetch_range(_stored_news(spark, sf), "2024-01-01 02:00:00", None, False, "published_at").groupBy("category").agg(F.count("*").alias("n"))


@query("recent_news", f"WITH {_CAT} SELECT doc_id AS item_id, category FROM cat WHERE category <> 'other' AND doc_id % 9 <> 0 AND at_ >= TIMESTAMP '2024-01-01 01:00:00' AND n_chars % 100 / 100 >= 0.5 ORDER BY at_ DESC, doc_id DESC LIMIT 100")
def recent_news(spark, sf):
    """The newest fresh stories about an asset; relevance is asked before the limit."""
    rows = _stored_news(spark, sf).where("category <> 'other' AND NOT is_recycled AND relevance['BTC'] >= 0.5 AND published_at >= TIMESTAMP_NTZ '2024-01-01 01:00:00'")
    return rows.orderBy(F.desc("published_at"), F.desc("item_id")).limit(100).select("item_id", "category")


@query("relevant_news", f"WITH {_CAT} SELECT doc_id AS item_id, round(n_chars % 10 / 10, 6) AS importance FROM cat WHERE n_chars % 100 / 100 >= 0.5")
def relevant_news(spark, sf):
    from barloom.operators.records import relevant

    return rounded(relevant(_stored_news(spark, sf), "BTC").select("item_id", "importance"))


@query("source_weights", f"WITH {_CAT}, w AS (SELECT source, count(*) AS c FROM documents GROUP BY 1), v AS (SELECT source, least(1.0, c / 1000.0)::DOUBLE AS weight FROM w WHERE c > 20) SELECT doc_id AS item_id, round(coalesce(weight, 0.5), 6) AS source_weight FROM cat LEFT JOIN v USING (source)")
def source_weights(spark, sf):
    """Outlets weigh as much as they tell; a rare one weighs a half."""
    from barloom.operators.records import source_weight

    d = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count("*").alias("c")).where("c > 20").select("source", F.least(F.lit(1.0), F.col("c") / 1000).alias("weight"))
    return rounded(source_weight(_stored_news(spark, sf).select("item_id", "outlets"), d).select("item_id", "source_weight"))


@query("mood", f"WITH {_CAT}, m AS (SELECT category, n_chars % 10 / 10 AS w, (n_chars % 21 - 10) / 10 AS s FROM cat WHERE doc_id % 9 <> 0) SELECT category, round(sum(s * w) / sum(w), 6) AS sentiment, count(*) AS stories FROM m GROUP BY category")
def mood(spark, sf):
    sizes = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), "n_chars")
    e = _stored_news(spark, sf).join(sizes, "item_id").withColumn("recycled_from", F.when(F.col("is_recycled"), F.lit("x"))).withColumn("confidence", F.lit(1.0)).withColumn("sentiment_score", (F.col("n_chars") % 21 - 10) / 10)
    return rounded(n.mood(e, ("category",)))


_GRAMS = "CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"


@query(
    "title_similarity",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), g AS (SELECT doc_id, list_distinct({_GRAMS}) AS g, lead(list_distinct({_GRAMS})) OVER (ORDER BY doc_id) AS h FROM t)
    SELECT doc_id AS item_id, len(g)::INT AS shingles, round(CASE WHEN len(list_intersect(g, h)) > 0 THEN len(list_intersect(g, h)) / len(list_distinct(g || h)) ELSE 0 END, 6) AS similarity FROM g WHERE h IS NOT NULL""",
)
def title_similarity(spark, sf):
    """Each title's pairs of words, and how many of them the next item's title shares."""
    own = articles(spark, sf).select("item_id", n.title_shingles(F.col("title")).alias("g"))
    after = own.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))  # ids run without a gap
    out = own.join(after, "item_id")
    return rounded(out.select("item_id", F.size("g").alias("shingles"), n.jaccard(F.col("g"), F.col("h")).alias("similarity")))
