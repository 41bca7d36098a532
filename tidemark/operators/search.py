"""Search of many requests at once: an inverted index, alternatives of terms, and levels that give way until one has a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the levels: the home country, the countries of the wider ones, and the category.
HOME, COUNTRIES, CATEGORY = "in", ("in", "us", "gb", "sg"), "business"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(query: Column) -> Column:
    """The terms of a plain query: each word, without alternatives."""
    return F.transform(tokens(query), lambda w: F.array(w))


def themed_terms(aliases: Column, theme: Column) -> Column:
    """The terms of a company's theme: any of the aliases (phrases) and any of the theme's words."""
    return F.array(aliases, tokens(theme))


def postings(articles: DataFrame) -> DataFrame:
    """(token, id, in_title) of articles (id, title, content), one row a token and article."""
    a = articles.select("id", tokens(F.col("title")).alias("t"), tokens(F.col("content")).alias("c"))
    a = a.select("id", "t", F.explode(F.array_distinct(F.concat("t", "c"))).alias("token"))
    return a.select("token", "id", F.array_contains("t", F.col("token")).alias("in_title"))


def search_levels(requests: DataFrame, articles: DataFrame, trusted: list[str]) -> DataFrame:
    """(request, id, level): the articles of each request at its least level that has any.

    requests has request and terms: array<array<string>>, up to 62 terms, each a list of alternatives, which are words or
    phrases. articles has id, title, content, country, category and domain. Levels: 0 all terms in the title, home country,
    category and a trusted domain; 1 the same of any domain; 2 all terms in title or content, the wider countries, category;
    3 any term, the wider countries; 4 any term, the category. Requests meet the index by the first word of each
    alternative; a phrase is then looked for in the article itself. A request's terms in an article are bits of one number,
    which tasks combine before the shuffle. Null and empty alternatives match nothing.
    """
    asked = requests.select("request", F.size("terms").alias("n"), F.posexplode("terms").alias("term", "any"))
    asked = asked.select("request", "n", "term", F.explode("any").alias("phrase")).select("request", "n", "term", tokens(F.col("phrase")).alias("words")).where("size(words) > 0").distinct()
    asked = asked.withColumn("token", F.get("words", F.lit(0)))
    found = asked.join(postings(articles), "token").select("request", "n", "term", "words", "id", "in_title")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" "))
    phrase = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    several = found.where("size(words) > 1").join(articles.select("id", padded("title").alias("t"), padded("content").alias("c")), "id")
    several = several.withColumn("in_title", F.col("t").contains(phrase)).where(F.col("in_title") | F.col("c").contains(phrase))
    hits = found.where("size(words) = 1").unionByName(several.select(found.columns))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term"))
    met = hits.groupBy("request", "n", "id").agg(F.bit_count(F.bit_or(bit)).alias("anywhere"), F.bit_count(F.bit_or(F.when(F.col("in_title"), bit).otherwise(F.lit(0).cast("long")))).alias("in_title"))
    met = met.join(articles.select("id", "country", "category", "domain"), "id")
    home, wide, business = F.col("country") == HOME, F.col("country").isin(*COUNTRIES), F.col("category") == CATEGORY
    all_in_title, all_anywhere = F.col("in_title") == F.col("n"), F.col("anywhere") == F.col("n")
    level = F.when(all_in_title & home & business & F.col("domain").isin(*trusted), 0).when(all_in_title & home & business, 1).when(all_anywhere & wide & business, 2).when(wide, 3).when(business, 4)
    met = met.select("request", "id", level.alias("level")).where("level is not null")
    least = met.groupBy("request").agg(F.min("level").alias("level"))
    return met.join(least, ["request", "level"]).select("request", "id", "level")
