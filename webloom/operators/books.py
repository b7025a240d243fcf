"""Book catalogue pages: listings, details and statistics."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from webloom.operators.html import Node, parse_tree
from webloom.operators.stats import beside, counts_text, top
from webloom.schema import BOOK

# The header of each product field.
FIELDS = {"UPC": "upc", "Product Type": "product_type", "Price (excl. tax)": "price_excl_tax", "Price (incl. tax)": "price_incl_tax", "Tax": "tax", "Availability": "availability", "Number of reviews": "num_reviews"}


def listing(html: str, url: str) -> list[str]:
    """Resolved first link of every product card, in order, repeats kept."""
    out = []
    for card in (n for n in parse_tree(html or "").find_all("article") if n.has_class("product_pod")):
        href = next((a.attrs["href"] for a in card.find_all("a") if a.attrs.get("href")), None)
        if href:
            out.append(urljoin(url, href))
    return out


def next_page(html: str, url: str) -> str | None:
    for item in (n for n in parse_tree(html or "").find_all("li") if n.has_class("next")):
        a = item.find("a")
        if a is not None and a.attrs.get("href"):
            return urljoin(url, a.attrs["href"])
    return None


def product_table(tree: Node) -> dict[str, str]:
    """Header to value of the product table; a later repeat of a header wins."""
    table = next((n for n in tree.find_all("table") if n.has_class("table-striped")), None)
    out = {}
    for row in table.find_all("tr") if table is not None else ():
        head, cell = row.find("th"), row.find("td")
        if head is not None and cell is not None:
            out[head.text(strip=True)] = cell.text(strip=True)
    return out


def detail(html: str, url: str) -> dict:
    tree = parse_tree(html or "")
    heading = tree.find("h1")
    found = product_table(tree)
    book = {"url": url, "title": (heading.text(strip=True) if heading is not None else "") or "Unknown"} | {name: found.get(head) for head, name in FIELDS.items()}
    rating = next((n for n in tree.find_all("p") if n.has_class("star-rating")), None)
    book["rating"] = next((c for c in rating.attrs["class"].split() if c != "star-rating"), None) if rating is not None else None
    crumbs = next((n for n in tree.find_all("ul") if n.has_class("breadcrumb")), None)
    trail = [a.text(strip=True) for a in crumbs.find_all("a")] if crumbs is not None else []
    book["genre"] = trail[-1] if len(trail) >= 2 else None
    return book


def listing_urls(html: Column, url: Column) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([listing(h, u) for h, u in zip(html, url)])

    return run(html, url)


def next_url(html: Column, url: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([next_page(h, u) for h, u in zip(html, url)], dtype=object)

    return run(html, url)


def book_record(html: Column, url: Column) -> Column:
    schema = StructType.fromDDL(BOOK)

    @F.pandas_udf(schema)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detail(h, u) for h, u in zip(html, url)], columns=schema.names, dtype=object)

    return run(html, url)


def in_stock(availability: Column) -> Column:
    """``22 left`` from an availability text, ``?`` where there is no number."""
    number = F.nullif(F.regexp_extract(availability, r"(\d+)", 1), F.lit(""))
    return F.coalesce(F.concat(number, F.lit(" left")), F.lit("?"))


def price(text: Column) -> Column:
    """The amount of a price text whatever became of its currency sign."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("decimal(12,2)")


def book_stats(books: DataFrame) -> DataFrame:
    """One row: distinct books, genres, ratings known, mean price."""
    one = books.distinct()
    return one.agg(F.count("*").alias("total"), F.count_distinct("genre").alias("genres"), F.count("rating").alias("rated"), F.round(F.avg(price(F.col("price_excl_tax")).cast("double")), 4).alias("mean_price"))


def genre_counts(books: DataFrame) -> DataFrame:
    return books.distinct().where("genre is not null").groupBy("genre").agg(F.count("*").alias("books"))


def rating_counts(books: DataFrame) -> DataFrame:
    return books.distinct().where("rating is not null").groupBy("rating").agg(F.count("*").alias("books"))


def scrape_stats(books: DataFrame, failed: DataFrame, top_k: int = 5) -> DataFrame:
    """One row on a scrape: books and failures, genres found, the most frequent genres and the ratings as texts."""
    totals = books.agg(F.count("*").alias("total_scraped"), F.count_distinct("genre").alias("genres_found"))
    lost = failed.agg(F.count("*").alias("total_failed"))
    genres = counts_text(top(genre_counts(books), "genre", "books", top_k), "genre", "books", "top_genres")
    ratings = counts_text(rating_counts(books), "rating", "books", "rating_distribution")
    return beside(totals, lost, genres, ratings)


def follow_listing(corpus: DataFrame, start: str, max_books: int) -> list[str]:
    """Book urls by following next links from a listing page until enough are found; first occurrences, trimmed.

    The listing pages of the start's host are parsed in one pass, each to its books and its next page; the walk then
    goes over that small table, as many rows as the catalogue has listing pages, ended by ``max_books``, a repeated page
    or a missing one.
    """
    host = F.substring_index(F.lit(start), "/", 3)
    pages = corpus.where(F.col("content").isNotNull() & F.col("url").startswith(host)).select("url", listing_urls(F.col("content"), F.col("url")).alias("books"), next_url(F.col("content"), F.col("url")).alias("next"))
    lists = pages.where((F.size("books") > 0) | F.col("next").isNotNull() | (F.col("url") == start)).groupBy("url").agg(F.max(F.struct("books", "next")).alias("p"))
    known = {r["url"]: r["p"] for r in lists.toLocalIterator()}
    found: dict[str, None] = {}
    url, seen = start, set()
    while url and url not in seen and len(found) < max_books and url in known:
        seen.add(url)
        found |= dict.fromkeys(known[url]["books"])
        url = known[url]["next"]
    return [*found][:max_books]


def scrape(corpus: DataFrame, start: str, max_books: int) -> tuple[DataFrame, DataFrame]:
    """(books, failed urls) of a catalogue: listings are followed, then all detail pages are parsed in parallel."""
    spark = corpus.sparkSession
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(follow_listing(corpus, start, max_books))], "seq int, url string")
    pages = urls.join(corpus.where("content is not null and content <> ''").select("url", "content"), "url", "left")
    books = pages.where("content is not null").select("seq", book_record(F.col("content"), F.col("url")).alias("b")).select("seq", "b.*")
    return books, pages.where("content is null").select("seq", "url")
