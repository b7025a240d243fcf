"""Row types of the engine: the page record and the tables around it."""

from __future__ import annotations

PAGE = (
    "url string, title string, text string, text_length int, links array<string>, links_count int, images array<struct<src:string,alt:string>>, images_count int, "
    "headings struct<h1:array<string>,h2:array<string>,h3:array<string>>, metadata struct<title:string,description:string,keywords:string>, tables_count int, lists_count int, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>>>, lists array<struct<tag:string,items:array<string>>>, error string"
)
FETCHED = "fetch_elapsed double, status_code int, content_type string, crawled_at string"
STORED = "url string, title string, text string, links_json string, metadata_json string, crawled_at string, status_code int, content_type string, text_length int, links_count int"
FETCH_RESULT = "url string, status int, content string, content_type string, error string, elapsed double"
FRONTIER = "url string, priority int, depth int, added_at double, state string, error string"
BOOK = "url string, title string, upc string, product_type string, price_excl_tax string, price_incl_tax string, tax string, availability string, num_reviews string, rating string, genre string"
EMPTY_PAGE_ERROR = "Empty HTML string received"
