"""Operators on stored web pages (page_id, url, html).

Pages are tokenized by ``functions.html`` in Arrow batches where they are read, URLs are column
expressions; scans read only the columns they use and nothing is shuffled but
what a result groups by, after counts are combined.  Null URLs and pages give
null or empty values, never errors, and so does any markup.  Rows that share an id
are pages of their own unless said otherwise, an empty table gives an empty result,
other columns are ignored.  A page is held whole by one task, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import html

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
#: Behind the scheme and any user: a name up to its port, or an address in brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\[\]]+)"


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without its user and port; null for null, empty if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its . and .. segments resolved (RFC 3986, 5.2.4)."""
    path = F.regexp_replace(path, r"/(\.\.?)$", "/$1/")  # a last . or .. names a folder

    def step(done: Column, segment: Column) -> Column:
        up = F.regexp_replace(done, r"/[^/]*$", "")
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.lit("/"), segment))

    return F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.lit(""), step)


def absolute(url: Column, href: Column) -> Column:
    """A link's target as an absolute URL by RFC 3986, from the URL of its page; null if either is null.

    What can't be resolved, as the page's URL isn't absolute, stays as it is.
    """
    origin = F.regexp_extract(url, ORIGIN, 1)
    page = F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.regexp_extract(F.substr(page, F.length(origin) + 1), r"^.*/", 0)
    path, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when(F.regexp_extract(href, SCHEME, 1) != "", href)
        .when(origin == "", href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, SCHEME, 1), F.lit(":"), href))
        .when(href == "", F.regexp_extract(url, r"^[^#]*", 0))
        .when(href.startswith("#"), F.concat(F.regexp_extract(url, r"^[^#]*", 0), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(origin, _without_dots(full), rest))
    )


def canonical(url: Column) -> Column:
    """A URL to compare by; null for null.

    Scheme and host are in lower case, without a default port; the path is without final slashes,
    a query and a user stay as they are, a fragment goes.  What isn't absolute stays as it is.
    """
    origin = F.regexp_extract(url, ORIGIN, 1)
    user = F.regexp_extract(origin, r"//([^/?#]*@)?", 1)
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))
    server = F.lower(F.regexp_extract(origin, r"//(?:[^/?#]*@)?(.*)$", 1))
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise("")
    server = F.when(server.endswith(port), F.substr(server, F.lit(1), F.length(server) - F.length(port))).otherwise(server)
    rest = F.substr(url, F.length(origin) + 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(origin == "", url).otherwise(F.concat(scheme, F.lit("://"), user, server, path, query))


def _linked(pages: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and p: title, hrefs and base of each page, tokenized once."""
    return pages.select(*columns, html.page_parts(F.col("html"), text=False).alias("p"))


def page_summary(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, n_links), one row a page; links are a and area elements with an href."""
    rows = _linked(pages, F.col("page_id"), host(F.col("url")).alias("host"))
    return rows.select("page_id", "host", F.col("p.title").alias("title"), F.size("p.hrefs").cast("long").alias("n_links"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, target): every link of every page, numbered from 0, as an absolute URL.

    Links are resolved against the page's base element if it has one, else against
    its URL; without either the target is null.
    """
    rows = _linked(pages, F.col("page_id"), F.col("url"))
    base = F.when(F.col("p.base").isNull(), F.col("url")).otherwise(absolute(F.col("url"), F.col("p.base")))
    rows = rows.select("page_id", base.alias("base"), F.posexplode("p.hrefs").alias("place", "href"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), absolute(F.col("base"), F.col("href")).alias("target"))


def host_links(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_links) for each host; counts are combined before the shuffle, so a hot host is one row a task."""
    rows = page_summary(pages)
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n_links").alias("n_links"))


def link_targets(pages: DataFrame) -> DataFrame:
    """(target, n_links, n_pages): how many links, from how many pages, lead to each target."""
    per_page = page_links(pages).groupBy("target", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("target").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): what a page says, without markup and boilerplate; null for a null page."""
    return pages.select("page_id", html.page_parts(F.col("html")).alias("p")).select("page_id", F.col("p.text").alias("text"))


def page_tags(pages: DataFrame) -> DataFrame:
    """(tag, n_tags, n_pages): how many start tags of each element there are, and on how many pages.

    Pages that share an id count as one.
    """
    tokens = pages.select("page_id", "html").lateralJoin(html.html_tokens(F.col("html").outer()))
    per_page = tokens.where("kind = 'start'").groupBy(F.col("name").alias("tag"), "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n_tags"), F.count("*").alias("n_pages"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(url, page_id, n_pages): each canonical URL with its smallest page id; counts are combined before the shuffle."""
    rows = pages.select(canonical(F.col("url")).alias("url"), "page_id")
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))


def repeated_texts(pages: DataFrame) -> DataFrame:
    """(digest, page_id, n_pages): each text that several pages have, by its SHA-256, with its smallest page id.

    Null pages have no text; pages without a word share the empty one.
    """
    rows = page_text(pages).select(F.sha2("text", 256).alias("digest"), "page_id").where("digest IS NOT NULL")
    found = rows.groupBy("digest").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))
    return found.where("n_pages > 1")
