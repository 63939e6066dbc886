"""The queries on pages, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import pages
from millrace.sources.tables import table


#: What the SQL takes a page apart by, in one pass from left to right: comments, elements whose content isn't markup, start tags.
_QUOTED = """(?:"[^"]*"|''[^'']*''|[^''">])*"""
_RAW = "|".join(rf"<{x}(?:[\s/]{_QUOTED})?>.*?(?:</{x}[\s/>]|\z)" for x in ("script", "style", "textarea", "title"))
_TOKENS = rf"regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|{_RAW}|<[a-z][^\s/>]*{_QUOTED}>')"
#: The references in the tables, in the order in which they are replaced; and elements that end no word.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_INLINE = "a|abbr|b|big|cite|code|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr"


def _decoded(text: str) -> str:
    for reference, sign in _REFERENCES:
        text = "replace({}, '{}', '{}')".format(text, *(x.replace("'", "''") for x in (reference, sign)))
    return text


def _text(html: str) -> str:
    for pattern, new in (
        (rf"(?is)<!--.*?(?:-->|\z)|{_RAW}", ""),
        (r"(?is)<nav\b[^>]*>.*?</nav[^>]*>", " "),
        (r"(?is)<footer\b[^>]*>.*?</footer[^>]*>", " "),
        (rf"(?is)</?(?:{_INLINE})(?:[\s/]{_QUOTED})?>|<[!?][^>]*>|</?[a-z][^>]*\z", ""),
        (rf"(?is)</?[a-z][^\s/>]*{_QUOTED}>", " "),
    ):
        html = f"regexp_replace({html}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({_decoded(html)}, '[\\s\u00a0]+', ' ', 'g'))"


_HOST = f"lower(regexp_extract(url, '{pages.HOST}', 1))"
_TITLE = _decoded(rf"""CASE WHEN html IS NOT NULL THEN coalesce(regexp_extract(list_filter({_TOKENS}, lambda t: regexp_matches(t, '(?i)^<title[\s/>]'))[1],
    '(?is)^<title[^>]*>(.*?)(?:</title[\s/>])?$', 1), '') END""")
_LINK = rf"(?is)^<(?:a|area)[\s/](?:.*?[\s/])?href\s*=\s*"
_HREFS = rf"""list_transform(list_filter({_TOKENS}, lambda t: regexp_matches(t, '{_LINK}')),
    lambda t: trim(regexp_replace(regexp_extract(t, '{_LINK}("[^"]*"|''[^'']*''|[^\s"''>]*)', 1), '^["'']|["'']$', '', 'g')))"""
_ORIGIN = f"regexp_extract(url, '{pages.ORIGIN}', 1)"
#: Segments are folded from the left; a .. cuts the last one off.
_LINKS = f"""
SELECT page_id, place, CASE
    WHEN regexp_matches(href, '{pages.SCHEME}') OR origin = '' THEN href
    WHEN starts_with(href, '//') THEN split_part(origin, ':', 1) || ':' || href
    WHEN href = '' OR starts_with(href, '#') THEN split_part(url, '#', 1) || href
    WHEN starts_with(href, '?') THEN page || href
    ELSE origin || list_reduce(list_prepend('', string_split(CASE
            WHEN regexp_matches(full_path, '/\\.\\.?$') THEN full_path || '/' ELSE full_path END, '/')[2:]),
        lambda done, part: CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)
        || substr(href, length(path) + 1) END AS target
FROM (SELECT *, CASE WHEN starts_with(path, '/') THEN path WHEN folder = '' THEN '/' || path ELSE folder || path END AS full_path
      FROM (SELECT *, regexp_extract(substr(page, length(origin) + 1), '^.*/') AS folder, regexp_extract(href, '^[^?#]*') AS path
            FROM (SELECT page_id, url, CAST(i AS BIGINT) AS place, {_decoded(f"{_HREFS}[i + 1]")} AS href, {_ORIGIN} AS origin,
                         regexp_extract(url, '^[^?#]*') AS page
                  FROM (SELECT *, unnest(range(len({_HREFS}))) AS i FROM pages))))"""
_CANONICAL = r"""CASE WHEN u.scheme = '' THEN url ELSE lower(u.scheme) || '://' || u.login
    || regexp_replace(lower(u.server), CASE lower(u.scheme) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')
    || rtrim(u.path, '/') || u.query END"""
_URLS = r"""(SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?',
    ['scheme', 'login', 'server', 'path', 'query']) AS u FROM pages)"""

_FOUND = {
    "page_summary": (
        pages.page_summary,
        f"SELECT page_id, {_HOST} AS host, {_TITLE} AS title, CAST(coalesce(len({_HREFS}), 0) AS BIGINT) AS n_links FROM pages",
    ),
    "page_links": (pages.page_links, _LINKS),
    "page_text": (pages.page_text, f"SELECT page_id, {_text('html')} AS text FROM pages"),
    "page_tags": (
        pages.page_tags,
        rf"""SELECT tag, CAST(sum(n) AS BIGINT) AS n_tags, count(*) AS n_pages FROM (
            SELECT page_id, lower(regexp_extract(t, '^<([A-Za-z][^\s/>]*)', 1)) AS tag, count(*) AS n
            FROM (SELECT page_id, unnest({_TOKENS}) AS t FROM pages) WHERE NOT starts_with(t, '<!--') GROUP BY 1, 2) GROUP BY 1""",
    ),
    "distinct_pages": (
        pages.distinct_pages,
        f"SELECT {_CANONICAL} AS url, min(page_id) AS page_id, count(*) AS n_pages FROM {_URLS} GROUP BY 1",
    ),
    "repeated_texts": (
        pages.repeated_texts,
        f"SELECT sha256({_text('html')}) AS digest, min(page_id) AS page_id, count(*) AS n_pages FROM pages "
        "WHERE html IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    ),
    "host_links": (
        pages.host_links,
        f"SELECT {_HOST} AS host, count(*) AS n_pages, CAST(sum(coalesce(len({_HREFS}), 0)) AS BIGINT) AS n_links FROM pages GROUP BY 1",
    ),
    "link_targets": (
        pages.link_targets,
        f"SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM ({_LINKS}) GROUP BY 1",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: operator(table(spark, sf_dir, "pages"))

    return {name: of(operator) for name, (operator, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}
