"""Crawl tables derived from ``pages``, which itself holds no images, fetch statuses or redirects.

One SQL text per view serves both engines; only the way to repeat a row differs, see ``repeat``.
"""

from __future__ import annotations

SPARK, ORACLE = "spark", "oracle"


def repeat(source: str, rows: str, names: str, dialect: str) -> str:
    """FROM clause that pairs every row of ``source`` with each of a few constant rows."""
    if dialect == ORACLE:
        return f"{source}, (values {rows}) as r({names})"
    structs = rows.replace("(", "struct(")
    return f"{source} lateral view inline(array({structs})) r as {names}"


def _titled_pages() -> str:
    return "select page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) as t from pages"


def articles(dialect: str) -> str:
    """Nine image references per article, eight of them http(s): repeated url, equal names, data URI, private
    host, nested link, no extension, alt over two lines, escaped name, missing file."""
    return f"""
select page_id as article_id,
  case when page_id % 286 = 0 then concat(regexp_extract(url, '^https?://[^/]*', 0), '/') else url end as source_url,
  case when page_id % 11 = 0 then null when page_id % 17 = 5 then '日本語' else t end as title,
  case when page_id % 5 = 0 then null else concat('Jane "JD" Doe ', cast(page_id % 7 as string)) end as author,
  case page_id % 6 when 0 then null when 1 then '' when 2 then 'Wed, 11 Mar 2026 19:06:45 GMT'
    when 3 then '2026-01-15T23:30:00-08:00' when 4 then 'January 5, 2024' else 'soon' end as date,
  case when page_id % 3 = 0 then null
    else concat('About ', t, chr(10), 'in C:', chr(92), 'temp', chr(9), 'today') end as description,
  concat(case when page_id % 13 = 0 then '' else concat('# ', t, chr(10), chr(10)) end,
    '![hero](https://cdn', cast(page_id % 5 as string), '.example.com/img/hero.png?w=800)', chr(10),
    '![again](https://cdn', cast(page_id % 5 as string), '.example.com/img/hero.png?w=800)', chr(10),
    '![](https://static.example.org/a/photo.jpg)', chr(10),
    '![two](https://alt.example.org/photo.jpg)', chr(10),
    '![inline](data:image/png;base64,AAAA)', chr(10),
    '![priv](http://192.168.0.', cast(page_id % 256 as string), '/x.png)', chr(10),
    '[![noext](https://cdn.example.com/abc', cast(page_id as string), ')](https://example.com/full)', chr(10),
    '![multi', chr(10), 'line]( https://static.example.org/My%20Chart+v2.svg#f )', chr(10),
    '![missing](https://static.example.org/missing.png)', chr(10), html) as markdown
from ({_titled_pages()}) titled"""


def fetches(dialect: str) -> str:
    """Reader responses: every fetch class, metadata that is absent, blank, a list, or text, and titles that two
    articles share, one of which may have a url that is refused."""
    return """
select page_id as article_id, url,
  case when page_id % 17 = 1 then 429 when page_id % 17 = 2 then 503 when page_id % 17 = 3 then cast(null as int)
    when page_id % 17 = 9 then 404 else 200 end as http_status,
  case when page_id % 17 = 3 then 'connection' end as error_kind,
  case when page_id % 17 in (1, 2, 3, 9) then cast(null as string)
    when page_id % 17 = 4 then '<html>not json</html>'
    when page_id % 17 = 5 then concat('{"code":200,"data":{"title":"T","content":"  ', chr(92), 'n "}}')
    when page_id % 17 = 6 then '{"code":200}'
    else concat('{"code":200,"data":{"title":',
      case when page_id % 11 = 0 then '""' else concat('"Article ', cast(page_id - case when page_id % 7 < 2 then page_id % 7 else 0 end as string), ': Café déjà vu"') end,
      ',"description":', case when page_id % 3 = 0 then '""' else '"short text"' end,
      ',"content":"# Head ', cast(page_id as string), chr(92), 'n', chr(92), 'nBody.","publishedTime":',
      case when page_id % 4 = 0 then '""' when page_id % 4 = 1 then '"Wed, 11 Mar 2026 19:06:45 GMT"'
        when page_id % 4 = 2 then '"2026-01-15T23:30:00-08:00"' else '"soon"' end,
      ',"metadata":{"author":',
      case when page_id % 5 = 0 then '["A","B"]' when page_id % 5 = 1 then '"  "' else '" Jane Doe "' end,
      ',"article:author":"J. Doe","DC.date":"2003-04-16"}}}') end as body
from pages"""


def urls(dialect: str) -> str:
    return """
select page_id as article_id, case page_id % 25
  when 0 then 'example.com' when 1 then 'ftp://example.com/a' when 2 then 'https://192.168.1.1/page'
  when 3 then 'https://10.0.0.1/page' when 4 then 'https://172.16.0.1/page' when 5 then 'https://localhost/page'
  when 6 then 'https://127.0.0.1/page' when 7 then 'https://169.254.1.1/page' when 8 then 'https://93.184.216.34/page'
  when 9 then 'https://172.32.0.1/page' when 10 then 'https://100.64.0.1/page' when 11 then 'https:///nohost'
  when 12 then 'HTTPS://LOCALHOST:8080/x' when 13 then 'http://010.0.0.1/x' when 14 then 'https://[::1]/page'
  when 15 then 'https://[::ffff:192.168.1.1]/page' when 16 then 'https://[::ffff:127.0.0.1]:443/page'
  when 17 then 'https://[2606:4700::6810:84e5]/page' when 18 then 'https://user:pw@10.1.2.3:8443/page'
  when 19 then 'http://[bad' when 20 then 'http://240.1.2.3' else url end as url
from pages"""


IMAGE_KINDS = """(0, 'https://static.example.org/a/photo.jpg'), (1, 'https://alt.example.org/photo.jpg'),
  (2, 'https://static.example.org/fake.jpg'), (3, 'https://static.example.org/blob/abc'),
  (4, 'https://static.example.org/missing.png'), (5, 'https://static.example.org/loop.png'),
  (6, 'https://static.example.org/My%20Chart+v2.svg#f'), (7, 'hero'), (8, 'noext')"""


def attempts(dialect: str) -> str:
    """Retries that succeed, a permanent 404, a redirect-limit error, wrong, missing and octet-stream types,
    images of 12 and 30 MB."""
    source = repeat("pages", IMAGE_KINDS, "k, fixed_url", dialect)
    if dialect == ORACLE:
        source += ", (values (1), (2), (3), (4)) as a(attempt)"
    else:
        source += " lateral view explode(array(1, 2, 3, 4)) a as attempt"
    return f"""
select page_id as article_id,
  case when k = 7 then concat('https://cdn', cast(page_id % 5 as string), '.example.com/img/hero.png?w=800')
    when k = 8 then concat('https://cdn.example.com/abc', cast(page_id as string)) else fixed_url end as url,
  attempt,
  case when k = 4 then 404 when k = 1 and attempt < 3 and page_id % 3 = 0 then 503 else 200 end as http_status,
  case when k = 5 then 'too_many_redirects' end as error_kind,
  case when k = 2 or k = 0 and page_id % 7 = 0 then 'text/html; charset=utf-8'
    when k in (1, 3) then 'application/octet-stream' when k = 6 then cast(null as string)
    when k = 7 then 'IMAGE/PNG ; q=1' when k = 8 then case when page_id % 2 = 0 then 'image/webp' else 'image/x-new' end
    else 'image/jpeg' end as content_type,
  cast(case when k = 0 then 12 * 1024 * 1024 when k = 1 then 30 * 1024 * 1024 else 1000 + page_id end as bigint)
    as size_bytes
from {source}
where attempt = 1 or k = 4 or (k = 1 and page_id % 3 = 0 and attempt <= 3)"""


def redirects(dialect: str) -> str:
    """Chains of 0 to 7 hops (5 is the last allowed), some of them relative, some to a private address."""
    source = repeat("pages", "(0), (1), (2), (3), (4), (5), (6)", "h", dialect)
    return f"""
select concat('https://r.example.com/', cast(page_id as string), '/', cast(h as string)) as src,
  case when page_id % 9 = 0 and h = 1 then 'http://10.0.0.8/x.png'
    when page_id % 5 = 0 then concat('/', cast(page_id as string), '/', cast(h + 1 as string))
    when page_id % 5 = 1 then cast(h + 1 as string)
    else concat('https://r.example.com/', cast(page_id as string), '/', cast(h + 1 as string)) end as location
from {source}
where h < page_id % 8"""


def image_redirects(dialect: str) -> str:
    """Redirects of one image of each article: to a private address, over six hops, or over one."""
    source = repeat("pages", "(0), (1), (2), (3), (4), (5)", "h", dialect)
    first = "concat('https://cdn.example.com/abc', cast(page_id as string))"
    hop = "concat('https://r.example.com/i/', cast(page_id as string), '/', cast({} as string))"
    return f"""
select case when h = 0 then {first} else {hop.format("h")} end as src,
  case when page_id % 3 = 0 then 'http://10.0.0.8/x.png' else {hop.format("h + 1")} end as location
from {source}
where h = 0 or page_id % 3 = 1"""


def requested(dialect: str) -> str:
    """Urls to resolve: the start of every chain, and every page."""
    return """
select concat('https://r.example.com/', cast(page_id as string), '/0') as url from pages
union all select url from pages"""


def secrets(dialect: str) -> str:
    return """
select doc_id, case when doc_id % 10 = 0
  then concat(text, chr(10), 'Authorization: Bearer tok', cast(doc_id as string), ' end', chr(10), text)
  else text end as text
from documents"""


def published(dialect: str) -> str:
    """Slugs that an earlier run published: those of every fifth page title made of ASCII letters alone."""
    return f"""
select distinct lower(replace(t, ' ', '-')) as slug from ({_titled_pages()}) titled
where page_id % 5 = 0"""


VIEWS = {
    "articles": articles,
    "fetches": fetches,
    "urls": urls,
    "image_redirects": image_redirects,
    "attempts": attempts,
    "redirects": redirects,
    "requested": requested,
    "secrets": secrets,
    "published": published,
}
