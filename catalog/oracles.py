"""The same results in plain SQL for another engine.

Each query is a SELECT over named building blocks; ``oracle`` puts the blocks a query needs in front of it.
The SQL is written independently of the operators: windows, unnesting and recursion instead of folds.
"""

from __future__ import annotations

import re

from catalog import views

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
KNOWN = "('.png', '.jpg', '.gif', '.webp', '.svg', '.avif', '.bmp', '.tiff', '.jpeg')"
DOWNLOADED, STAMP, TOOL = "2026-01-01T00:00:00Z", "20260101-000000", "folioforge v0.1.0"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def has_text(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{SPACE}]'), false)"


def slugify(x: str) -> str:
    clean = (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[{SPACE}_]+', '-', 'g'),"
        " '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-')"
    )
    cut = (
        "case when length(s) <= 80 then s when contains(left(s, 80), '-')"
        " then regexp_replace(left(s, 80), '-[^-]*$', '') else left(s, 80) end"
    )
    return let(clean, "s", cut)


def to_ascii(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def best_slug(x: str) -> str:
    return let(
        f"{{'d': {slugify(x)}, 'a': {slugify(to_ascii(x))}}}",
        "both_slugs",
        "nullif(case when length(both_slugs.a) > length(both_slugs.d) then both_slugs.a else both_slugs.d end, '')",
    )


def heading(x: str) -> str:
    return f"nullif({strip(f"regexp_extract({x}, '(?m)^#[{SPACE}]+(.+)$', 1)")}, '')"


def authority(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def host(x: str) -> str:
    return f"lower(regexp_extract(regexp_extract({authority(x)}, '[^@]*$', 0), '^[^:]*', 0))"


def path(x: str) -> str:
    whole = f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({whole}, ';[^/]*$', '')"


def url_path(x: str) -> str:
    return f"trim({path(x)}, '/')"


def date(x: str) -> str:
    tries = ", ".join(
        f"strftime(try_strptime({x}, '{form}'), '%Y-%m-%d')"
        for form in ("%a, %d %b %Y %H:%M:%S GMT", "%Y-%m-%d", "%B %d, %Y")
    )
    iso = rf"case when regexp_matches({x}, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d') then left({x}, 10) end"
    return f"coalesce({tries}, {iso}, {x})"


def yaml(x: str) -> str:
    for char, escaped in ((r"'\'", r"'\\'"), ("'\"'", "'\\\"'"), ("chr(10)", r"'\n'"), ("chr(13)", r"'\r'"), ("chr(9)", r"'\t'")):
        x = f"replace({x}, {char}, {escaped})"
    return x


def field(name: str, x: str) -> str:
    return f"'{name}: \"' || {yaml(x)} || '\"'"


def mime(x: str) -> str:
    return f"lower({strip(f"split_part(nullif({x}, ''), ';', 1)")})"


def type_ext(x: str) -> str:
    return (
        f"case {mime(x)} when 'image/png' then '.png' when 'image/jpeg' then '.jpg' when 'image/gif' then '.gif'"
        " when 'image/webp' then '.webp' when 'image/svg+xml' then '.svg' when 'image/avif' then '.avif'"
        " when 'image/bmp' then '.bmp' when 'image/tiff' then '.tiff' end"
    )


def segment(x: str) -> str:
    return f"regexp_extract({path(x)}, '[^/]*$', 0)"


def suffix(x: str) -> str:
    return rf"regexp_extract({x}, '\.[^.]*$', 0)"


def safe_name(x: str) -> str:
    return f"regexp_replace(url_decode({segment(x)}), '[^a-zA-Z0-9._-]', '-', 'g')"


def base(x: str) -> str:
    stem = rf"regexp_replace({safe_name(x)}, '\.[^.]*$', '')"
    return f"coalesce(nullif(trim(regexp_replace({stem}, '-{{2,}}', '-', 'g'), '-'), ''), 'image')"


def url_ext(x: str) -> str:
    return suffix(safe_name(x))


def extension(content_type: str, url: str) -> str:
    ext = url_ext(url)
    return (
        f"coalesce({type_ext(content_type)}, case when lower({ext}) in {KNOWN} then lower({ext}) end,"
        f" nullif({ext}, ''), case when {mime(content_type)} like 'image/%' then '.bin' end, '')"
    )


def rejection(content_type: str, url: str) -> str:
    known = f"lower({suffix(segment(url))}) in {KNOWN}"
    return (
        f"case when {mime(content_type)} is null then case when not {known} then 'no_content_type' end"
        f" when {mime(content_type)} like 'image/%' then null"
        f" when {mime(content_type)} = 'application/octet-stream' then case when not {known} then 'unknown_octet_stream' end"
        " else 'not_an_image' end"
    )


def entities(x: str) -> str:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
    for entity, char in pairs:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def gsub(x: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, '{pattern}', {replacement}, 'g')"
    return x


def markdown_of_page() -> str:
    """Regular expressions of the other engine's dialect, for the constructs that occur in the pages."""
    seen = gsub("html", (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "' '"), (r"[ \t\r\n\f]+", "' '"))
    part = f"regexp_extract({seen}, '(?is)<article[^>]*>(.*?)</article>', 1)"
    quoted = "[\"'']([^\"'']*)[\"'']"
    text = gsub(
        part,
        (r"(?is)<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<aside\b.*?</aside\s*>", "' '"),
        (rf"(?i)<a\b[^>]*\shref={quoted}[^>]*>([^<]*)</a\s*>", r"'[\2](\1)'"),
        (r"(?i)<(?:b|strong)>([^<]+)</(?:b|strong)\s*>", r"'**\1**'"),
        (r"(?i)<(?:i|em)>([^<]+)</(?:i|em)\s*>", r"'*\1*'"),
        *((rf"(?i)<h{n}(?:\s[^>]*)?>", f"chr(10) || chr(10) || '{'#' * n} '") for n in range(1, 7)),
        (r"(?i)<li(?:\s[^>]*)?>", "chr(10) || '- '"),
        (r"(?i)<br\s*/?>", "chr(10)"),
        (r"(?i)</?(?:p|div|section|ul|ol|blockquote|pre|table|tr)(?:\s[^>]*)?>|</h[1-6]>", "chr(10) || chr(10)"),
        (r"<[A-Za-z/!?][^>]*>", "''"),
        (r" *\n *", "chr(10)"),
        (" {2,}", "' '"),
        (r"\n{3,}", "chr(10) || chr(10)"),
    )
    return strip(entities(text))


def meta_json(*keys: str) -> str:
    tries = ", ".join(
        f"case when json_type(body, '$.data.metadata.\"{key}\"') = 'VARCHAR' and {has_text(f"body->>'$.data.metadata.\"{key}\"'")}"
        f" then {strip(f"body->>'$.data.metadata.\"{key}\"'")} end"
        for key in keys
    )
    return f"coalesce({tries})"


BLOCKS = {
    **{f"{name}": build(views.ORACLE) for name, build in views.VIEWS.items()},
    "responses": """
select article_id, url, http_status, error_kind, case when json_valid(body) then body::json end as body from fetches""",
    "read_articles": f"""
select article_id, url as source_url, nullif(body->>'$.data.title', '') as title,
  {meta_json("author", "article:author", "og:author", "citation_author")} as author,
  coalesce(nullif(body->>'$.data.publishedTime', ''), {meta_json("article:published_time", "date", "DC.date")}) as date,
  nullif(body->>'$.data.description', '') as description,
  body->>'$.data.content' as markdown,
  case when error_kind is not null or http_status is null then 'unreachable' when http_status = 429 then 'rate_limit'
    when http_status >= 400 then 'http_error' when body is null then 'decode_error'
    when not {has_text("body->>'$.data.content'")} then 'empty_content' else 'ok' end as fetch_class
from responses""",
    "html_articles": f"""
select page_id as article_id, url as source_url,
  nullif({strip(entities("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))}, '') as title,
  cast(null as varchar) as author, cast(null as varchar) as date, cast(null as varchar) as description,
  {markdown_of_page()} as markdown
from pages""",
    **{
        f"{prefix}titled": f"""
select * exclude (title, ts, h, hs, p, ps), coalesce(ts, hs, ps, 'article-{STAMP}') as slug,
  case when ts is not null then title when hs is not null then h when ps is not null
    then {authority("source_url")} || '/' || p else source_url end as title
from (select *, {best_slug("h")} as hs, nullif({slugify("p")}, '') as ps
  from (select *, {best_slug("title")} as ts, {heading("markdown")} as h, {url_path("source_url")} as p from {source}))"""
        for prefix, source in (("", "articles"), ("read_", "usable"), ("html_", "html_articles"))
    },
    "usable": "select * exclude (fetch_class) from read_articles where fetch_class = 'ok'",
    **{
        f"{prefix}fronted": f"""
select *, concat_ws(chr(10), '---', {field("title", "title")}, {field("author", "author")},
  {field("date", date("nullif(date, '')"))}, {field("source_url", "source_url")}, {field("description", "description")},
  'downloaded: "{DOWNLOADED}"', 'tool: "{TOOL}"', '---') || chr(10) as front_matter
from {prefix}titled"""
        for prefix in ("", "html_")
    },
    "matches": r"""
select article_id, unnest(found) as original_match, unnest(range(len(found))) as place
from (select article_id, regexp_extract_all(markdown, '(?s)!\[.*?\]\([^)]+\)') as found from articles)""",
    "match_parts": r"""
select article_id, place, original_match, regexp_extract(original_match, '(?s)^!\[(.*?)\]\(([^)]+)\)$', 1) as alt,
  regexp_extract(original_match, '(?s)^!\[(.*?)\]\(([^)]+)\)$', 2) as written from matches""",
    "refs": f"""
select article_id, cast(row_number() over (partition by article_id order by place) - 1 as integer) as pos, alt,
  {strip("written")} as url, original_match
from match_parts where regexp_matches({strip("written")}, '(?i)^https?:')""",
    "images": """
select article_id, url, pos, mentions, cast(row_number() over (partition by article_id order by pos) as integer) as seq
from (select article_id, url, min(pos) as pos, cast(count(*) as integer) as mentions from refs group by all)""",
    "settled": """
select * from attempts
where attempt between 1 and 4 and (error_kind is null and http_status < 400 or error_kind = 'too_many_redirects')
qualify row_number() over (partition by article_id, url order by attempt) = 1""",
    "resolved": """
select t.article_id, t.url, s.attempt is not null and s.error_kind is null as stored_ok,
  coalesce(s.attempt, t.last_attempt) as attempts,
  case when s.attempt is null then 'attempts_failed' else s.error_kind end as failure, s.content_type, s.size_bytes
from (select article_id, url, max(attempt) as last_attempt from attempts where attempt between 1 and 4 group by all) t
left join settled s using (article_id, url)""",
    "judged": rf"""
select i.article_id, i.seq, i.url, r.attempts, r.content_type, r.size_bytes,
  case when regexp_matches(i.url, '^https?://(192\.168|10\.)') then 'private_host'
    when r.stored_ok is null then 'no_response' when r.failure is not null then r.failure
    else {rejection("r.content_type", "i.url")} end as failure
from images i left join resolved r using (article_id, url)""",
    "named": f"""
select article_id, seq, url, size_bytes, {base("url")} as base, {extension("content_type", "url")} as ext
from judged where failure is null""",
    "manifest": """
select article_id, seq, url, printf('%03d-', seq) || base || case when nth = 1 then '' else '-' || chr(cast(95 + nth as int)) end || ext
  as filename, size_bytes
from (select *, row_number() over (partition by article_id, base || ext order by seq) as nth from named)""",
    "changes": """
select article_id, list(old || chr(2) || new order by pos) as changes
from (select r.article_id, r.original_match as old, '![' || r.alt || '](./images/' || m.filename || ')' as new, min(r.pos) as pos
  from refs r join manifest m using (article_id, url) group by all) group by article_id""",
    "rewritten": """
select article_id, list_reduce(list_prepend(markdown, coalesce(changes, cast([] as varchar[]))),
  lambda text, change: replace(text, split_part(change, chr(2), 1), split_part(change, chr(2), 2))) as markdown
from articles left join changes using (article_id)""",
    "found": """
select article_id, cast(count(distinct url) as integer) as images_found from articles left join refs using (article_id) group by 1""",
    "stored": """
select article_id, cast(count(*) as integer) as images_downloaded, cast(sum(size_bytes) as bigint) as image_bytes
from manifest group by 1""",
    "results": """
select article_id, images_found, coalesce(images_downloaded, 0) as images_downloaded,
  images_found - coalesce(images_downloaded, 0) as images_failed, coalesce(image_bytes, 0) as image_bytes,
  case when images_found > coalesce(images_downloaded, 0) then 'Partial success' else 'Success' end as outcome
from found left join stored using (article_id)""",
    "totals": """
select *, cast(sum(size_bytes) over (partition by article_id order by seq) as bigint) as total_bytes from manifest""",
    "ranked": """
select article_id, slug, row_number() over (partition by slug order by article_id) as nth,
  row_number() over (partition by slug order by article_id desc) as nth_last,
  slug in (select slug from published) as taken
from titled""",
    "edges": """
select src, case when location like 'http%' then location
  when location like '/%' then regexp_extract(src, '^https?://[^/]*', 0) || location
  else regexp_replace(src, '[^/]*$', '') || location end as target from redirects""",
    "walk": r"""
select url, url as current, 0 as hops, 'open' as state from (select distinct url from requested)
union all
select w.url, e.target, w.hops + 1, case when regexp_matches(e.target, '^https?://10\.') then 'private_target' else 'open' end
from walk w join edges e on e.src = w.current where w.state = 'open' and w.hops < 6""",
    "counts": rf"""
select article_id, cast(count(original_match) as integer) as images,
  cast(count(*) filter (written like 'data:%') as integer) as data_uris,
  cast(count(*) filter (contains(alt, chr(10))) as integer) as multiline_alts,
  cast(count(*) filter (contains(written, '?')) as integer) as query_urls,
  cast(count(*) filter (contains(written, '#')) as integer) as fragment_urls,
  cast(count(*) filter (contains(written, '(')) as integer) as paren_urls,
  cast(count(*) filter (original_match is not null and not {has_text("alt")}) as integer) as empty_alts,
  cast(count(*) filter (regexp_matches(written, '\s["''][^"'']*["'']\s*$')) as integer) as title_attributes
from articles left join match_parts using (article_id) group by 1""",
    "profile": r"""
select c.*,
  cast(len(regexp_extract_all(markdown, '(?i)<img\s[^>]*src=["''][^"'']+["''][^>]*/?\s*>')) as integer) as html_images,
  cast(len(regexp_extract_all(markdown, '!\[[^\]]*\]\[[^\]]+\]')) as integer) as reference_style,
  cast(coalesce(list_sum(list_transform(regexp_extract_all(markdown, '(?s)```.*?```'),
    lambda b: len(regexp_extract_all(b, '(?s)!\[.*?\]\([^)]+\)')))), 0) as integer) as in_code_fences,
  cast(len(regexp_extract_all(markdown, '\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)')) as integer) as image_links
from counts c join articles using (article_id)""",
    "corpus": f"""
select article_id, source_url, case when nth = 1 then slug else slug || '-{STAMP}--' || article_id end as slug,
  case when nth = 1 then 'new' else 'renamed' end as slug_status, outcome, images_found, images_downloaded, images_failed,
  image_bytes, front_matter || chr(10) || r.markdown as content
from (select *, row_number() over (partition by slug order by article_id) as nth from fronted) f
join rewritten r using (article_id) join results using (article_id)""",
}


def oracle(select: str) -> str:
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in BLOCKS:
            if name != own and name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
                visit(BLOCKS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    blocks = ",\n".join(f"{name} as ({BLOCKS[name].strip()})" for name in needed)
    return f"with {'recursive ' if 'walk' in needed else ''}{blocks}\n{select.strip()}"


def _policy(final: str, status: str) -> str:
    return oracle(f"select article_id, slug, {final} as final_slug, {status} as slug_status from ranked")


LOG_COLUMNS = "article_id, url, attempt, http_status, error_kind, content_type, size_bytes"
RENAMED = f"slug || '-{STAMP}--' || article_id"
IP_HOST = r"^https?://(?:[^/@]*@)?\[?(?:::ffff:)?"
PRIVATE = IP_HOST + r"(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.|240\.)"
LOOPBACK = IP_HOST + r"127\.|^https?://\[::1\]"

ORACLES = {
    "read_reader_responses": oracle("select * from read_articles"),
    "read_html_pages": oracle(
        f"select *, case when {has_text('markdown')} then 'ok' else 'empty_content' end as fetch_class from html_articles"
    ),
    "read_image_responses": oracle(f"select {LOG_COLUMNS}, {mime('content_type')} as mime from attempts"),
    "write_articles": oracle("select article_id, slug, front_matter || chr(10) || markdown as content from fronted"),
    "write_image_manifest": oracle("select * from manifest"),
    "publish_corpus": oracle("""
select slug, slug || '/article.md' as path, article_id, front_matter || chr(10) || r.markdown as content,
  'second' as batch_id, cast(coalesce(images_downloaded, 0) as bigint) as images
from (select * from fronted qualify row_number() over (partition by slug order by article_id desc) = 1) f
join rewritten r using (article_id) left join stored using (article_id)"""),
    "publish_relanded": oracle("""
select slug, slug || '/article.md' as path, article_id,
  front_matter || chr(10) || r.markdown || case when article_id % 2 = 0 then chr(10) || 'more' else '' end as content,
  case when article_id % 2 = 0 then 'second' else 'first' end as batch_id, cast(coalesce(images_downloaded, 0) as bigint) as images
from (select * from fronted qualify row_number() over (partition by slug order by article_id) = 1) f
join rewritten r using (article_id) left join stored using (article_id)"""),
    "publish_late_images": oracle("""
select slug, slug || '/article.md' as path, article_id, front_matter || chr(10) || r.markdown as content,
  case when article_id % 2 = 0 then 'second' else 'first' end as batch_id, cast(coalesce(images_downloaded, 0) as bigint) as images
from (select * from fronted qualify row_number() over (partition by slug order by article_id) = 1) f
join rewritten r using (article_id) left join stored using (article_id)"""),
    "validate_urls": oracle(rf"""
select article_id, url, case when not regexp_matches(url, '(?i)^https?:') then 'URL must start with http:// or https://'
  when url like '%[bad' then 'URL has a malformed host'
  when url like '%///%' then 'URL must include a non-empty host'
  when regexp_matches(url, '(?i)^https?://localhost[:/]') then 'Localhost URLs are not allowed'
  when regexp_matches(url, '{LOOPBACK}') then 'Loopback IP URLs are not allowed'
  when regexp_matches(url, '{PRIVATE}') then 'Private IP URLs are not allowed' end as url_error
from urls"""),
    "is_private_host": oracle(rf"""
select article_id, url, regexp_matches(url, '(?i)^https?://localhost[:/]|{LOOPBACK}|{PRIVATE}') as is_private_host from urls"""),
    "classify_fetch": oracle("select article_id, source_url, fetch_class from read_articles"),
    "filter_usable_articles": oracle("select article_id, source_url, markdown from usable"),
    "accept_image_response": oracle(
        f"select article_id, url, attempt, content_type, {rejection('content_type', 'url')} as rejection from attempts"
    ),
    "http_scheme_filter": oracle("""
select article_id, cast(count(distinct place) as integer) as matches, cast(count(distinct pos) as integer) as web_refs
from articles left join matches using (article_id) left join refs using (article_id) group by 1"""),
    "extract_metadata": oracle("select article_id, title, author, date, description from usable"),
    "normalize_date": oracle(f"""
select article_id, date, {date("date")} as normalized
from (select article_id, date from read_articles union all select article_id, date from articles)"""),
    "transliterate": oracle(f"select doc_id, {to_ascii('text')} as ascii_text from documents"),
    "slugify": oracle(f"""
select doc_id, {slugify("text")} as slug from (select doc_id, text from documents
  union all select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) from pages)"""),
    "extract_h1": oracle(f"select article_id, {heading('markdown')} as heading from articles"),
    "url_path_slug": oracle(f"""
select page_id as article_id, nullif({slugify(url_path("url"))}, '') as slug,
  {authority("url")} || '/' || {url_path("url")} as title from pages"""),
    "resolve_title_slug": oracle("select article_id, slug, title from titled"),
    "front_matter": oracle("select article_id, front_matter from fronted"),
    "assemble_documents": oracle("select article_id, slug, front_matter || chr(10) || markdown as content from fronted"),
    "redact_secrets": oracle(rf"""
select doc_id, regexp_replace(regexp_replace(text, 'Bearer[{SPACE}]+[^{SPACE}]+', '[REDACTED]', 'g'),
  'Authorization:[{SPACE}]*[^{SPACE}]+', '[REDACTED]', 'g') as text from secrets"""),
    "extract_image_refs": oracle("""
select article_id, cast(count(url) as integer) as refs, coalesce(string_agg(url, ' ' order by pos), '') as urls,
  coalesce(string_agg(alt, '|' order by pos), '') as alts
from articles left join refs using (article_id) group by 1"""),
    "explode_image_refs": oracle("select * from refs"),
    "image_sequence": oracle("select article_id, url, pos, seq from images"),
    "dedup_image_urls": oracle("select article_id, url, pos, mentions from images"),
    "image_filename_parts": oracle(f"select article_id, pos, url, {base('url')} as base, {url_ext('url')} as ext from refs"),
    "image_extension": oracle(
        f"select article_id, url, attempt, {extension('content_type', 'url')} as extension from attempts"
    ),
    "image_local_filename": oracle("select * from manifest"),
    "rewrite_image_refs": oracle("select * from rewritten"),
    "image_syntax_profile": oracle("select * from profile"),
    "image_syntax_totals": oracle(r"""
select (select count(*) from articles) + (select count(*) from documents) as documents,
  count(*) filter (images > 0) as with_images,
  cast(sum(images) as bigint) as images, cast(sum(data_uris) as bigint) as data_uris,
  cast(sum(multiline_alts) as bigint) as multiline_alts, cast(sum(query_urls) as bigint) as query_urls,
  cast(sum(fragment_urls) as bigint) as fragment_urls, cast(sum(paren_urls) as bigint) as paren_urls,
  cast(sum(empty_alts) as bigint) as empty_alts, cast(sum(html_images) as bigint) as html_images,
  cast(sum(reference_style) as bigint) as reference_style, cast(sum(in_code_fences) as bigint) as in_code_fences,
  cast(sum(image_links) as bigint) as image_links, cast(sum(title_attributes) as bigint) as title_attributes
from (select * exclude (article_id) from profile union all by name
  select cast(len(regexp_extract_all(text, '(?s)!\[.*?\]\([^)]+\)')) as integer) as images, 0 as data_uris,
    0 as multiline_alts, 0 as query_urls, 0 as fragment_urls, 0 as paren_urls, 0 as empty_alts, 0 as title_attributes,
    cast(len(regexp_extract_all(text, '(?i)<img\s[^>]*src=["''][^"'']+["''][^>]*/?\s*>')) as integer) as html_images,
    cast(len(regexp_extract_all(text, '!\[[^\]]*\]\[[^\]]+\]')) as integer) as reference_style,
    0 as in_code_fences, 0 as image_links
  from documents)"""),
    "resolve_image_refs": oracle(
        "select article_id, pos, alt, url, filename from refs left join manifest using (article_id, url)"
    ),
    "failed_images": oracle("select article_id, seq, url, attempts, failure from judged where failure is not null"),
    "content_type_lookup": oracle(
        f"select article_id, url, attempt, content_type, {type_ext('content_type')} as type_ext from attempts"
    ),
    "resolve_redirects": oracle("""
select url, case when status in ('direct', 'ok') then current end as final_url, hops, status as redirect_status
from (select url, current, hops, case when hops = 0 then 'direct' when state <> 'open' then state
    when hops = 6 then 'too_many_redirects' else 'ok' end as status
  from walk qualify row_number() over (partition by url order by hops desc) = 1)"""),
    "publish_conflicts": oracle("select article_id, slug from titled where slug in (select slug from published)"),
    "count_unique_images": oracle("select * from found"),
    "resolve_attempts": oracle("select * from resolved"),
    "run_results": oracle(
        "select article_id, outcome, images_found, images_downloaded, images_failed from results"
    ),
    "run_status": oracle(rf"""
select * from (with judged as (select article_id, case when not regexp_matches(url, '(?i)^https?:') then 'URL must start with http:// or https://'
  when url like '%[bad' then 'URL has a malformed host' when url like '%///%' then 'URL must include a non-empty host'
  when regexp_matches(url, '(?i)^https?://localhost[:/]') then 'Localhost URLs are not allowed'
  when regexp_matches(url, '{LOOPBACK}') then 'Loopback IP URLs are not allowed'
  when regexp_matches(url, '{PRIVATE}') then 'Private IP URLs are not allowed' end as url_error from urls)
select article_id, url_error, fetch_class, slug_status, case when url_error is not null then 1
  when fetch_class <> 'ok' then 2 when slug_status = 'conflict' then 3 else 0 end as status
from judged join (select article_id, fetch_class from read_articles) using (article_id)
left join (select article_id, case when row_number() over (partition by slug order by article_id) = 1 then 'new'
  else 'conflict' end as slug_status from read_titled
  where article_id in (select article_id from judged where url_error is null)) using (article_id))"""),
    "corpus_report": oracle(f"""
select {host("source_url")} as host, count(*) as articles, count(*) filter (outcome = 'Success') as succeeded,
  count(*) filter (outcome = 'Partial success') as partly_succeeded, cast(sum(images_found) as bigint) as images_found,
  cast(sum(images_downloaded) as bigint) as images_downloaded, cast(sum(images_failed) as bigint) as images_failed
from results join articles using (article_id) group by rollup(1)"""),
    "running_image_bytes": oracle("""
select *, total_bytes > 41943040 and total_bytes - size_bytes <= 41943040 as crosses_limit from totals"""),
    "resource_warnings": oracle("""
select article_id, 'image_count' as warning, cast(null as varchar) as subject, cast(images_found as bigint) as amount
from found where images_found > 6
union all select article_id, 'image_size', filename, size_bytes from manifest where size_bytes > 10485760
union all select article_id, 'article_size', filename, total_bytes from totals
  where total_bytes > 41943040 and total_bytes - size_bytes <= 41943040"""),
    "slug_conflict_policy_fail": _policy(
        "case when nth = 1 and not taken then slug end", "case when nth = 1 and not taken then 'new' else 'conflict' end"
    ),
    "slug_conflict_policy_overwrite": _policy(
        "case when nth_last = 1 then slug end",
        "case when nth_last > 1 then 'superseded' when taken then 'replaces' else 'new' end",
    ),
    "slug_conflict_policy_suffix": _policy(
        f"case when nth = 1 and not taken then slug else {RENAMED} end",
        "case when nth = 1 and not taken then 'new' else 'renamed' end",
    ),
    "build_corpus": oracle("select * from corpus"),
    "build_corpus_incremental": oracle("""
select slug, slug || '/article.md' as path, article_id, front_matter || chr(10) || markdown as content
from html_fronted qualify row_number() over (partition by slug order by article_id) = 1"""),
}


def _with_redirects(sql: str) -> str:
    """Attempts at an image whose redirects fail have failed."""
    marked = """,
marked_attempts as (
  select * replace (coalesce(error_kind, case when url <> 'https://cdn.example.com/abc' || article_id then null
    when article_id % 3 = 0 then 'private_target' when article_id % 3 = 1 then 'too_many_redirects' end) as error_kind)
  from attempts)"""
    used = re.sub(r"\bfrom attempts\b", "from marked_attempts", sql)
    return used.replace(",\nsettled as (", f"{marked},\nsettled as (", 1)


ORACLES["build_corpus_redirects"] = _with_redirects(ORACLES["build_corpus"])
