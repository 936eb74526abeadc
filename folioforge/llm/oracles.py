"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folioforge.llm.chat import ALSO, END, LEARNED, SAYS, TURN
from folioforge.llm.licenses import NOTICE_SHARE, NOTICES
from folioforge.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op8_url_filters"] = rf"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(action, rhost, rpath) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits as (
  select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from (select distinct host, path from split), rules
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by host, path
)
select page_id, s.host, s.path, rule, coalesce(action, 'allow') as verdict
from split s left join fits f on s.host = f.host and s.path = f.path
"""


def _license_sql() -> str:
    def place(words: list[str], at: str = "i") -> str:
        return " and ".join(f"w[{at} + {k}] = '{word}'" for k, word in enumerate(words))

    base = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
    places = " union all ".join(f"select doc_id, copy, i - 1 as start, '{label}' as label from at_word where {place(words.split())}" for label, words in base)
    notices = []
    for notice in NOTICES:
        words, key = notice.words.split(), notice.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        share = " + ".join(f"coalesce(cast(w[i - {at} + {k}] = '{word}' as int), 0)" for k, word in enumerate(words))
        notices.append(f"select doc_id, copy, '{notice.label}' as label, ({share}) / {float(len(words))} as share from at_word where i > {at} and {place(key)}")
    return rf"""
with words as (
  select doc_id, row_number() over () as copy,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') as w
  from documents
), at_word as (
  select doc_id, copy, w, unnest(range(1, len(w) + 1)) as i from words
  where list_has_any(w, ['mit', 'apache', 'nc', 'gnu', 'mozilla', 'redistribution'])
), base as ({places}
), notice as (select doc_id, copy, label, share from ({' union all '.join(notices)}) where share >= {NOTICE_SHARE}
), by_base as (
  select copy, count(*) as n, min(start) as first, max(start) as last, string_agg(distinct label, ',' order by label) as labels from base group by copy
), by_label as (
  select copy, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from (select copy, label, 1.0 as share from base union all select copy, label, share from notice) group by copy
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, cast(first as bigint) as first_word, cast(last as bigint) as last_word,
  coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels, cast(coalesce(score, 0) as double) as score
from words left join by_base b using (copy) left join by_label l using (copy)
"""


ORACLES["op6_license_scan"] = _license_sql()


def _code_sql() -> str:
    """Every part against every entry, in as many steps as there are rounds. Vectors are as long as the longest."""

    def assigned(name: str, book: str) -> str:
        return f"""{name} as materialized (
  select p.n, part, min(struct_pack(d := list_sum(list_transform(list_zip(v, e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), entry := entry)) as near
  from parts p join {book} using (part) group by p.n, part
)"""

    def means(name: str, book: str, before: str) -> str:
        return f"""{name}_of as (
  select part, near.entry as entry, i, floor(sum(v[i]::hugeint)::double / count(*))::bigint as c
  from {before} join parts using (n, part), range(1, (select width + 1 from dim)) t(i) group by all
), {name} as materialized (
  select b.part, b.entry, coalesce(m.e, b.e) as e from {book} b
  left join (select part, entry, list(c order by i) as e from {name}_of group by all) m using (part, entry)
)"""

    rounds = ", ".join(f"{assigned(f'near{r}', f'book{r}')}, {means(f'book{r + 1}', f'book{r}', f'near{r}')}" for r in range(ROUNDS))
    return f"""
with kept as (
  select row_number() over (order by vec_id nulls last, ints) as n, * from (
    select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as ints from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
), dim as (select greatest(1, cast(ceil(max(len(ints)) / {float(PARTS)}) as bigint)) as width from kept
), parts as materialized (
  select n, part, list_transform(range(part * width + 1, part * width + width + 1), lambda i: coalesce(ints[i], 0)) as v
  from kept, dim, range({PARTS}) t(part)
), book0 as materialized (select part, n - 1 as entry, v as e from parts where n <= {ENTRIES}
), {rounds}, {assigned("final", f"book{ROUNDS}")}, coded as (
  select n, string_agg(printf('%02x', near.entry), '' order by part) as code, sum(near.d)::bigint as error from final group by n
), digest as (
  select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as codebooks_sha256 from book{ROUNDS}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (n), digest
"""


ORACLES["op12_vector_codes"] = _code_sql()


def _chat_sql() -> str:
    control = r"<(\\*)(turn>|says>|also>|/turn>)"
    escape = lambda column: rf"regexp_replace({column}, '{control}', '<\\\1\2', 'g')"
    return rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), placed as (
  select *, row_number() over w as n, lag(role) over w as before from turns
  window w as (partition by conv_id order by turn nulls last, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = '{LEARNED}'), '')) as loss_sha256,
  cast(sum(length({escape("text")}) + case when before = role then {len(ALSO)} else length({escape("role")}) + {len(TURN + SAYS + END)} end) as bigint) as formatted_chars
from placed group by conv_id
"""


ORACLES["op13_chat_format"] = _chat_sql()
