"""Comparison SQL (DuckDB dialect) for the registered queries.

The texts say the same as the operators in a different way: correlated
sub-queries instead of look-back windows, a row-by-row recursion instead of
matching rounds, global row numbers instead of range partitions.
"""

from __future__ import annotations

from ..functions import fixed_values as fixed
from ..functions.text import WHITESPACE
from . import views

ORACLE: dict[str, str] = {}

_WITH = {
    "channels_fx": views.CHANNELS_SQL,
    "lines_fx": views.LINES_SQL,
    "small_lines_fx": views.SMALL_LINES_SQL,
    "responses_fx": views.RESPONSES_SQL,
    "documents_fx": views.DOCUMENTS_SQL,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _trim(x: str) -> str:
    return f"trim({x}, {_q(WHITESPACE)})"


def _norm_url(x: str) -> str:
    low = f"rtrim(lower({_trim(x)}), '/')"
    tracking = " or ".join(f"starts_with(p, {_q(p)})" for p in fixed.TRACKING_PREFIXES)
    params = f"""list_transform(list_sort(list_transform(list_filter(
        string_split(substr({low}, instr({low}, '?') + 1), '&'), lambda p: p <> '' and not ({tracking})),
        lambda p: {{'k': upper(p), 'p': p}})), lambda s: s.p)"""
    base = f"substr({low}, 1, instr({low}, '?') - 1)"
    rebuilt = f"case when len({params}) > 0 then {base} || '?' || array_to_string({params}, '&') else {base} end"
    kept = f"case when instr({low}, '?') > 1 then {rebuilt} else {low} end"
    return f"replace(replace(replace({kept}, ':80/', '/'), ':443/', '/'), '://www.', '://')"


def _norm_name(x: str) -> str:
    text = (
        f"case when upper(substr({x}, 1, 7)) = '#EXTINF' and instr({x}, ',') > 1 and instr({x}, ',') < length({x})"
        f" then substr({x}, instr({x}, ',') + 1) else {x} end"
    )
    tags = "|".join(fixed.QUALITY_TAGS)
    short = f"regexp_replace(lower({_trim(text)}), '\\s*({tags})\\s*$', '')"
    words = f"regexp_replace({short}, '[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g')"
    return f"trim({words})"


def _eligible(x: str) -> str:
    n = _norm_name(x)
    return f"case when length({n}) > 3 and {n} not in {_list(fixed.GENERIC_NAMES)} then {n} end"


def _valid(x: str) -> str:
    host = f"regexp_extract({x}, '^[^:]*://([^/?#:]*)', 1)"
    path = f"regexp_extract({x}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    schemes = "|".join(fixed.STREAM_SCHEMES)
    endings = " or ".join(f"ends_with(lower({path}), {_q('.' + e)})" for e in fixed.NON_MEDIA_EXTENSIONS)
    return (
        f"(regexp_matches({x}, '(?i)^({schemes})://') and regexp_full_match({host}, '[\\w.-]+')"
        f" and length({host}) >= 3 and lower({host}) not in {_list(fixed.LOCAL_HOSTS)} and not ({endings}))"
    )


def _attribute(line: str, name: str) -> str:
    return f"nullif({_trim(f'''regexp_extract({line}, '(?i){name}\\s*=\\s*\"([^\"]*)\"', 1)''')}, '')"


def _name(line: str) -> str:
    after_comma = f"regexp_extract({line}, '(?i)#EXTINF\\s*:\\s*-?\\d+[^,]*,\\s*(.+)$', 1)"
    return f"coalesce(nullif({_trim(after_comma)}, ''), {_attribute(line, 'tvg-name')}, {line})"


def _extras(line: str) -> str:
    """Extra attributes as ``key=value;...``: first spelling and place, last value."""
    pattern = '(\\w+[-\\w]*)\\s*=\\s*"([^"]*)"'
    keys = f"regexp_extract_all({line}, '{pattern}', 1)"
    values = f"regexp_extract_all({line}, '{pattern}', 2)"
    known = "[" + ", ".join(map(_q, fixed.KNOWN_ATTRIBUTES)) + "]"
    pairs = (
        f"list_filter(list_zip({keys}, {values}), lambda z: not list_contains({known}, lower(z[1])) and trim(z[2]) <> '')"
    )
    firsts = (
        f"list_filter({pairs}, lambda z, i: len(list_filter(({pairs})[1:i-1], lambda y: lower(y[1]) = lower(z[1]))) = 0)"
    )
    last = f"list_filter({pairs}, lambda y: lower(y[1]) = lower(z[1]))[-1][2]"
    return f"array_to_string(list_transform({firsts}, lambda z: z[1] || '=' || {last}), ';')"


def _parse(lines: str) -> str:
    """CTEs up to ``parsed``: channels with ``file, line_no`` from a lines view."""
    return f"""
  l as (select file, line_no, line, {_trim('line')} t from {lines}),
  u as (select file, line_no, t from l where {_valid('t')}),
  e as (select file, line_no, t from l where upper(substr(t, 1, 7)) = '#EXTINF'),
  g as (select file, line_no, {_trim('substr(t, 9)')} grp from l where upper(substr(t, 1, 8)) = '#EXTGRP:'),
  pair as (select u.file, u.line_no, u.t link, min(e.line_no) entry_no
    from u join e on e.file = u.file and e.line_no between u.line_no - 4 and u.line_no - 1
    where not exists (select 1 from u v where v.file = u.file and v.line_no > e.line_no and v.line_no < u.line_no)
    group by all),
  header as (select file, coalesce({_attribute('line', 'x-tvg-url')}, {_attribute('line', 'url-tvg')}) epg
    from l where line_no = 0 and upper(substr(line, 1, 7)) = '#EXTM3U'),
  override as (select p.file, p.line_no, max_by(g.grp, g.line_no) grp
    from pair p join g on g.file = p.file and g.line_no > p.entry_no and g.line_no < p.line_no group by all),
  parsed as (select p.file, p.line_no, {_name('e.t')} "name",
      regexp_replace(p.link, '["'']+$', '') link,
      coalesce(o.grp, {_attribute('e.t', 'group-title')}, '') group_name,
      {_attribute('e.t', 'tvg-id')} tvg_id, {_attribute('e.t', 'tvg-name')} tvg_name,
      {_attribute('e.t', 'tvg-logo')} tvg_logo,
      coalesce({_attribute('e.t', 'x-tvg-url')}, h.epg) epg_url, {_extras('e.t')} extra_attributes
    from pair p join e on e.file = p.file and e.line_no = p.entry_no
    left join header h on h.file = p.file
    left join override o on o.file = p.file and o.line_no = p.line_no),
  numbered as (select row_number() over (order by file, line_no) - 1 id, * from parsed)"""


def _greedy(rows: str) -> str:
    """CTEs up to ``kept(id)``: one row after the other against the keys seen."""
    return f"""
  keyed as (select row_number() over (order by id) rn, id, {_norm_url('link')} lk, {_eligible('"name"')} nk from {rows}),
  walk(rn, id, ok, links, names) as (
    select cast(0 as bigint), cast(-1 as bigint), false, cast([] as varchar[]), cast([] as varchar[])
    union all
    select k.rn, k.id, k.free, case when k.free then list_append(links, k.lk) else links end,
      case when k.free and k.nk is not null then list_append(names, k.nk) else names end
    from (select k.*, w.links, w.names, not list_contains(w.links, k.lk)
        and (k.nk is null or not list_contains(w.names, k.nk)) free
      from walk w join keyed k on k.rn = w.rn + 1) k),
  kept as (select id from walk where ok)"""


def _category(name: str, tvg: str, grp: str) -> str:
    def first(text: str) -> str:
        cases = " ".join(
            "when " + " or ".join(f"contains({text}, {_q(k.lower())})" for k in words) + f" then {_q(c)}"
            for c, words in fixed.CATEGORY_KEYWORDS.items()
        )
        return f"(case {cases} end)"

    text = f"lower({name} || ' ' || coalesce({tvg}, '') || ' ' || {grp})"
    return f"coalesce({first(f'lower({grp})')}, {first(text)}, 'Unknown')"


def _filled_group(category: str, grp: str) -> str:
    return (
        f"case when {category} <> 'Unknown' and ({grp} = '' or lower({grp}) = 'uncategorized')"
        f" then {category} else {grp} end"
    )


def _mark(name: str, tvg: str, grp: str) -> str:
    """The language mark of a channel."""
    shown = f"coalesce({tvg}, {name})"
    short = _list([m for m, *_ in fixed.LANGUAGES if len(m) == 2])
    prefix = f"upper(regexp_extract({shown}, '^([A-Za-z]{{2}})[\\s:|-]+', 1))"
    bracket = f"upper(substr(regexp_extract({shown}, '\\[[A-Za-z]{{2}}\\]|\\([A-Za-z]{{2}}\\)'), 2, 2))"
    words = " ".join(
        f"when contains(upper({grp}), {_q(m)}) or contains(upper({shown}), {_q(m)}) then {_q(m)}"
        for m, *_ in fixed.LANGUAGES
        if len(m) > 2
    )
    return (
        f"case when {prefix} in {short} then {prefix} when {bracket} in {short} then {bracket} else"
        f" (case {words} end) end"
    )


_LANGUAGE_ROWS = (
    "languages(mark, language_code, language_name, language_country) as (values "
    + ", ".join(
        "(" + ", ".join(_q(v) if v is not None else "cast(null as varchar)" for v in row) + ")"
        for row in fixed.LANGUAGES
    )
    + ")"
)
_LANGUAGE_COLUMNS = "language_code, language_name, language_country"


def _classified(source: str) -> str:
    """CTEs up to ``classified``: responses with verdict and stream columns."""

    def codec(kind: list[tuple[str, str]]) -> str:
        cases = " ".join(f"when starts_with(c, {_q(p)}) then {_q(v)}" for p, v in kind)
        parts = "list_transform(string_split(codecs, ','), lambda x: lower(trim(x)))"
        return f"list_filter(list_transform({parts}, lambda c: case {cases} end), lambda c: c is not null)[-1]"

    starts = " or ".join(f"starts_with(lower(t), {_q(s.lower())})" for s in fixed.ERROR_PAGE_STARTS)
    texts = " or ".join(f"contains(lower(t), {_q(s)})" for s in fixed.ERROR_PAGE_TEXTS)
    return f"""
  raw as (select *, regexp_replace(decode(unhex(coalesce(ascii_hex, ''))), '^[ \\t-\\r]+', '') t from (
    select *, list_aggregate(list_transform(range(0, least(2000, length(body_hex) // 2)),
        lambda i: case when substr(body_hex, 2 * i + 1, 1) >= '8' then '3F' else substr(body_hex, 2 * i + 1, 2) end), 'string_agg', '') ascii_hex
    from {source})),
  sniffed as (select *, ({starts} or {texts} or (starts_with(lower(t), '<?xml') and contains(lower(t), '<html'))) error_page,
      starts_with(upper(t), '#EXTM3U') manifest,
      nullif(regexp_extract(t, '(?i)RESOLUTION=(\\d+)x(\\d+)', 1), '') w, nullif(regexp_extract(t, '(?i)RESOLUTION=(\\d+)x(\\d+)', 2), '') h,
      nullif(regexp_extract(t, '(?i)BANDWIDTH=(\\d+)', 1), '') bw, regexp_extract(t, '(?i)CODECS="([^"]+)"', 1) codecs
    from raw),
  judged as (select *, coalesce(status between 200 and 299 and length(body_hex) > 0 and not error_page
      and regexp_matches(link, '(?i)^https?://')
      and not (manifest and ((w is not null and try_cast(w as int) is null) or (h is not null and try_cast(h as int) is null)
        or (bw is not null and try_cast(bw as int) is null))), false) is_alive
    from sniffed),
  classified as (select link, id, attempt, status, body_hex, error_page, is_alive,
      case when is_alive and manifest then try_cast(w as int) end width, case when is_alive and manifest then try_cast(h as int) end height,
      case when is_alive then coalesce(cast(try_cast(icy_br as int) as bigint) * 1000, case when manifest then try_cast(bw as int) end)::int end bitrate,
      case when is_alive then coalesce(case when manifest then {codec(fixed.VIDEO_CODECS)} end,
        case when length(body_hex) >= 6 and starts_with(body_hex, '47') then 'MPEG-TS' when starts_with(body_hex, '464C56') then 'FLV' end) end video_codec,
      case when is_alive then coalesce(case when manifest then {codec(fixed.AUDIO_CODECS)} end,
        case when length(body_hex) >= 6 and regexp_matches(body_hex, '^FF[EF]') then 'MP3' when starts_with(body_hex, '494433') then 'MP3/AAC' end) end audio_codec
    from judged)"""


_INFO = "width, height, bitrate, video_codec, audio_codec"
# The first live attempt of each link, looking at its first row only.
_LINK_RESPONSES = (
    "link_responses as (select r.* from responses_fx r"
    " join (select link, min(id) id from channels_fx group by link) f on f.link = r.link and f.id = r.id)"
)


def _probes(by: str) -> str:
    return f"""
  probes as (select {by} link, bool_or(is_alive) is_alive, {", ".join(
      f"min_by(struct_pack(v := {c}), attempt) filter (where is_alive).v {c}" for c in _INFO.split(", "))}
    from classified where attempt < 3 group by all)"""


def _hash(hex_body: str, ok: str = "true") -> str:
    return (
        f"case when {ok} and length({hex_body}) >= 512"
        f" then substr(upper(sha256(unhex({hex_body}))), 1, 16) end"
    )


def _sql(name: str, select: str, *ctes: str) -> None:
    """Register a query; the views it names are put in front."""
    text = ", ".join(c.strip() for c in ctes) + " " + select
    needed = [v for v in _WITH if v in text]
    if any(v in needed for v in ("lines_fx", "small_lines_fx", "responses_fx")):
        needed.append("channels_fx")
    if "lines_fx" in needed and "lines_fx" not in text.replace("small_lines_fx", ""):
        needed.remove("lines_fx")
    front = [f"{v} as ({_WITH[v].strip()})" for v in _WITH if v in needed]
    parts = front + [c.strip() for c in ctes]
    recursive = "recursive " if "walk(" in text else ""
    ORACLE[name] = (f"with {recursive}" + ",\n".join(parts) + "\n" if parts else "") + select.strip()


# --- scalar functions -------------------------------------------------------

_LINKS = (
    "links as (select 'channel' src, id, link from channels_fx"
    " union all select 'page', page_id, url from pages)"
)
_sql("normalize_url", f"select src, id, {_norm_url('link')} normalized from links", _LINKS)
_sql(
    "tracking_param",
    f"""select id, param, regexp_matches(lower(param), '^(utm_|session|(sid|token|t|ts|timestamp|_|random|r|cache|nocache)=)') tracking
    from (select id, unnest(string_split(regexp_extract(link, '[^?]*$'), '&')) param from channels_fx where contains(link, '?'))""",
)
_sql("valid_stream_url", f"select src, id, {_valid(_trim('link'))} valid from links", _LINKS)
_sql("probeable_url", "select id, regexp_matches(lower(link), '^https?://') probeable from channels_fx")
_sql("normalize_name", f"select id, {_norm_name('name')} normalized from channels_fx")
_sql("normalize_document_text", f"select id, md5({_norm_name('name')}) digest from documents_fx")
_sql(
    "generic_name",
    f"""select p_partkey, word, word in {_list(fixed.GENERIC_NAMES)} generic from (
      select p_partkey, unnest(string_split(lower(p_name), ' ')) word from part
      union all select id, lower(group_name) from channels_fx)""",
)
_sql(
    "name_eligible",
    f"select id, {_eligible('name')} eligible, {_eligible('group_name')} eligible_group from channels_fx",
)
_sql("display_name", "select id, case when tvg_name is null then name else tvg_name end shown from channels_fx")
_sql(
    "effective_group",
    "select id, case when trim(group_name) = '' then 'Uncategorized' else group_name end effective from channels_fx",
)
_sql(
    "safe_group_name",
    "select id, translate(group_name, ' /', '__') safe_group, translate(link, ' /', '__') safe_link from channels_fx",
)

# --- parsing ----------------------------------------------------------------

_ENTRY = "file, line_no, name, link, group_name, tvg_id, tvg_name, tvg_logo, epg_url, extra_attributes"
_sql("parse_channels", f"select id, {_ENTRY} from numbered", _parse("lines_fx"))
_sql("parse_small_playlists", f"select {_ENTRY} from parsed", _parse("small_lines_fx"))
_sql(
    "read_written_playlists",
    f"select form, regexp_replace(file, '\\.m3u$', '') playlist, {_ENTRY.removeprefix('file, ')} "
    "from parsed cross join (values ('whole'), ('lines'), ('gzip'), ('utf16'), ('utf32')) f(form)",
    _parse("small_lines_fx"),
)
_sql(
    "read_fetched_playlists",
    """select 'https://lists.example/' || s_suppkey || '.m3u' file, 'Supplier ' || s_suppkey "name",
    'http://s.example/' || s_suppkey link, s_suppkey::varchar tvg_id from supplier""",
)
_ENTRIES = f"e as (select file, line_no, {_trim('line')} t from lines_fx where upper(substr({_trim('line')}, 1, 7)) = '#EXTINF')"
_sql("parse_extra_attributes", f"select file, line_no, {_extras('t')} extra_attributes from e", _ENTRIES)
_sql(
    "named_attributes",
    f"""select file, line_no, {_attribute('t', 'tvg-id')} tvg_id, {_attribute('t', 'tvg-name')} tvg_name,
    {_attribute('t', 'tvg-logo')} tvg_logo, {_attribute('t', 'group-title')} group_title, {_name('t')} "name" from e""",
    _ENTRIES,
)
_sql(
    "header_epg",
    f"""select file, case when starts_with(upper(line), '#EXTM3U') then coalesce({_attribute('line', 'x-tvg-url')},
    {_attribute('line', 'url-tvg')}) end epg_url from lines_fx where line_no = 0""",
)
_sql("group_override", "select file, group_name, count(*) channels from parsed group by all", _parse("lines_fx"))

# --- distinct ---------------------------------------------------------------


def _merged(rows: str, columns: str) -> str:
    return f"""select row_number() over (order by id) - 1 id, {columns} from (select *, row_number() over (
      partition by {_norm_url('link')} order by id) rn from {rows}) where rn = 1"""


_sql("merge_playlists", _merged("channels_fx", "name, link, group_name"))
_sql("merge_parsed_playlists", _merged("numbered", "name, link, epg_url"), _parse("lines_fx"))
_sql("merge_sources", _merged("numbered", "name, link, epg_url"), _parse("small_lines_fx"))
_sql(
    "remove_duplicates", "select c.id, name, link from channels_fx c join kept using (id)", _greedy("channels_fx")
)
_sql(
    "remove_duplicate_documents",
    # Every link is different here, so only names decide.
    f"""select id, link from (select *, {_eligible('name')} nk, row_number() over (
      partition by {_eligible('name')} order by id) rn from documents_fx) where nk is null or rn = 1""",
)
_sql(
    "remove_duplicates_counts",
    """select (select count(*) from channels_fx) total, (select count(*) from kept) kept,
    (select count(*) from channels_fx) - (select count(*) from kept) removed""",
    _greedy("channels_fx"),
)
_EFFECTIVE = "case when trim(group_name) = '' then 'Uncategorized' else group_name end"
_LABELS = f"""labels_fx as (select upper({_EFFECTIVE}) k, arg_min({_EFFECTIVE}, id) group_label, count(*) "rows"
  from channels_fx group by 1)"""
_sql("distinct_groups", "select group_label from labels_fx", _LABELS)

# --- filters ----------------------------------------------------------------

_NAMES = "select id, name, tvg_name, group_name from channels_fx where "
_sql("filter_group", _NAMES + "contains(lower(group_name), 'econ')")
_sql("filter_name", _NAMES + "contains(lower(name), 'bolt') or coalesce(contains(lower(tvg_name), 'bolt'), false)")
_sql(
    "filter_regex",
    _NAMES + "regexp_matches(name, '(?i)^(us|fr).*bolt') or coalesce(regexp_matches(tvg_name, '(?i)^(us|fr).*bolt'), false)",
)
_sql("filter_bad_regex", _NAMES + "contains(lower(name), '[de')")
_sql(
    "filter_group_and_name",
    _NAMES
    + r"contains(lower(group_name), 'sport') and (regexp_matches(name, '(?i)\d 4k$') or coalesce(regexp_matches(tvg_name, '(?i)\d 4k$'), false))",
)
_sql("filter_documents", "select id, group_name, link from documents_fx where contains(lower(name), 'licensed under')")
_sql(
    "filter_documents_regex",
    r"select id, group_name, link from documents_fx where regexp_matches(name, '(?i)[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}')",
)

# --- enrichment -------------------------------------------------------------


def _categorized(rows: str) -> str:
    return f"select *, {_category('name', 'tvg_name', 'group_name')} category from {rows}"


_GROUP = _filled_group("category", "group_name")
for _name_, _rows_ in (("categorize", "channels_fx"), ("categorize_documents", "documents_fx")):
    _sql(_name_, f"select id, category, {_GROUP} group_name from ({_categorized(_rows_)})")
for _name_, _rows_ in (("detect_language", "channels_fx"), ("detect_language_documents", "documents_fx")):
    _sql(
        _name_,
        f"select id, {_LANGUAGE_COLUMNS} from marked left join languages using (mark)",
        f"marked as (select id, {_mark('name', 'tvg_name', 'group_name')} mark from {_rows_})",
        _LANGUAGE_ROWS,
    )
_sql(
    "rename_literal",
    r"""select id, trim(regexp_replace(coalesce(tvg_name, name), '(?i)bolt', '$1\\', 'g')) "name",
    trim(regexp_replace(tvg_name, '(?i)bolt', '$1\\', 'g')) tvg_name from channels_fx""",
)
_sql(
    "rename_regex",
    r"""select id, trim(regexp_replace(coalesce(tvg_name, name), '(?i)([a-z]+) (\d+)', '\2 \1 <\0> $', 'g')) "name",
    trim(regexp_replace(tvg_name, '(?i)([a-z]+) (\d+)', '\2 \1 <\0> $', 'g')) tvg_name from channels_fx""",
)
_sql("rename_bad_regex", "select id, name, tvg_name from channels_fx")
_sql("rename_empty", "select id, name, tvg_name, replace(name, ' ', '') without_blanks from channels_fx")
_RENAMED = _trim("regexp_replace(name, '(?i)the ', 'THE* ', 'g')")
_sql("rename_documents", f"select id, md5({_RENAMED}) digest from documents_fx")

# --- order and groups -------------------------------------------------------

for _by, _keys in {
    "name": ["coalesce(tvg_name, name)"],
    "group": ["group_name"],
    "group_name": ["group_name", "coalesce(tvg_name, name)"],
}.items():
    for _suffix, _direction in (("", ""), ("_desc", " desc")):
        _order = ", ".join(f"upper({k}){_direction}" for k in _keys)
        _sql(
            f"sort_{_by}{_suffix}",
            f"""select row_number() over (order by {_order}, id) - 1 id, name, tvg_name, group_name, link from channels_fx""",
        )
_sql(
    "split_by_group",
    f"""select row_number() over (order by upper(group_label), id) - 1 id, group_label, name, link
    from channels_fx join labels_fx on k = upper({_EFFECTIVE})""",
    _LABELS,
)
_sql("group_sizes", 'select group_label, "rows" from labels_fx', _LABELS)
_sql("first_epg", "select arg_min(epg_url, id) epg_url from numbered where epg_url <> ''", _parse("lines_fx"))
_sql(
    "stage_counts",
    f"""select count(distinct upper({_EFFECTIVE})) group_count, count(*) filter (where category <> 'Unknown') categorized_count,
    count(mark) languages_count from (select id, category, {_GROUP} group_name, {_mark('name', 'tvg_name', _GROUP)} mark
      from ({_categorized('channels_fx')}))""",
)

# --- responses --------------------------------------------------------------

_sql("acceptable_status", "select id, attempt, status >= 200 and status < 300 acceptable from responses_fx")
_sql("error_page", "select id, attempt, error_page from classified", _classified("responses_fx"))
_PAGE = r"lower(regexp_replace(html, '^[ \t-\r]+', ''))"
_sql(
    "error_page_in_pages",
    # The first 2000 bytes, at most 2000 characters; pages here start with ASCII markup.
    f"""select page_id, starts_with({_PAGE}, '<!doctype') or starts_with({_PAGE}, '<html')
    or starts_with({_PAGE}, '404') or starts_with({_PAGE}, '403') or starts_with({_PAGE}, 'error') error_page from pages""",
)
_sql(
    "header_bitrate",
    """select id, attempt, cast(try_cast(icy_br as int) as bigint)::int * 1000 bitrate,
    ((id * 7919 * 1000 + 2147483648) % 4294967296 - 2147483648)::int wrapped from responses_fx""",
)
_sql(
    "parse_codecs",
    """select id, case when id % 7 = 0 then 'HEVC' else case id % 5 when 0 then 'H.264' when 1 then 'HEVC' when 2 then 'VP9' when 3 then 'AV1' end end video,
    case id % 3 when 0 then 'AAC' when 1 then 'AC3' else 'Opus' end audio from channels_fx""",
)
_sql("classify_responses", f"select id, attempt, is_alive, {_INFO} from classified", _classified("responses_fx"))
_sql(
    "resolution",
    "select id, attempt, cast(width as varchar) || 'x' || cast(height as varchar) resolution from classified",
    _classified("responses_fx"),
)
_sql(
    "probe_retry",
    f"select link, is_alive, {_INFO} from probes",
    _classified("responses_fx"),
    _probes("link || '#' || id"),
)
_LINK_PROBES = (_LINK_RESPONSES, _classified("link_responses"), _probes("link"))
_sql(
    "filter_working",
    f"select c.id, name, c.link, {_INFO} from channels_fx c join probes p on p.link = c.link and p.is_alive",
    *_LINK_PROBES,
)
_sql(
    "success_rate",
    """select count(*) filter (where is_alive) working, count(*) filter (where not is_alive) failed,
    count(*) filter (where is_alive) * 100.0::double / count(*) success_rate from channels_fx c join probes p on p.link = c.link""",
    *_LINK_PROBES,
)
_sql(
    "content_signature",
    f"select id, attempt, {_hash('body_hex', 'status between 200 and 299')} content_hash from responses_fx",
)
_sql("content_signature_documents", f"select id, {_hash('hex(encode(name))')} content_hash from documents_fx")


def _duplicates(rows: str) -> str:
    return f"""select id, content_hash, case when content_hash is not null and rn > 1 then original end duplicate_of from (
      select *, row_number() over w rn, first_value(name) over w original from {rows}
      window w as (partition by content_hash order by id))"""


_HASHED = f"""hashed as (select c.id, c.name, {_hash('r.body_hex', 'r.status between 200 and 299')} content_hash
  from channels_fx c join link_responses r on r.link = c.link and r.attempt = 0)"""
_sql("content_duplicates", _duplicates("hashed"), _LINK_RESPONSES, _HASHED)
_sql(
    "content_duplicate_documents",
    _duplicates("hashed"),
    f"hashed as (select id, 'doc ' || id \"name\", {_hash('hex(encode(name))')} content_hash from documents_fx)",
)

# --- sinks and the whole run ------------------------------------------------

_EXTRA_TEXT = """case when extra_attributes = '' then '' else
  ' ' || regexp_replace(extra_attributes, '([^=;]*)=([^;]*)(;|$)', '\\1="\\2"\\3', 'g') end"""


def _entry_text(language: str) -> str:
    def part(attribute: str, value: str) -> str:
        return f"case when coalesce({value}, '') <> '' then ' {attribute}=\"' || {value} || '\"' else '' end"

    return f"""case when starts_with(upper(name), '#EXTINF') then name else '#EXTINF:-1' || {part('tvg-id', 'tvg_id')}
      || {part('tvg-name', 'tvg_name')} || {part('tvg-logo', 'tvg_logo')} || {part('tvg-language', language)}
      || {part('group-title', 'group_name')} || replace({_EXTRA_TEXT}, ';', ' ') || ',' || coalesce(tvg_name, name) end"""


_GROUP_LINE = """case when group_name <> '' and not contains(lower(name), 'group-title=') then '#EXTGRP:' || group_name end"""
_SPOKEN = (
    _parse("lines_fx"),
    f"marked as (select *, {_mark('name', 'tvg_name', 'group_name')} mark from numbered)",
    _LANGUAGE_ROWS,
)
_sql(
    "format_entry",
    f"select id, {_entry_text('language_name')} entry, {_GROUP_LINE} group_line from marked left join languages using (mark)",
    *_SPOKEN,
)


def _lines_of(rows: str, key: str = "") -> str:
    prefix = f"{key}, " if key else ""
    return f"""select {prefix}id, (i - 1)::int part, ls[i] line from (select {prefix}id,
      list_filter([{_entry_text("''")}, {_GROUP_LINE}, link], lambda x: x is not null) ls from {rows}), unnest(range(1, len(ls) + 1)) r(i)"""


_HEADER = "case when {0} is null then '#EXTM3U' else '#EXTM3U x-tvg-url=\"' || {0} || '\"' end"
_EPG = "(arg_min(epg_url, id) filter (where epg_url <> ''))"
_sql(
    "write_playlist_lines",
    f"select -1::bigint id, 0::int part, {_HEADER.format(_EPG)} line from numbered union all {_lines_of('numbered')}",
    _parse("lines_fx"),
)
_SPLIT = f"""split as (select 'out_' || translate(group_label, ' /', '__') playlist,
    row_number() over (order by upper(group_label), id) - 1 id, name, tvg_name, group_name, link,
    cast(null as varchar) tvg_id, cast(null as varchar) tvg_logo, '' extra_attributes
  from channels_fx join labels_fx on k = upper({_EFFECTIVE}))"""
_sql(
    "write_group_lines",
    f"select distinct playlist, -1::bigint id, 0::int part, '#EXTM3U' line from split union all {_lines_of('split', 'playlist')}",
    _LABELS,
    _SPLIT,
)

_sql(
    "write_group_playlists",
    f"""select playlist || '.m3u' playlist, line from (
    select distinct playlist, '#EXTM3U' line from split union all
    select playlist, line from ({_lines_of('split', 'playlist')}))""",
    _LABELS,
    _SPLIT,
)
_sql(
    "categorize_keywords",
    """select id, name, coalesce(by_group, by_text, 'Unknown') category from (
    select c.id, c.name,
      (select arg_min(category, rank) from keywords where contains(upper(coalesce(c.group_name, '')), keyword)) by_group,
      (select arg_min(category, rank) from keywords where contains(upper(concat_ws(' ', coalesce(c.name, ''), coalesce(c.tvg_name, ''), coalesce(c.group_name, ''))), keyword)) by_text
    from channels_fx c)""",
    "keywords as (select p_brand category, p_partkey rank, upper(p_name || ' ' || p_size) keyword from part)",
)
_sql(
    "write_group_files",
    f"""select playlist || '.m3u' file_name, strlen(content)::bigint length, md5(content) md5 from (
    select playlist, string_agg(line || chr(10), '' order by id, part) content from (
    select distinct playlist, -1::bigint id, 0::int part, '#EXTM3U' line from split union all {_lines_of('split', 'playlist')})
    group by playlist)""",
    _LABELS,
    _SPLIT,
)
_sql("write_table", "select id, name, link, group_name, tvg_name, 'Unknown' category from channels_fx")
_sql(
    "probe_links",
    """select link, length(link) % 3 <> 0 is_alive, case when length(link) % 3 = 1 then 128000 end::int bitrate
    from (select distinct link from channels_fx) where regexp_matches(lower(link), '^https?://')""",
)

_RENAME = "trim(regexp_replace({0}, '(?i)bolt', 'Bolt TV', 'g'))"
_sql(
    "clean_unvalidated",
    f"""select row_number() over (order by upper(group_name), upper(coalesce(tvg_name, name)), id) - 1 id, name, link, tvg_name,
      group_name, category, {_LANGUAGE_COLUMNS}
    from (select id, name, link, tvg_name, {_GROUP} group_name, category, {_mark('name', 'tvg_name', _GROUP)} mark
      from ({_categorized('renamed')})) left join languages using (mark)""",
    _parse("lines_fx"),
    f"merged as ({_merged('numbered', 'name, link, group_name, tvg_name')})",
    _greedy("merged"),
    f"""renamed as (select id, {_RENAME.format('coalesce(tvg_name, name)')} "name", link, group_name, {_RENAME.format('tvg_name')} tvg_name
      from merged join kept using (id) where contains(lower(name), 'l') or coalesce(contains(lower(tvg_name), 'l'), false))""",
    _LANGUAGE_ROWS,
)
_sql(
    "stream_playlists",
    f"""select id, name, link, tvg_name, group_name, category, {_LANGUAGE_COLUMNS}
    from (select id, name, link, tvg_name, {_GROUP} group_name, category, {_mark('name', 'tvg_name', _GROUP)} mark
      from ({_categorized('renamed')})) left join languages using (mark)""",
    _parse("small_lines_fx"),
    f"merged as ({_merged('numbered', 'name, link, group_name, tvg_name')})",
    _greedy("merged"),
    f"""renamed as (select id, {_RENAME.format('coalesce(tvg_name, name)')} "name", link, group_name, {_RENAME.format('tvg_name')} tvg_name
      from merged join kept using (id) where contains(lower(name), 'l') or coalesce(contains(lower(tvg_name), 'l'), false))""",
    _LANGUAGE_ROWS,
)
_STAGE = f"""enriched as (select id, name, link, tvg_name, {_GROUP} group_name, category, {_mark('name', 'tvg_name', _GROUP)} mark
  from ({_categorized('(select c.* from channels_fx c join kept using (id))')}))"""
_sql(
    "clean_validated",
    f"""select o.id, o.name, o.link, group_name, category, {_LANGUAGE_COLUMNS}, {_INFO}, content_hash,
      case when duplicate_of is null then '' else 'duplicate-of=' || duplicate_of end extra_attributes
    from (select row_number() over (order by upper(coalesce(tvg_name, name)) desc, id) - 1 id, id old, * exclude (id) from enriched) o
    join probes p on p.link = o.link and p.is_alive left join languages using (mark)
    join ({_duplicates('hashed')}) d on d.id = o.old""",
    _greedy("channels_fx"),
    _STAGE,
    *_LINK_PROBES,
    _LANGUAGE_ROWS,
    _HASHED.replace("from channels_fx c", "from enriched c"),
)
_sql(
    "clean_defaults",
    f"""select e.id, e.name, e.link, group_name, category, {_LANGUAGE_COLUMNS}, {_INFO}
    from enriched e join probes p on p.link = e.link and p.is_alive left join languages using (mark)""",
    _greedy("channels_fx"),
    _STAGE,
    *_LINK_PROBES,
    _LANGUAGE_ROWS,
)
_sql(
    "processing_report",
    f"""select (select count(*) from chosen c join probes p on p.link = c.link and p.is_alive) working_count,
    (select count(*) from chosen) total_count,
    (select count(*) from channels_fx) - (select count(*) from kept) doubles_removed_count,
    (select count(*) from channels_fx) original_count,
    (select count(distinct upper({_EFFECTIVE})) from chosen c join probes p on p.link = c.link and p.is_alive) group_count,
    (select count(*) from chosen where category <> 'Unknown') categorized_count,
    (select count(mark) from chosen) languages_count""",
    _greedy("channels_fx"),
    _STAGE,
    """chosen as (select * from enriched where contains(lower(name), 'o') or coalesce(contains(lower(tvg_name), 'o'), false))""",
    *_LINK_PROBES,
)
