"""The same definitions for DuckDB: common table expressions that the queries' SQL is put together from."""

from __future__ import annotations

import numpy as np

from merganser.functions.expressions import channel_set, key
from merganser.operators import ranking, tags
from merganser.operators.stats import FIELDS

DUCK = {"segments": "list_filter(string_split(translate({0}, chr(92), '/'), '/'), lambda s: s <> '')", "both": "len(list_intersect({0}, {1}))", "either": "len(list_distinct(list_concat({0}, {1})))", "some": "len({0})", "without": "regexp_replace({0}, '{1}', '', 'g')", "entropy": "coalesce(list_sum(list_transform(list_distinct(string_split({0}, '')), lambda x: -(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})::double) * log2(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})::double))), 0)"}

EVENTS = """select event_id as seq, 'http://'||host||'/'||word as url, host, word, status, length, words, lines, content_type, redirect_location, duration_ms from (
  select event_id, 'h'||cast(user_id as varchar)||'.example.com' as host, 'k'||cast(k as varchar) as word,
    case event_type when 'error' then 500 when 'signup' then 301 when 'purchase' then 403 when 'click' then 404 else 200 end as status,
    cast(floor(value*100) as bigint) as length, cast(floor(value*100/11) as bigint)+1 as words, cast(floor(value*100/70) as bigint)+1 as lines,
    case k%4 when 0 then 'application/json' when 1 then 'text/plain' when 2 then '' else 'text/html' end as content_type,
    case event_type when 'signup' then '/login' else '' end as redirect_location, value as duration_ms
  from (select *, cast(json_extract_string(props,'$.k') as bigint) as k from events) a) b"""

PAGES = """select page_id as seq, url, regexp_extract(url,'^[a-zA-Z]+://([^/?#]*)',1) as host, regexp_extract(url,'([^/?#]*)/?([?#].*)?$',1) as word,
  case when page_id%20<11 then 404 when page_id%20<16 then 301 when page_id%20<18 then 403 else 200 end as status, cast(strlen(html) as bigint) as length,
  cast(length(html)-length(replace(html,' ',''))+1 as bigint) as words, cast(length(html)-length(replace(html,chr(10),''))+1 as bigint) as lines,
  case when page_id%20 in (16,17) then 'application/json' else 'text/html; charset=utf-8' end as content_type,
  case when page_id%20>=11 and page_id%20<16 then '/en/login' else '' end as redirect_location, cast((page_id*37)%101+1 as double) as duration_ms from pages"""


def sums(over: str = "") -> str:
    out = [f"count(*){over} as n"]
    for c in FIELDS:
        out += [f"sum({c}){over} as s_{c}", f"sum({c}*{c}){over} as q_{c}", f"min({c}){over} as lo_{c}", f"max({c}){over} as hi_{c}"]
    return ", ".join(out)


def known(view: str, how: str, first: bool, p: str = "a") -> str:
    """CTEs that end in {p}_known: records with statistics before them, or final ones."""
    base = f"{p}_r as ({view}), {p}_u as (select *, cast(round(duration_ms*1000) as bigint) as duration, {key(how)} as key from {p}_r), "
    if first:
        return base + f"{p}_known as (select *, {sums(' over w')} from {p}_u window w as (partition by key order by seq rows between unbounded preceding and 1 preceding))"
    return base + f"{p}_known as (select * from {p}_u join (select key, {sums()} from {p}_u group by key) using (key))"


def vector(version: str = "v3-response") -> str:
    return "[" + ", ".join(f"cast(round(({e}) * 1000000) as bigint)" for e in channel_set(version, DUCK).values()) + "]"


def wiring_values(wiring: np.ndarray) -> str:
    cells, channels = np.nonzero(wiring)
    return "(values " + ", ".join(f"({c},{k})" for c, k in zip(cells.tolist(), channels.tolist())) + ") as wiring(cell, channel)"


def tagged(view: str, how: str, first: bool, p: str = "a", cells: int = ranking.SMALL, version: str = "v3-response") -> str:
    """CTEs that end in {p}_tag: (key, seq, cell). Large steps are materialized: inlined, joins may be ordered so that they spill without bound."""
    n = len(channel_set(version))
    k = tags.active(cells, ranking.SPARSITY)
    return known(view, how, first, p) + (
        f", {p}_v as materialized (select key, seq, {vector(version)} as q from {p}_known), {p}_x as (select key, seq, unnest(q) as x, generate_subscripts(q, 1) - 1 as channel, list_sum(q) as s from {p}_v), "
        f"{p}_act as materialized (select key, seq, cell, sum(x * {n} - s) as activation from {p}_x join (select * from {wiring_values(ranking.wiring(cells, version))}) using (channel) group by key, seq, cell), "
        f"{p}_tag as materialized (select key, seq, cell, activation from (select *, row_number() over (partition by key, seq order by activation desc, cell) as place from {p}_act) where place <= {k})"
    )


CLIP = "round(least(greatest({0}, 0.0), 1.0), 6)"
#: What a sum of logarithms, in units of 1e-12, leaves of a weight.
WEIGHT = "exp(least(coalesce({0}, 0), 0)::double / 1e12)"


def valued(p: str) -> str:
    """The CTE {p}_val: (key, seq, cell, v, log) of cells that are driven, log being the logarithm of 1 - 0.4 v / (largest v of the tag) in units of 1e-12."""
    return f", {p}_val as materialized (select key, seq, cell, v, cast(round(ln(1 - 0.4::double * v / max(v) over (partition by key, seq)) * 1e12) as bigint) as log from (select key, seq, cell, activation::double as v from {p}_tag where activation > 0))"


def live(view: str, how: str, p: str = "a", cells: int = ranking.SMALL) -> str:
    """CTEs that end in {p}_live: (key, seq, novelty)."""
    before = "sum(log) over (partition by key, cell order by seq rows between unbounded preceding and 1 preceding)"
    return tagged(view, how, True, p, cells) + valued(p) + f", {p}_w as (select *, {before} as before from {p}_val), {p}_live as (select key, seq, {CLIP.format('sum(v * ' + WEIGHT.format('before') + ') / sum(v)')} as novelty from {p}_w group by key, seq)"


def offline(view: str, how: str, p: str = "o") -> str:
    """CTEs that end in {p}_off: (key, seq, novelty), leaving one out."""
    a, b = f"{p}1", f"{p}2"
    return tagged(view, how, True, a) + valued(a) + ", " + tagged(view, how, False, b) + valued(b) + (
        f", {p}_tot as (select key, cell, sum(log) as every from {a}_val group by key, cell), "
        f"{p}_off as (select key, seq, {CLIP.format('sum(v * ' + WEIGHT.format('every - log') + ') / sum(v)')} as novelty from {b}_val left join {p}_tot using (key, cell) group by key, seq)"
    )
