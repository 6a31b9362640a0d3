"""SQL checks of the filter audit, the mix and the repaired conversations."""

from __future__ import annotations

from rttscope.llm import filter_audit, mixing

_BITS = {f: 1 << k for k, f in enumerate(filter_audit.FILTERS)}
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

FILTER_AUDIT = f"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
words as (select doc_id, part, t, {_WORDS} as w, min(doc_id) over (partition by t) as least from docs),
masks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 200)::int * 1 + (100 * len(list_distinct(w)) < 50 * len(w))::int * 2 + (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int * 4
    + regexp_matches(t, '[#$%&*|]')::int * 8 + coalesce(least < doc_id, false)::int * 16 as mask
  from words left join marks using (doc_id)),
letters(f, bit) as (values {", ".join(f"('{f}', {b})" for f, b in _BITS.items())}),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (select filter_order, s::int as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as before from orders, range(1, 6) r(s)),
counted as (
  select part, filter_order, step, bit,
    count(*) filter (where mask & before = 0 and mask & bit = 0) as kept,
    count(*) filter (where mask & before = 0 and mask & bit <> 0) as removed,
    count(*) filter (where mask & before <> 0 and mask & bit <> 0) as redundant,
    count(*) filter (where mask = bit) as unique_fails,
    coalesce(sum(good) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from masks, steps group by all)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from counted
"""

_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
MIXING = rf"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) as size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint / {1 << 48}::double as chance
  from documents),
sources as (select source, sum(size)::bigint as source_size from docs group by source),
weighed as (select *, {_WEIGHTS}[(row_number() over (order by source collate "C" nulls last) - 1) % {len(mixing.WEIGHTS)} + 1]::bigint as weight, sum(source_size) over ()::bigint as total from sources),
sorted as (
  select *, row_number() over (order by source_size / weight, source) as k from weighed),
sums as (
  select *, coalesce(sum({mixing.LIMIT} * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::hugeint as before,
    sum(weight) over (order by k rows between current row and unbounded following)::hugeint as units from sorted),
full_ones as (select *, 100 * {mixing.LIMIT} * source_size::hugeint * units <= weight * ({mixing.PERCENT} * total - 100 * before) as at_limit from sums),
rest as (
  select ({mixing.PERCENT} * max(total) - 100 * coalesce(sum({mixing.LIMIT} * source_size) filter (where at_limit), 0))::bigint as over, sum(weight) filter (where not at_limit)::bigint as units from full_ones),
goals as (
  select source, source_size, case when at_limit then ({mixing.LIMIT} * source_size)::double else (weight * over)::double / (100 * rest.units)::double end as target from full_ones, rest),
rates as (select *, case when source_size > 0 then target / source_size::double else 0 end as rate from goals)
select doc_id, size::bigint as size, source_size, target, ((floor(rate) + (chance < rate - floor(rate))::int) * size)::bigint as taken
from docs join rates on docs.source is not distinct from rates.source
"""

_CRC = """list_reduce([4294967295] || list_transform(string_split({key}, ''), lambda x: ascii(x)::bigint),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end))"""
_SPACE = r"\x20\x09-\x0D"
# costs, audits and texts behind a row, from each of the four states
_STATES = ("start", "sys", "usr", "ast")
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_MEND = (2, 2, 3, 2)


def _step(state: int) -> str:
    """The best (cost, audit, made) before any insert at this row, from one state."""
    role = "assistant" if state == 2 else "user"
    options = [f"case when true then {{'c': {_of(state, 'c')} + 4, 'a': 'D' || {_of(state, 'a')}, 'm': {_of(state, 'm')}}} end"]
    to = _MEND[state]
    options.append(f"case when fault not in ('blank', 'duplicate') then {{'c': {_of(to, 'c')} + 3 + cut, 'a': 'R' || {_of(to, 'a')}, 'm': [concat('{role}:', t)] || {_of(to, 'm')}}} end")
    for initial, after in _AFTER.items():
        if after[state] is not None:
            to = after[state]
            options.append(f"case when fault not in ('blank', 'duplicate') and starts_with(role, '{initial}') then {{'c': {_of(to, 'c')} + cut, 'a': 'K' || {_of(to, 'a')}, 'm': [concat(role, ':', t)] || {_of(to, 'm')}}} end")
    return "list_sort(list_filter([" + ", ".join(options) + "], lambda o: o is not null))[1]"


def _of(state: int, field: str) -> str:
    return f"{_STATES[state]}.{field}"


def _insert(at: str, to: str, role: str) -> str:
    return f"{{'c': {to}.c + 3, 'a': 'I' || {to}.a, 'm': ['{role}:'] || {to}.m}}"


def _least(own: str, other: str) -> str:
    return f"list_sort([{own}, {other}])[1]"


_EMPTY = "{'c': 0, 'a': '', 'm': []::varchar[]}"
REPAIR = f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as t, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (select *, xor({_CRC.format(key="key")}, 4294967295) % 20 as fate from keyed),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end as t,
    unnest(case when fate = 0 then [] when fate = 3 then [1, 2] else [1] end) as copy
  from hashed),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(t), copy) as k from damaged),
told as (
  select *, lag(left(role, 1)) over (partition by conv_id order by k) as before,
    case when not regexp_matches(t, '[^{_SPACE}]') then 'blank' when row_number() over (partition by conv_id, role, t order by k) > 1 then 'duplicate'
      when not regexp_matches(t, '[.!?][{_SPACE}]*$') then 'truncated' else '' end as fault
  from placed),
counts as (
  select conv_id, max(k) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where k > 1 and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from told group by conv_id),
walk as (
  select conv_id, n + 1 as k, {_EMPTY} as start, {{'c': 6, 'a': 'II', 'm': ['user:', 'assistant:']}} as sys, {{'c': 3, 'a': 'I', 'm': ['assistant:']}} as usr, {_EMPTY} as ast from counts
  union all
  select conv_id, k, {_least("s0", _insert("s0", "u1", "user"))}, {_least("s1", _insert("s1", "u1", "user"))}, u1, a1
  from (
    select conv_id, k, s0, s1, {_least("u0", _insert("u0", "a0", "assistant"))} as u1, {_least("a0", _insert("a0", "u0", "user"))} as a1
    from (
      select told.conv_id, told.k, {_step(0)} as s0, {_step(1)} as s1, {_step(2)} as u0, {_step(3)} as a0
      from (select *, case when fault = 'truncated' then 3 else 0 end as cut from told) told join walk on told.conv_id is not distinct from walk.conv_id and told.k = walk.k - 1)))
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(start.c, 0)::bigint as cost, coalesce(start.a, '') as audit, sha256(coalesce(array_to_string(start.m, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts on c.conv_id is not distinct from counts.conv_id
left join (select * from walk where k = 1) w on c.conv_id is not distinct from w.conv_id
"""

ORACLE = {"op11_filter_audit": FILTER_AUDIT, "op12_mixing": MIXING, "op13_repair": REPAIR}
