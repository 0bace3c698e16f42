"""DuckDB texts of the longer SQL twins."""

from __future__ import annotations


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _repair() -> str:
    """The edit lattice from its end: for each state the least (cost, audit, repaired rows) of what is left to do."""
    u, a = "'user'", "'assistant'"
    far = "{'c': 1000000000000, 'a': '', 'r': []}"

    def step(cost: str, letter: str, state: int, row: str | None) -> str:
        rest = f"t{state}.r" if row is None else f"list_prepend({row}, t{state}.r)"
        return f"{{'c': t{state}.c + {cost}, 'a': '{letter}' || t{state}.a, 'r': {rest}}}"

    follows = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    used, opened = [], []
    for s, after in follows.items():
        edits = [step("3", "D", s, None)]
        for t in after:
            letter = "sua"[t - 1]
            edits.append(f"case when fine and initial = '{letter}' then {step('late', 'K', t, 'line')} else {far} end")
            if t > 1:
                edits.append(f"case when fine then {step('2 + late', 'R', t, f'{u if t == 2 else a} || chr(58) || text')} else {far} end")
        used.append(f"{_least(*edits)} as t{s}")
        t = after[-1]
        opened.append(f"{_least(f't{s}', step('2', 'I', t, f'{u if t == 2 else a} || chr(58)'))} as t{s}")
    used, opened = ", ".join(used), ", ".join(opened)
    return rf"""
with recursive key as (select *, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes,
  row_number() over () as id from conversations),
hashed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 20 as kind from key),
hurt as (select id, conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
  case kind when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
  unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy from hashed),
rows as (select *, role || ':' || text as line, substr(role, 1, 1) as initial, row_number() over w as i, lag(substr(role, 1, 1)) over w as before,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last,
  row_number() over (partition by conv_id, role, text order by turn nulls first, id, copy) > 1 as again from hurt
  window w as (partition by conv_id order by turn nulls first, role, sha256(text), id, copy)),
told as (select *, case when last = '' then 'blank' when again then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault from rows),
judged as (select *, coalesce(fault, '') not in ('blank', 'duplicate') as fine, coalesce(fault = 'truncated', false)::int as late from told),
stats as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id),
walk as (select conv_id, n + 1 as i, {{'c': 0::bigint, 'a': '', 'r': []::varchar[]}} as t0,
    {{'c': 4::bigint, 'a': 'II', 'r': ['user:', 'assistant:']}} as t1, {{'c': 2::bigint, 'a': 'I', 'r': ['assistant:']}} as t2,
    {{'c': 0::bigint, 'a': '', 'r': []::varchar[]}} as t3 from stats
  union all select conv_id, i, {opened} from (select conv_id, i, {opened} from (select w.conv_id, j.i, {used} from walk w
    join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i - 1)))
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(t0.c, 0)::bigint as cost, coalesce(t0.a, '') as audit,
  sha256(coalesce(array_to_string(t0.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on s.conv_id is not distinct from c.conv_id
left join (select * from walk where i = 1) w on w.conv_id is not distinct from c.conv_id"""


OP12 = _repair()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"^\p{L}[\p{L}\p{M}''-]{2,}$"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(v, '.'), lambda x: not regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})'))) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", """length(digits) between 13 and 19 and list_sum(list_transform(range(length(digits)),
    lambda i: case when i % 2 = 0 then (reverse(digits)[i + 1])::int else (reverse(digits)[i + 1])::int * 2 - case when (reverse(digits)[i + 1])::int > 4 then 9 else 0 end end)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 9 and 15"),
}


def _words(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_WORD}'), lambda w: translate(regexp_replace(w, '{_EDGES}', '', 'g'), '{_UPPER}', '{_LOWER}'))"


def _pii() -> str:
    """Values by pattern, then the words that reveal one of them, as in pii.py."""
    found = " union all ".join(
        f"select r, {i} as k, '{kind}' as kind, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gs from doc"
        for i, (kind, (pattern, _)) in enumerate(_KINDS.items())
    )
    good = " or ".join(f"kind = '{kind}' and {check}" for kind, (_, check) in _KINDS.items())
    return rf"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({found}),
each as (select r, k, kind, i, ms[i] as v, gs[i] as l, gs[i + 1] as t, regexp_replace(ms[i], '[^0-9]', '', 'g') as digits
  from (select *, unnest(range(1, len(ms) + 1)) as i from found)),
placed as (select *, (sum(length(l) + length(v)) over (partition by r, k order by i) - length(v))::bigint as a from each),
held as (select *, a + length(v) as b from placed where {good}),
copies as (select text, min(r) as r, count(*) as rows from doc group by text),
near as (select c.rows, kind, case when kind in ('card', 'phone') then digits else translate(v, '{_UPPER}', '{_LOWER}') end as value,
  case when length(l) > 200 then regexp_replace(right(l, 200), '^{_WORD}', '') else l end as l,
  case when length(t) > 200 then regexp_replace(left(t, 200), '{_WORD}$', '') else t end as t from held join copies c using (r)),
w as (select rows, kind, value, list_concat(['^'], {_words('l')}, ['@'], {_words('t')}, ['$']) as w from near),
seen as (select kind, value, w[i] as term, w[i - 1] as before, w[i + 1] as after, sum(rows) as rows, count(*) as texts
  from (select *, unnest(range(2, len(w))) as i from w) where regexp_matches(w[i], '{_TERM}') group by all),
pairs as (select kind, value, term, sum(rows) as beside, sum(texts) as texts, max(texts) as most from seen group by all),
counts as (select term, count(*) as n from (select unnest({_words('text')}) as term from doc) where regexp_matches(term, '{_TERM}') group by term),
around as (select kind, value, sum(beside) as around from pairs group by all),
told as (select term, greatest(log2(n / beside), 0) as bits, log2((select sum(n) from counts) / around) as all_bits
  from pairs join counts using (term) join around using (kind, value) where texts >= 3 and most * 3 <= texts),
term as (select term, min(bits) as bits from told where bits <= 1 and all_bits - bits >= 4 group by term),
piece as (select r, i, ms[i] as v, sum(length(gs[i]) + length(ms[i])) over (partition by r order by i) - length(ms[i]) as s
  from (select r, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select r, regexp_extract_all(text, '{_WORD}') as ms, string_split_regex(text, '{_WORD}') as gs from doc))),
spot as (select r, bits, (s + length(regexp_extract(v, '^[^\p{{L}}\p{{N}}]*')))::bigint as a, length(term) as size from piece
  join term on term = translate(regexp_replace(v, '{_EDGES}', '', 'g'), '{_UPPER}', '{_LOWER}')),
more as (select r, case when bits <= 0.25 then 5 else 4 end as k, case when bits <= 0.25 then 'remove' else 'generalise' end as kind, a, a + size as b from spot s
  where not exists (select 1 from held h where h.r = s.r and h.a < s.a + s.size and h.b > s.a)),
spans as (select r, k, kind, a, b from held union all select * from more),
told_doc as (select r, count(*) filter (where k = 0) as n_email, count(*) filter (where k = 1) as n_ip, count(*) filter (where k = 2) as n_card,
  count(*) filter (where k = 3) as n_phone, string_agg(kind || ':' || a || ':' || b, ',' order by k, a) filter (where k < 4) as base,
  string_agg(kind || ':' || a || ':' || b, ',' order by k, a) as spans from spans group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from doc left join told_doc using (r)"""


OP11 = _pii()
