"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from hazmill.llm import chat, collocations, lexical, quality, secrets

_RULE = r"""
  select doc_id, {k} as k, '{kind}' as kind, unnest(regexp_extract_all(t, {re}, 0)) as m,
         unnest(regexp_extract_all(t, {re}, {group})) as v, unnest(regexp_split_to_array(t, {re})[:-2]) as gap,
         generate_subscripts(regexp_extract_all(t, {re}, 0), 1) as n, {least} as least
  from docs where regexp_matches(t, {re})"""


def _secrets_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [_RULE.format(k=k, kind=r.kind, re=quoted(r.regex), group=r.group, least=r.least) for k, r in enumerate(secrets.RULES)]
    return f"""
with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
raw as ({' union all '.join(p.replace('select doc_id', 'select r') for p in parts)}),
placed as (
  select *, sum(length(gap) + length(m)) over (partition by r, k order by n) as stop from raw),
spans as (
  select r, k, kind, stop - length(m) as start, concat(kind, ':', (stop - length(m))::bigint, ':', stop::bigint) as s from placed where length(v) >= least),
digest as (
  select r, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
         string_agg(s, ',' order by start, k) filter (k < {len(secrets.BASE_KINDS)}) as base, string_agg(s, ',' order by start, k) as spans
  from spans group by r)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join digest using (r)"""


_LEDGER = r"""
with docs as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
toks as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs),
flat as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from toks),
wins as (select r, i, x, lead(x, 1) over d as y, lead(x, 2) over d as z from flat window d as (partition by r order by i)),
rep as (select r, i from (select r, i, count(*) over (partition by r, x, y, z) as n from wins where z is not null) where n > 1),
cover as (select r, count(distinct i + k)::bigint as n_repeat_words from rep, (values (0), (1), (2)) as o(k) group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from docs),
dup as (select r, count(*)::bigint as n_lines, (count(*) - count(distinct l))::bigint as n_dup_lines,
         count(*) filter (regexp_matches(l, '^[\x20\x09-\x0D]*(- |\* |\x{2022})')) as n_bullet, count(*) filter (regexp_matches(l, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) as n_cut from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
word as (select r, sum(length(x))::bigint as word_chars,
         count(*) filter (length(x) > 1 and regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '[\p{Ll}\p{Lt}]')) as n_upper,
         count(*) filter (x like '%!!') as n_loud from flat group by r),
m as (select doc_id, len(w)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(n_upper, 0) as n_upper, coalesce(n_loud, 0) as n_loud,
         coalesce(n_bullet, 0) as n_bullet, coalesce(n_cut, 0) as n_cut
      from toks left join dup using (r) left join word using (r) left join cover using (r)),
bits as (select *,
  (case when n_words < 50 then 1 else 0 end
   + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
   + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
   + case when n_dup_lines >= 2 and 10 * n_dup_lines > 4 * n_lines then 8 else 0 end
   + case when 10 * n_upper > 4 * n_words then 16 else 0 end
   + case when 10 * n_loud > 3 * n_words then 32 else 0 end
   + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words) then 64 else 0 end
   + case when n_lines > 0 and 10 * n_bullet > 9 * n_lines then 128 else 0 end
   + case when 10 * n_cut > 3 * n_lines then 256 else 0 end)::bigint as failure_bits from m)"""

_QUALITY = (
    _LEDGER
    + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 as base_failed,
       failure_bits = 0 as kept, failure_bits, '2026-lines' as policy from bits"""
)


def _ablations_sql() -> str:
    """Documents kept without each rule in turn, counted from the documents rather than from sums over masks."""
    cases = [(p, name, m, quality.BIT[name]) for p, m in quality.POLICIES.items() for name, _ in quality.RULES if m & quality.BIT[name]]
    grid = ", ".join(f"('{p}', '{r}', {m}, {b})" for p, r, m, b in cases)
    return f"""{_LEDGER}, grid(policy, rule, mask, bit) as (values {grid})
select policy, rule, count(*)::bigint as n_docs, count(*) filter (failure_bits & mask = 0)::bigint as n_kept,
       (count(*) filter (failure_bits & mask & ~bit = 0) - count(*) filter (failure_bits & mask = 0))::bigint as n_only_this_rule,
       count(*) filter (failure_bits & bit <> 0)::bigint as n_failing
from bits, grid group by policy, rule"""


#: Every 100-byte string by its MD5; runs of covered bytes are merged where they touch.
_REPEATS = """
with docs as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, b, unnest(range(n - 99)) as i from docs where n >= 100),
grams as (select doc_id, i, md5_number(b[i + 1:i + 100]) as gram from starts),
firsts as (select gram, min({'d': doc_id, 'i': i}) as f from grams group by gram having count(*) > 1),
again as (select doc_id, i from grams join firsts using (gram) where doc_id > f.d or (doc_id = f.d and i > f.i)),
marked as (select doc_id, i, i > lag(i, 1, -1000) over w + 100 as opens from again window w as (partition by doc_id order by i)),
numbered as (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as run from marked),
runs as (select doc_id, min(i) as s, max(i) + 100 as e from numbered group by doc_id, run),
gaps as (select doc_id, s, e - s as removed, lag(e, 1, 0) over (partition by doc_id order by s) as after, s as until from runs
  union all select doc_id, n, null, coalesce((select max(e) from runs where runs.doc_id = docs.doc_id), 0), n from docs),
kept as (select doc_id, sum(removed) as n_removed, count(removed) as n_spans, string_agg(hex(b[after + 1:until]), '' order by s, removed nulls last) as h from gaps join docs using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(coalesce(h, ''))) as kept_sha256 from docs join kept using (doc_id)"""


#: All pairs in double precision; what the Hamming tables find must be all of them on these tables.
_NEAR_VECTORS = """
with recursive given as (select vec_id, embedding::double[] as e from embeddings),
sound as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from given where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, o.vec_id as o from sound a join sound o on a.vec_id <> o.vec_id where len(a.e) = len(o.e) and list_dot_product(a.e, o.e) >= 0.95 * a.norm * o.norm),
reached as (select vec_id, vec_id as o from given union select r.vec_id, links.o from reached r join links on links.a = r.o),
component as (select vec_id, min(o) as component_id from reached group by vec_id),
linked as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from component left join linked using (vec_id)"""


_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every phrase at every place.
_COLLOCATIONS = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER.format(text="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sizes(size) as (values (1), (2), (3), (4)),
f as (select lang, phrase, size, count(*) as f from (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from words, sizes where len(w) >= size) group by all),
total as (select lang, sum(f)::bigint as n from f where size = 1 group by 1),
cand as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= {collocations.LEAST}),
cuts as (select lang, phrase, a, w, unnest(range(1, size)) as k from cand),
scored as (select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (2000000 * c.a::hugeint) // (l.f + r.f) as score from cuts c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, phrase, max(a) as outer_a from (select lang, a, unnest(flatten(list_transform(range(2, size), lambda s: list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) as phrase from cand) group by 1, 2),
kept as (select lowest.* from lowest left join inside using (lang, phrase) where outer_a is null or 100 * outer_a < {collocations.COVERED} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= {collocations.BEST}"""


def _chat_sql() -> str:
    from hazmill.llm.queries import HOSTILE

    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for mark in chat.CONTROL:
            out = f"replace({out}, '{mark}', '{chat.broken(mark)}')"
        return out

    marks = len(chat.START + chat.BODY + chat.END)
    return f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}'))
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls last, text, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{chat.LEARNED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, text, role) filter (role = '{chat.LEARNED}'), '')) as loss_sha256,
  sum({marks} + length({escaped("role")}) + length({escaped("text")}))::bigint as formatted_chars
from rows group by conv_id"""


#: Every item against every document that shares a term.
_RANKED = rf"""
with docs as (select doc_id, row_number() over () as d, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
items as (select item_id, row_number() over () as i, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
size as (select count(*)::bigint as nn, sum(len(t))::bigint as ll from docs where len(t) > 0),
post as (select d, term, count(*) as tf from (select d, unnest(t) as term from docs) group by 1, 2),
weight as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, size group by term, nn),
asked as (select i, term, count(*) as qtf from (select i, unnest(t) as term from items) group by 1, 2),
m as (select d, doc_id, {100 - lexical.B} + ({lexical.B} * len(t)::bigint * nn) // ll as m from docs, size where len(t) > 0),
scored as (select i, d, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join weight using (term) join post using (term) join m using (d) group by 1, 2),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id) as rank from scored join m using (d) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join items using (i) where rank <= {lexical.K}"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _secrets_sql(),
    "op3_quality_ledger": _QUALITY,
    "op8_itq_embeddings": _NEAR_VECTORS,
    "op10_suffix_dedup": _REPEATS,
    "op11_prefix_free_collocations": _COLLOCATIONS,
    "op12_chat_assembly": _chat_sql(),
    "op13_term_pipeline": _RANKED,
    "quality_ablations": _ablations_sql(),
}
