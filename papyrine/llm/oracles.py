"""DuckDB SQL that must give the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"select doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents"


# Smallest id reachable over undirected links(x, y), from nodes(id).
_REACH = """
, both_ways as (select x, y from links union select y, x from links)
, reach(id, c) as (select id, id from nodes union select b.y, r.c from reach r join both_ways b on b.x = r.id where r.c < b.y)
, component as (select id, min(c) as component_id from reach group by id)"""

NGRAM_JACCARD = f"""
with recursive words as ({_words(_LOWERED)})
, sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words)
, grams as (select doc_id, len(s) as n, unnest(s) as g from sets)
, links as (select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*)))
, nodes as (select doc_id as id from documents){_REACH}
select doc_id, len(s) as n_shingles, component_id from sets join component on id = doc_id"""

_VALID = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0"

NEAR_VECTORS = f"""
with recursive valid as (select vec_id, embedding::double[] as v from embeddings where {_VALID})
, links as (select a.vec_id as x, b.vec_id as y from valid a join valid b on a.vec_id < b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95)
, nodes as (select vec_id as id from embeddings){_REACH}
, degree as (select x as id, count(*) as n from both_ways group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join component c on c.id = vec_id left join degree d on d.id = vec_id"""

REPEATED_BYTES = """
with bytes as (select doc_id, encode(coalesce(text, '')) as b from documents)
, pairs as (select doc_id, regexp_extract_all(hex(b), '..') as b from bytes)
, windows as (select doc_id, i, md5(b[i:i + 199]) as d from (select doc_id, b, unnest(range(1, octet_length(b) - 198)) as i from bytes where octet_length(b) >= 200))
, again as (select doc_id, i from windows where d in (select d from windows group by d having count(*) > 1))
, covered as (select distinct doc_id, unnest(range(i, i + 200)) as k from again)
, kept as (select p.doc_id, p.k, p.x, c.k is not null as gone from (select doc_id, unnest(range(1, len(b) + 1)) as k, unnest(b) as x from pairs) p left join covered c on c.doc_id = p.doc_id and c.k = p.k)
, runs as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as begins from kept)
, counted as (select doc_id, count(*) as n, count(*) filter (gone) as removed, count(*) filter (begins) as spans, string_agg(x, '' order by k) filter (not gone) as rest from runs group by doc_id)
select b.doc_id, coalesce(n, 0) as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256
from bytes b left join counted c on c.doc_id = b.doc_id"""

REPEATED_WINDOWS = f"""
with words as ({_words("coalesce(text, '')")})
, windows as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as d from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35))
, again as (select doc_id, i from windows where d in (select d from windows group by d having count(*) > 1))
, covered as (select distinct doc_id, unnest(range(i, i + 35)) as k from again)
, kept as (select p.doc_id, p.k, p.x, c.k is not null as gone from (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as x from words) p left join covered c on c.doc_id = p.doc_id and c.k = p.k)
, counted as (select doc_id, count(*) as n, count(*) filter (gone) as removed, string_agg(x, ' ' order by k) filter (not gone) as rest from kept group by doc_id)
select w.doc_id, coalesce(n, 0) as n_words, coalesce(removed, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from words w left join counted c on c.doc_id = w.doc_id"""

# The unsigned crc32 of a list of bytes, by its table, which comes from its polynomial.
_CRC = """
, crc_table as (select list(list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as crc from range(256) t(i))"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::bigint])), 4294967295)"
_RUN_BYTES = "flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::ubigint] else [(192 + unicode(c) // 64)::ubigint, (128 + unicode(c) % 64)::ubigint] end))"

SPELLING_VARIANTS = f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\u00C0-\u00FF]+')) as r from documents)
, counted as (select doc_id, r, count(*) as n from runs where length(r) >= 5 group by all){_CRC}
, hashed as (select r, n, {_CRC_OF} as h from (select r, n, {_RUN_BYTES} as bytes from counted), crc_table)
, shortened as (select case when h % 97 = 0 then r[1:(h % length(r))::bigint] || r[(h % length(r))::bigint + 2:] else r end as word, n from hashed)
, words as (select word, sum(n)::bigint as n from shortened where length(word) >= 5 group by word having sum(n) >= 3)
, cut as (select word, i, word[1:i - 1] || word[i + 1:] as d from (select word, unnest(range(1, length(word) + 1)) as i from words))
, pairs as (select a.word as x, b.word as y from cut a join words b on a.d = b.word
            union select b.word, a.word from cut a join words b on a.d = b.word
            union select a.word, b.word from cut a join cut b on a.d = b.d and a.i = b.i and a.word <> b.word)
, best as (select x as word, count(*) as n_near, arg_min(y, (-n, y)) as y, max(n) as m from pairs join words on y = word group by x)
, forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then y end as form, case when m >= 2 * w.n then m end as form_n from words w left join best b on b.word = w.word)
, follow(word, here) as (select word, word from forms union all select f.word, g.form from follow f join forms g on g.word = f.here where g.form is not null)
, roots as (select f.word, f.here as root from follow f join forms g on g.word = f.here where g.form is null)
select forms.word, form, root, n, n_near, form_n from forms join roots on roots.word = forms.word"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


RANKED_SEARCH = f"""
with held as (select row_number() over () as row, doc_id, {_terms("text")} as t from documents)
, docs as (select row, doc_id, t, len(t) as n from held where len(t) > 0)
, total as (select count(*) as docs, sum(n)::hugeint as words from docs)
, counts as (select row, term, count(*) as tf from (select row, unnest(t) as term from docs) group by all)
, weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, total group by term, docs)
, asked as (select item, item_id, term, count(*) as q from (select row_number() over () as item, item_id, unnest({_terms("text")}) as term from benchmark) group by all)
, scores as (select item, item_id, d.row, d.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::bigint as score
             from asked join weights using (term) join counts using (term) join docs d on d.row = counts.row, total group by all)
, ranked as (select item_id, row_number() over (partition by item order by score desc, doc_id nulls last) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""

# Letters of the keywords in either case, spelled out: (?i) would fold characters beyond ASCII here.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_SECRETS = (f"(?:{_KEYWORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "(AKIA[A-Z0-9]{14,})", "([0-9a-f]{16,})", "([A-Za-z0-9+/_=-]{20,})")


def _secret(kind: int) -> str:
    p = _SECRETS[kind]
    return f"select row, {kind} as kind, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', 1) as v from texts"


SECRETS = f"""
with texts as (select row_number() over () as row, doc_id, source, coalesce(text, '') as t from documents)
, matches as (select row, kind, m, v, list_transform(g, lambda x: length(x)) as g, list_transform(m, lambda x: length(x)) as l from ({" union all ".join(map(_secret, range(4)))}) where len(m) > 0)
, spans as (select row, kind, (list_sum(g[1:i]) + list_sum(l[1:i]))::bigint as stop, l[i] as size, v[i] as value from (select *, unnest(range(1, len(m) + 1)) as i from matches))
, kept as (select row, kind, stop - size as start, stop, value from spans where kind > 0 or length(value) >= 12)
, live_looking as (select distinct row, stop - length(value) as start, stop, value from kept
                   where regexp_matches(value, '[A-Za-z]') and regexp_matches(value, '[0-9]') and len(list_distinct(string_split(value, ''))) >= 8)
, owners as (select value, count(distinct coalesce('=' || source, '')) as n from live_looking join texts using (row) group by value)
, listed as (select row, start, kind, stop from kept where kind < 3
             union all select row, start, case when n <= 1 then 4 else 5 end, stop from live_looking join owners using (value))
, told as (select *, ['assign', 'access', 'hex', '', 'live'][kind + 1] || ':' || start || ':' || stop as s from listed)
, grouped as (select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 4) as n_live, count(*) filter (kind = 5) as n_copied
              , string_agg(s, ',' order by start, kind, stop) filter (kind < 3) as base, string_agg(s, ',' order by start, kind, stop) filter (kind < 5) as spans from told group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
     , sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join grouped using (row)"""
