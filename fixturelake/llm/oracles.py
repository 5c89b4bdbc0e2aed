"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: Kind, pattern, measured group and least length of each; the first three are the base.
SECRET_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A match of [0-9a-f]+ is a whole run, so those of 16 or more are the runs of at least 16; the list of all runs is too long for SQL.
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(place: int) -> str:
    kind, pattern, measured, least = SECRET_KINDS[place]
    pattern = _quoted(pattern)
    return f"""list_transform(list_filter(list_transform(range(1, 1 + len(regexp_extract_all(t, {pattern}))),
        lambda i: {{'s': (list_sum(list_transform((string_split_regex(t, {pattern}))[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform((regexp_extract_all(t, {pattern}))[1:i-1], lambda x: length(x))), 0))::bigint,
             'p': {place}, 'n': length((regexp_extract_all(t, {pattern}))[i]),
             'g': length((regexp_extract_all(t, {pattern}, {measured}))[i]), 'k': '{kind}'}}),
        lambda m: m.g >= {least}), lambda m: {{'s': m.s, 'p': m.p, 'e': m.s + m.n, 'k': m.k}})"""


def _joined_sql(kinds: tuple) -> str:
    lists = ", ".join(f"s_{kind}" for kind, *_ in kinds)
    return f"coalesce(array_to_string(list_transform(list_sort(flatten([{lists}])), lambda m: m.k || ':' || m.s || ':' || m.e), ','), '')"


SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id, {", ".join(f"{_spans_sql(i)} as s_{SECRET_KINDS[i][0]}" for i in range(len(SECRET_KINDS)))} from d)
select doc_id, {", ".join(f"len(s_{kind})::bigint as n_{kind}" for kind, *_ in SECRET_KINDS[:3])},
       sha256({_joined_sql(SECRET_KINDS[:3])}) as base_sha256, {_joined_sql(SECRET_KINDS)} as spans
from f
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first_id from p group by hex)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::bigint >> b) & 31)::int, 1)), '')), '')
           as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p join f using (hex)
"""

JACCARD = """
with recursive w as materialized (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as materialized (
  select p.a, p.b, x.n = y.n and x.n = p.c as equal from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 9 * p.c >= 4 * (x.n + y.n)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as component_id from r group by a)
select d.doc_id, least(d.doc_id, coalesce(min(l.b) filter (where l.equal), d.doc_id)) as class_id, count(l.b)::bigint as n_links,
       any_value(c.component_id) as component_id, d.doc_id = any_value(c.component_id) as kept
from documents d join c on c.a = d.doc_id left join l on l.a = d.doc_id group by d.doc_id
"""

NEARDUP = """
with recursive e as materialized (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select c.a as vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, c.a = c.component_id as kept from c left join n on n.a = c.a
"""

LINES = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
l as (select row, doc_id, generate_subscripts(string_split(t, chr(10)), 1) as place, unnest(string_split(t, chr(10))) as line from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(doc_id) as largest from k where length(key) >= 40 group by key having count(distinct doc_id) + count(distinct case when doc_id is null then 1 end) >= 5),
x as (select k.*, g.key is not null and doc_id is distinct from largest as gone from k left join g using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from x group by row
""".replace("\\\\", "\\")

def _leaf_sql(n_chars: str) -> str:
    text = ["cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({x})::varchar || ':' || {x}, '-')" for x in text) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of all nodes of the trees over leaves (tree, idx, h): name has level, tree, idx, h, n (nodes of the tree's level)."""
    return f"""{name} as (
  select 0 as level, tree, idx, h, count(*) over (partition by tree) as n from {leaves}
  union all
  select level + 1, tree, idx // 2, sha256(string_agg(h, '' order by idx)), (any_value(n) + 1) // 2 from {name} where n > 1 group by level, tree, idx // 2)"""


def _paths_sql(name: str, nodes: str, start: str) -> str:
    """Walk of the rows of start (id, tree, idx, h) to their root: proof, the siblings so far, and h, what they fold to."""
    return f"""{name} as (
  select 0 as level, id, tree, idx, h, proof, idx as at from {start}
  union all
  select p.level + 1, p.id, p.tree, p.idx, case when s.h is null then sha256(p.h) when p.at % 2 = 1 then sha256(s.h || p.h) else sha256(p.h || s.h) end,
         p.proof || coalesce(s.h, ''), p.at // 2
  from {name} p join {nodes} o on o.level = p.level and o.tree = p.tree and o.idx = p.at and o.n > 1
  left join {nodes} s on s.level = p.level and s.tree = p.tree and s.idx = xor(p.at, 1))"""


MERKLE = f"""
with recursive c as (
  select *, case when doc_id is not null then xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end)) % 7 = 0 end as hit from documents),
l as materialized (
  select row_number() over (order by tree nulls first, doc_id nulls first, h) as id, tree,
         row_number() over (partition by tree order by doc_id nulls first, h) - 1 as idx, h, changed, doc_id
  from (select doc_id, coalesce('=' || lang, '-') as tree, {_leaf_sql('n_chars')} as h, {_leaf_sql('(n_chars::hugeint + case when hit then 1 else 0 end)')} as changed from c)),
{_tree_sql("t", "l")},
nodes as materialized (select * from t),
sub as materialized (select '' as tree, tree as lang, row_number() over (order by tree) - 1 as idx, h from nodes where n = 1),
{_tree_sql("u", "sub")},
tops as materialized (select * from u),
{_paths_sql("p", "nodes", "(select id, tree, idx, h, '' as proof from l union all select -id, tree, idx, changed, '' from l)")},
low as materialized (select id, tree, h, proof from p qualify row_number() over (partition by id order by level desc) = 1),
{_paths_sql("q", "tops", "(select low.id, sub.tree, sub.idx, low.h, low.proof from low join sub on sub.lang = low.tree)")},
full_path as materialized (select id, h, proof from q qualify row_number() over (partition by id order by level desc) = 1)
select l.doc_id, l.h as leaf, sub.h as subroot, r.h as root, sha256(o.proof) as proof_sha256, x.h as folded_root, x.h = r.h as verified
from l join sub on sub.lang = l.tree join full_path o on o.id = l.id join full_path x on x.id = -l.id, (select h from tops where n = 1) r
"""

ORACLES = {"op1_neardup": NEARDUP, "op10_jaccard": JACCARD, "op2_warc": WARC, "op9_secrets": SECRETS, "op12_lines": LINES, "op13_manifest": MERKLE}
