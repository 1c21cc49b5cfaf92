"""DuckDB SQL for the queries that SQL can express."""

from .sharding import SHARDS, TABLE_SIZE, fill_table

_CTX = "regexp_matches(lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(t, e + 1, 40)), '{w}')"


def _kind(kind: str, pattern: str, check: str) -> str:
    """Rows (doc_id, t, kind, s, e): each match's offsets, from the texts between the matches."""
    return f"""
  {kind}_m as (select rid, doc_id, t, regexp_extract_all(t, '{pattern}') as hits, string_split_regex(t, '{pattern}') as gaps from docs),
  {kind}_s as (select rid, doc_id, t, unnest(range(1, len(hits) + 1)) as i, hits, gaps from {kind}_m),
  {kind}_o as (select rid, doc_id, t, hits[i] as h,
      cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) as bigint) as s from {kind}_s),
  {kind} as (select rid, doc_id, '{kind}' as kind, s, s + length(h) as e, t, h from {kind}_o where {check})"""


_D = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"""length({_D}) between 16 and 19 and list_sum(list_transform(range(1, length({_D}) + 1), lambda i:
   case when i % 2 = 0 then case when 2 * cast({_D}[length({_D}) - i + 1] as int) > 9 then 2 * cast({_D}[length({_D}) - i + 1] as int) - 9 else 2 * cast({_D}[length({_D}) - i + 1] as int) end
        else cast({_D}[length({_D}) - i + 1] as int) end)) % 10 = 0"""
_IBAN = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4), ''), lambda c: ascii(c))),
   lambda r, c: case when c < 58 then (r * 10 + c - 48) % 97 else (r * 100 + c - 55) % 97 end) = 1 and length(replace(h, ' ', '')) between 15 and 34"""
_IP = "list_bool_and(list_transform(string_split(h, '.'), lambda x: length(ltrim(x, '0')) <= 3 and cast('0' || right(ltrim(x, '0'), 3) as int) <= 255))"

OP6 = (
    "with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),"
    + ",".join(
        [
            _kind("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
            _kind("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", _IP),
            _kind("card", "[0-9](?:[\\x20-]?[0-9])+", _LUHN),
            _kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_D}) between 8 and 15"),
            _kind("iban", "[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}", _IBAN),
            _kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", _CTX.format(w="ssn|social|security")),
        ]
    )
    + """,
  every as (select rid, kind, s, e, 1 as o from email union all select rid, kind, s, e, 2 from ip union all select rid, kind, s, e, 3 from card
     union all select rid, kind, s, e, 4 from phone union all select rid, kind, s, e, 5 from iban union all select rid, kind, s, e, 6 from ssn),
  per as (select rid, count(*) filter (o = 1) as n_email, count(*) filter (o = 2) as n_ip, count(*) filter (o = 3) as n_card, count(*) filter (o = 4) as n_phone,
     coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < 5), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans from every group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join per using (rid)"""
)

OP9 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
   from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

#: The table's filling is a loop over turns, so the table comes as a list; placing a key in it is SQL.
OP3 = f"""
with placed as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 15) as bigint) % {TABLE_SIZE} as slot from documents)
select doc_id, slot, cast((select {fill_table([f"shard-{i:05d}" for i in range(SHARDS)])})[slot + 1] as int) as shard from placed"""

#: Cuts by lengths and code points, where the operator joins units; the text itself stands for the restored one.
OP12 = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) as sizes, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as hs from d),
c as (select *, cast(len(sizes) as bigint) as n, least(hs[1] % (len(sizes) + 1), hs[2] % (len(sizes) + 1)) as lo, greatest(hs[1] % (len(sizes) + 1), hs[2] % (len(sizes) + 1)) as hi,
   t = '' or regexp_matches(t, '<[PSM]>') or hs[3] % 100 >= 90 as whole, hs[4] % 100 < 20 as turned from u),
p as (select *, cast(coalesce(list_sum(sizes[1:lo]), 0) as bigint) as pc, cast(coalesce(list_sum(sizes[lo + 1:hi]), 0) as bigint) as mc from c),
o as (select *, substr(t, 1, pc) as pre, substr(t, pc + 1, mc) as mid, substr(t, pc + mc + 1) as suf from p)
select doc_id, n, case when whole then 'plain' when turned then 'spm' else 'psm' end as form, case when not whole then pc end as prefix_chars, case when not whole then mc end as middle_chars,
  sha256(case when whole then t when turned then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from o"""



def _levels(name: str, by: str, deep: int) -> str:
    """Tables {name}0, {name}1, ... of the nodes of each level with what stands left and right in their runs, from a table
    {name} (by, r, n, node); a level of one node passes it on."""
    run = f"over (partition by {by}, r // 16 order by r rows between"
    out = [f"{name}_0 as (select {by}, r, n, node from {name})"]
    for i in range(deep):
        out.append(f"""{name}{i} as (select *, case when n > 1 then coalesce(string_agg(node, '') {run} unbounded preceding and 1 preceding), '') else '' end as l,
          case when n > 1 then coalesce(string_agg(node, '') {run} 1 following and unbounded following), '') else '' end as g from {name}_{i})""")
        out.append(f"""{name}_{i + 1} as (select {by}, r // 16 as r, (any_value(n) + 15) // 16 as n, case when any_value(n) > 1 then sha256(string_agg(node, '' order by r)) else any_value(node) end as node from {name}_{i} group by {by}, r // 16)""")
    return ",\n".join(out)


def _path(name: str, by: str, at: str, deep: int, first: str) -> str:
    """Joins a row's levels one by one: rows {name}_p{deep} with the siblings so far and the folded node."""
    out, last = [], first
    for i in range(deep):
        fold = "case when s.n > 1 then sha256(s.l || p.folded || s.g) else p.folded end"
        out.append(f"{name}_p{i + 1} as (select p.* exclude (siblings, folded), p.siblings || s.l || s.g as siblings, {fold} as folded from {last} p join {name}{i} s on p.{by} is not distinct from s.{by} and p.{at} // {16**i} = s.r)")
        last = f"{name}_p{i + 1}"
    return ",\n".join(out)


_FIELD = "case when {c} is null then '-' else strlen({c}) || ':' || {c} end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("k", "source", "lang", "cast(n_chars as varchar)", "{t}")) + ")"
#: DuckDB has no crc32, so its 8 steps a byte are spelt out.
_CRC = "xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(k, ''), lambda c: cast(ascii(c) as bigint))), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: cast(i as bigint))), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
#: Levels of a source's tree and of the tree of sources that the SQL spells out: 16^6 documents a source, 16^4 sources.
_DEEP, _TOP = 6, 4

OP11 = f"""
with d as (select *, cast(doc_id as varchar) as k from documents),
e as (select doc_id, source, {_LEAF.format(t="text")} as leaf, {_LEAF.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as low, k is not null and {_CRC} % 5 = 0 as touched from d),
f as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by source) as n from e),
a as (select source, r, n, leaf as node from f),
{_levels("a", "source", _DEEP)},
t as (select 0 as z, source, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n, node from a_{_DEEP}),
{_levels("t", "z", _TOP)},
s_p0 as (select *, '' as siblings, case when touched then low else leaf end as folded from f),
{_path("a", "source", "r", _DEEP, "s_p0")},
x as (select p.doc_id, p.leaf, p.siblings, p.folded, t.node as subroot, t.r, t.z from a_p{_DEEP} p join t on p.source is not distinct from t.source),
{_path("t", "z", "r", _TOP, "x")}
select p.doc_id, p.leaf, p.subroot, root.node as root, sha256(p.siblings) as proof_sha256, p.folded as folded_root, p.folded = root.node as verified from t_p{_TOP} p, t_{_TOP} root"""

OP13 = r"""
with recursive d as (select row_number() over () as i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct i, doc_id, sh from (select i, doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) end) as sh from d)),
n as materialized (select i, count(*) as n from s group by i),
met as (select a.i as a, b.i as b, count(*) as c from s a join s b on a.sh = b.sh and a.i < b.i group by a.i, b.i),
links as materialized (select a, b from met join n x on x.i = a join n y on y.i = b where 100 * c >= 80 * (x.n + y.n - c)),
edges as materialized (select a, b from links union all select b, a from links),
reach(i, o) as (select i, i from d union select r.i, e.b from reach r join edges e on r.o = e.a),
least as (select r.i, min(d.doc_id) as component_id from reach r join d on d.i = r.o group by r.i)
select d.doc_id, coalesce(n.n, 0) as n_shingles, l.component_id, d.doc_id is not distinct from l.component_id as kept from d left join n using (i) join least l using (i)"""

ORACLES = {"op13_bottomk": OP13, "op11_merkle": OP11, "op3_sharding": OP3, "op6_pii": OP6, "op9_vafile": OP9, "op12_infill": OP12}
