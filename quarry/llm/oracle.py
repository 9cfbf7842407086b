"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_BITS = "[0::bigint, 0, 0, 0, 0, 0, 0, 0]"


def crc32(decimal: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    step = f"lambda a, b: list_reduce(list_prepend(xor(a, b), {_BITS}), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({decimal}) + 1), lambda i: ascii({decimal}[i])::bigint)), {step}), 4294967295)"


PREFIX_TRIE = f"""
with t as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i, coalesce(role, '') r, coalesce(text, '') x
  from conversations where conv_id is not null
), ids as (select c, {crc32("s")} % 6 h from (select distinct c, c::varchar s from t)),
turns as (
  select ids.c, 0 seg, t.i, t.r, t.x from ids join t on t.c = ids.c - ids.c % 100 and t.i <= ids.h
  union all select t.c, 1, t.i, t.r, t.x from t join ids using (c) where t.i > ids.h
), numbered as (select c, row_number() over (partition by c order by seg, i) d, md5(length(r) || ':' || r || x) k, length(x) len from turns),
p as (
  select c, d, md5(string_agg(k, ',') over (partition by c order by d)) path, len from numbered
  union all select c, 0, '', 0 from ids
), node as (select d, path, min(c) conv, count(*) n, min(len) len from p group by d, path),
tops as (select c, max(d) d from p group by c),
ends as (select p.d, p.path, sha256(string_agg(p.c::varchar, ',' order by p.c)) sha from p join tops using (c, d) group by p.d, p.path),
up as (select node.*, q.path up_path from node left join p q on q.c = node.conv and q.d = node.d - 1),
kids as (select d - 1 d, up_path path, count(*) n from up where d > 0 group by 1, 2),
own as (select node.*, coalesce(kids.n, 0) children from node left join kids using (d, path)),
sub as (select p.d, p.path, sum((own.n - 1) * own.len) saved, sum(case when own.children = 0 then 1 else 0 end) leaves from own join p on p.c = own.conv and p.d <= own.d group by p.d, p.path)
select own.conv conv_id, own.d depth, above.conv parent_conv_id, own.n n_convs, own.children::bigint n_children, sub.leaves::bigint n_leaves, sub.saved::bigint saved_tokens,
  coalesce(ends.sha, sha256('')) ends_sha256
from own join sub using (d, path) join up using (d, path) left join node above on above.d = own.d - 1 and above.path = up.up_path left join ends on ends.d = own.d and ends.path = own.path
"""


def _tree(name: str, start: str, levels: int) -> tuple[list[str], list[str]]:
    """CTEs of a tree over start (g, r, h, c: group, rank, hash, nodes of the group), and the columns that fold a leaf's hash x upwards."""
    ctes, last = [f"{name}0 as ({start})"], f"{name}0"
    for k in range(levels):
        within = "partition by g, r // 8 order by r rows between"
        ctes.append(
            f"{name}s{k} as (select g, r, c > 1 has, coalesce(string_agg(h, '') over ({within} unbounded preceding and 1 preceding), '') lft, coalesce(string_agg(h, '') over ({within} 1 following and unbounded following), '') rgt from {last})"
        )
        ctes.append(f"{name}{k + 1} as (select g, r // 8 r, case when c = 1 then min(h) else sha256(string_agg(h, '' order by r)) end h, (c + 7) // 8 c from {last} group by g, r // 8, c)")
        last = f"{name}{k + 1}"
    return ctes, [f"{name}s{k}" for k in range(levels)]


def _up(source: str, sides: list[str], name: str) -> tuple[list[str], str]:
    """CTEs that lead rows (g, r, x, sib) up a tree."""
    ctes = []
    for k, s in enumerate(sides):
        now = f"{name}{k}"
        ctes.append(f"{now} as (select d.* replace (case when s.has then sha256(s.lft || d.x || s.rgt) else d.x end as x, d.sib || s.lft || s.rgt as sib) from {source} d join {s} s on s.g = d.g and s.r = d.r // {8**k})")
        source = now
    return ctes, source


def _merkle(levels: int = 7, upper: int = 3) -> str:
    def leaf(text: str) -> str:
        values = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar)::varchar || ':' || {v}::varchar, '-')" for v in values) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    group = "case when lang is null then '' else 'x' || lang end"
    ctes = [
        f"raw as (select doc_id, {group} g, {leaf('text')} leaf, case when {crc32('s')} % 3 = 0 then {leaf(lower)} end other from (select *, doc_id::varchar s from documents))",
        "doc as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 r, count(*) over (partition by g) n from raw)",
    ]
    more, sides = _tree("a", "select g, r, leaf h, n c from doc", levels)
    ctes += more
    ctes.append(f"top as (select g of_g, h subroot, row_number() over (order by g) - 1 r, count(*) over () n from a{levels})")
    more, top_sides = _tree("b", "select '' g, r, subroot h, n c from top", upper)
    ctes += more
    ctes.append("start as (select doc_id, leaf, g, r, coalesce(other, leaf) x, '' sib from doc)")
    more, last = _up("start", sides, "u")
    ctes += more
    ctes.append(f"middle as (select u.doc_id, u.leaf, t.subroot, '' g, t.r, u.x, u.sib from {last} u join top t on t.of_g = u.g)")
    more, last = _up("middle", top_sides, "v")
    ctes += more
    return "with " + ", ".join(ctes) + f" select doc_id, leaf, subroot, b{upper}.h root, sha256(sib) proof_sha256, x folded_root, x = b{upper}.h verified from {last}, b{upper}"


#: Trees of up to 8^7 documents and 8^3 languages.
MERKLE = _merkle()
