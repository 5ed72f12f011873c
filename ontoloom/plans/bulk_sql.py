"""DuckDB SQL for the queries of ``bulk``."""

from __future__ import annotations

_READ = r"""
 bare_{t} as (select *, case when b like '<%>' and length(b) > 1 then substr(b, 2, length(b) - 2) else b end as txt
   from (select *, regexp_replace(regexp_replace({c}, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '') as b from {t})),
 read_{t} as (select x.*, coalesce(p.namespace || substr(txt, strpos(txt, ':') + 1), txt) as term
   from bare_{t} x left join prefixes p on strpos(txt, ':') > 0 and p.prefix = substr(txt, 1, strpos(txt, ':') - 1))
"""


def read(t: str, c: str) -> str:
    """Common table ``read_<t>``: table ``t`` with ``term``, the IRI that column ``c`` reads as."""
    return _READ.format(t=t, c=c)


_LINKS = (
    "with recursive "
    + read("predicates", "iri")
    + r""",
 ways as (select id, regexp_matches(term, 'partOf$|broader$') as up from read_predicates
   where term in ('http://quarry.example/ns#partOf', 'http://quarry.example/ns#broader', 'http://quarry.example/ns#hasPart', 'http://quarry.example/ns#narrower')),
 links as (select distinct case when up then subject else object end as child, case when up then object else subject end as parent from relations join ways on predicate = id),
 nodes as (select child as node from links where child is not null union select parent from links where parent is not null),
 up as (select child, min(parent) as parent from links where parent is not null and child is not null group by child),
 tree as (select node, node as root, 0 as depth, cast(node as varchar) as path, [node] as trail from nodes where node not in (select child from up)
   union all select u.child, t.root, t.depth + 1, t.path || '/' || u.child, list_append(t.trail, u.child) from tree t join up u on u.parent = t.node),
 rest as (select child, parent from up where child not in (select node from tree)),
 reach as (select child as a, parent as b from rest union select r.a, u.parent from reach r join rest u on u.child = r.b)
"""
)

_KINDS = r"""
 kinds as (select *, case when term is null or term = '' or term = 'http://www.w3.org/2001/XMLSchema#string' or regexp_full_match(term, '@[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*') then 'text'
   when term in ('http://www.w3.org/2001/XMLSchema#boolean','http://www.w3.org/2001/XMLSchema#integer','http://www.w3.org/2001/XMLSchema#int','http://www.w3.org/2001/XMLSchema#nonNegativeInteger','http://www.w3.org/2001/XMLSchema#decimal','http://www.w3.org/2001/XMLSchema#double','http://www.w3.org/2001/XMLSchema#float','http://www.w3.org/2001/XMLSchema#date','http://www.w3.org/2001/XMLSchema#dateTime') then substr(term, 34)
   else 'unknown' end as kind from read_recs)
"""

_DEC = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
_DT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"

_RECORDS = (
    r"""with split as (select line_id, coalesce(line, '') as line, regexp_full_match(coalesce(line, ''), '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') as fine from property_lines),
 parts as (select *, case when fine then regexp_extract_all(',' || line, ',("([^"]|"")*"|[^",]*)', 1, 's') end as f from split),
 bare as (select *, case when fine and len(f) = 4 then [case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end for x in f] end as g from parts),
 recs as (select 'node_properties' as origin, row_id, cast(null as varchar) as fault, subject, predicate, literal_value, literal_type, cast(null as varchar) as subject_text, cast(null as varchar) as predicate_text from node_properties
   union all select 'property_lines', line_id, case when not fine then 'quoting' when len(f) <> 4 then 'columns' end,
     case when regexp_full_match(g[1], '[+-]?[0-9]+') then try_cast(g[1] as bigint) end, case when regexp_full_match(g[2], '[+-]?[0-9]+') then try_cast(g[2] as bigint) end, g[3], g[4],
     case when not regexp_full_match(g[1], '[+-]?[0-9]+') or try_cast(g[1] as bigint) is null then g[1] end, case when not regexp_full_match(g[2], '[+-]?[0-9]+') or try_cast(g[2] as bigint) is null then g[2] end from bare),
"""
    + read("recs", "literal_type")
    + ","
    + _KINDS
    + rf""",
 judged as (select *, case when fault is not null then fault when kind = 'unknown' then 'type' when literal_value is null then 'value'
   when not case kind when 'text' then true when 'boolean' then literal_value in ('true', 'false', '1', '0')
     when 'integer' then regexp_full_match(literal_value, '[+-]?[0-9]+') when 'int' then regexp_full_match(literal_value, '[+-]?[0-9]+') and try_cast(literal_value as int) is not null
     when 'nonNegativeInteger' then regexp_full_match(literal_value, '[+]?[0-9]+|-0+') when 'decimal' then regexp_full_match(literal_value, '{_DEC}')
     when 'double' then regexp_full_match(literal_value, '{_DEC}([eE][+-]?[0-9]+)?|NaN|-?INF') when 'float' then regexp_full_match(literal_value, '{_DEC}([eE][+-]?[0-9]+)?|NaN|-?INF')
     when 'date' then regexp_full_match(literal_value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(literal_value as date) is not null
     when 'dateTime' then regexp_full_match(literal_value, '{_DT}') and try_cast(substr(literal_value, 1, 10) as date) is not null end then 'value' end as reason from kinds)
"""
)

_CELLS = rf"""with wide as (select distinct predicate, column_name, column_type from wide_columns),
 cell_rows as (select n.subject, w.column_name, w.column_type, n.literal_value as v from node_properties n join wide w using (predicate)),
 read as (select *, case column_type when 'string' then v
   when 'bigint' then case when regexp_full_match(v, '[+-]?[0-9]+') then cast(try_cast(v as bigint) as varchar) end
   when 'decimal' then case when regexp_full_match(v, '{_DEC}') then
     case when v like '-%' and regexp_matches(v, '[1-9]') then '-' else '' end
       || coalesce(nullif(regexp_extract(v, '^[+-]?0*([0-9]*)', 1), ''), '0')
       || coalesce('.' || nullif(rtrim(regexp_extract(v, '\.([0-9]*)$', 1), '0'), ''), '') end
   when 'double' then case when regexp_full_match(v, '{_DEC}([eE][+-]?[0-9]+)?|NaN|-?INF') then cast(try_cast(v as double) + 0.0 as varchar) end
   when 'boolean' then case when v in ('true', '1') then 'true' when v in ('false', '0') then 'false' end
   when 'date' then case when regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(v as date) is not null then v end
   when 'timestamp' then case when regexp_full_match(v, '{_DT}') then
     cast(epoch_us(try_cast(substr(v, 1, 19) as timestamp)) // 1000000 - coalesce((case when v like '%-__:__' then -1 else 1 end)
       * (try_cast(regexp_extract(v, '[+-]([0-9]{{2}}):[0-9]{{2}}$', 1) as bigint) * 3600 + try_cast(regexp_extract(v, '[+-][0-9]{{2}}:([0-9]{{2}})$', 1) as bigint) * 60), 0) as varchar)
       || coalesce('.' || nullif(rtrim(regexp_extract(v, 'T[0-9:]+\.([0-9]+)', 1), '0'), ''), '') end
   end as c from cell_rows)
"""

#: The wide columns of the test tables and the SQL types of their values.
_WIDE = {
    "active": "boolean", "altitude": "double", "budget": "decimal", "code": "varchar", "extra_116": "boolean", "extra_119": "boolean", "extra_13": "varchar", "extra_145": "boolean",
    "extra_170": "bigint", "extra_220": "varchar", "extra_308": "date", "extra_345": "bigint", "extra_366": "varchar", "extra_415": "boolean", "extra_435": "date", "extra_438": "decimal",
    "extra_45": "varchar", "extra_490": "varchar", "extra_518": "varchar", "extra_538": "varchar", "extra_59": "boolean", "extra_75": "date", "extra_82": "varchar", "founded": "date",
    "headcount": "bigint", "label": "varchar", "position": "bigint", "ratio": "double", "remark": "varchar", "score": "decimal", "updated": "timestamp",
}


def _typed(name: str, kind: str) -> str:
    low = f"max(low) filter (where column_name = '{name}')"
    if kind == "timestamp":
        return f"make_timestamp(cast(split_part({low}, '.', 1) as bigint) * 1000000 + coalesce(try_cast(rpad(split_part({low}, '.', 2), 6, '0') as bigint), 0)) as {name}"
    return f"cast({low} as {'decimal(38,12)' if kind == 'decimal' else kind}) as \"{name}\""


_UNFIT = r"(column_type = 'decimal' and regexp_matches(c, '^-?[0-9]{27}|\.[0-9]{13}') or column_type = 'timestamp' and regexp_matches(c, '\.[0-9]{7}'))"

_P2 = "select 'predicate' as field, predicate as key_id, count(*) as rows, count(distinct subject) as subjects from relations group by 2 union all select 'object', object, count(*), count(distinct subject) from relations group by 2"

SQL = {
    "p1_found": _LINKS
    + """select node, root, cast(depth as bigint) as depth from tree
 union all select child, -1, case when child in (select a from reach where a = b) then -1 else -2 end from rest""",
    "p1_paths": _LINKS + "select node, path from tree",
    "p1_descendants": _LINKS + "select a.anc as ancestor, t.node as descendant, cast(t.depth + 1 - a.pos as bigint) as distance from tree t, (select node as n, unnest(trail) as anc, unnest(range(1, len(trail) + 1)) as pos from tree) a where a.n = t.node and a.anc <> t.node",
    "p1_further": "with " + read("predicates", "iri") + ", links as (select distinct subject as node, object as parent from relations join read_predicates on id = predicate where term in ('http://quarry.example/ns#memberOf', 'http://quarry.example/ns#cites') and subject is not null and object is not null) select node, parent from links l where parent > (select min(parent) from links m where m.node = l.node)",
    "p2_found": f"select field, key_id from ({_P2}) where key_id is not null and rows * 100 >= (select count(*) from relations)",
    "p2_counts": _P2,
    "p4_found": _CELLS + "select subject, column_name from read where c is not null group by 1, 2 having count(distinct c) > 1",
    "p4_cells": _CELLS + "select subject, column_name, count(v) as n_values, count(c) as n_read, min(v) filter (where c is null) as unread from read group by 1, 2",
    "p4_failures": _CELLS
    + r"""select subject, column_name, column_type, v as value, case when c is null then 'unreadable' else 'unfit' end as reason, count(*) as n_rows from read
 where v is not null and (c is null or """
    + _UNFIT
    + ") group by all",
    "p4_wide": _CELLS
    + f""", judged as (select *, coalesce({_UNFIT}, false) as unfit from read),
 cells as (select subject, column_name, min(c) filter (where not unfit) as low, count(distinct c) > 1 as differs, min(v) filter (where c is null or unfit) as failed, count(v) filter (where c is null or unfit) as n_failed from judged group by 1, 2)
select subject, {', '.join(_typed(*x) for x in _WIDE.items())}, coalesce(string_agg(column_name, '; ' order by column_name) filter (where differs), '') as conflicts,
 coalesce(string_agg(column_name || '=' || failed, '; ' order by column_name || '=' || failed) filter (where failed is not null), '') as failures,
 coalesce(string_agg(column_name || '=' || n_failed, '; ' order by column_name || '=' || n_failed) filter (where failed is not null), '') as n_failed from cells group by 1""",
    "p5_found": _RECORDS + "select origin, row_id, reason from judged where reason is not null",
    "p5_loaded": _RECORDS + "select origin, row_id, subject, predicate, literal_value, literal_type, subject_text, predicate_text from judged where reason is null",
}
