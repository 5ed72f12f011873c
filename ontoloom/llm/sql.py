"""DuckDB SQL for the queries of the text operators.

What a single character becomes is stated in tables that are made from ``looks`` by rule; cutting
texts into words and tokens, intersecting scripts, grouping and matching are SQL's own.
"""

from __future__ import annotations

import unicodedata

from ontoloom.llm import looks
from ontoloom.plans.bulk_sql import read

_P3 = (
    "with types as (select *, coalesce(literal_type, '') as lt from node_properties),"
    + read("types", "lt")
    + ","
    + read("predicates", "iri")
    + """, iris as (select distinct term from read_predicates),
 used as (select predicate, subject from relations union all select predicate, subject from node_properties),
 by_iri as (select term, count(*) as n, count(distinct subject) as d from used join read_predicates p on p.id = used.predicate group by 1),
 counts as (
 select 'iri' as field, iris.term, coalesce(n, 0) as rows, coalesce(d, 0) as records, (select count(distinct subject) from used) as total from iris left join by_iri using (term)
 union all select 'literal_type', case when term = '' then 'http://www.w3.org/2001/XMLSchema#string' else term end, count(*), count(distinct subject), (select count(distinct subject) from node_properties) from read_types group by 2)
"""
)



def _character_map(change) -> str:
    """SQL rows (code point, text) of the characters that ``change`` alters."""
    pairs = [(code, change(chr(code))) for code in (*range(0x80), *looks.CODES) if not 0xD800 <= code < 0xE000]
    return ", ".join("({}, '{}')".format(code, text.replace("'", "''")) for code, text in pairs if text != chr(code))


def _seen(c: str) -> str:
    """What is seen of one character; blanks and the characters around a text do not count."""
    return " " if c.isspace() else looks.skeleton(c)


def _word_letters(c: str) -> str:
    return " " if c.isspace() else looks.folded(c)


def _plain(c: str) -> str:
    return " " if c.isspace() else looks.plain(c)


def _script_rows() -> str:
    """SQL rows (code point, script, Latin shape, shares shapes) of the letters of the scripts that share shapes with Latin, and of Latin."""
    found = [(code, looks.letter_script(chr(code))) for code in (*range(0x41, 0x80), *looks.CODES) if chr(code).isalpha()]
    return ", ".join(f"({code}, '{script}', {look}, {other})" for code, known in found if known for script, look, other in [known])


def _mapped(table: str, columns: str, change) -> str:
    """SQL common tables: ``<table>_text`` has the texts with every character changed, composed and with single blanks."""
    return f"""{table}_map(cp, txt) as (values {_character_map(change)}),
 {table}_chars as (select {columns}, unnest(regexp_extract_all(text, '(?s).')) as ch, unnest(range(len(regexp_extract_all(text, '(?s).')))) as pos from {table} where text is not null),
 {table}_text as (select {columns}, trim(regexp_replace(nfc_normalize(string_agg(coalesce(txt, ch), '' order by pos)), ' +', ' ', 'g')) as seen from {table}_chars left join {table}_map on cp = unicode(ch) group by {columns})"""


_WINDOWS = "{0}_grams as (select distinct {1}, array_to_string(w[i:i + 9], ' ') as gram from (select {1}, w, unnest(range(1, len(w) - 8)) as i from (select {1}, regexp_extract_all(seen, '[\\p{{L}}\\p{{N}}]+') as w from {0}_text) where len(w) > 9))"
_LOOKS = "with " + _mapped("documents", "doc_id", _seen) + ", shown as (select d.doc_id, d.text, s.seen from documents d join documents_text s using (doc_id) where s.seen <> '')"
_TOKENS = (
    "with "
    + _mapped("documents", "doc_id", _plain)
    + f""", letters(cp, script, look, other) as (values {_script_rows()}),
 tokens as (select doc_id, row_number() over () as n, token from (select doc_id, unnest(regexp_extract_all(seen, '(?:[\\p{{L}}\\p{{Nl}}\\p{{No}}]|[\\x{{300}}-\\x{{36f}}])+')) as token from documents_text)),
 kinds as (select doc_id, n, count(distinct script) > 1 as mixed, count(distinct script) = 1 and bool_and(look) as whole from (select doc_id, n, unnest(regexp_extract_all(token, '(?s).')) as ch from tokens) join letters on cp = unicode(ch) group by 1, 2 having bool_or(other))"""
)
def _part_rows() -> str:
    """SQL rows (code point, number, text in Latin shapes, scripts as bits, shares shapes) of the parts of the letters that can be respelled."""
    rows = []
    for code in (*range(0x41, 0x80), *looks.CODES):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c) if c.isalpha() else ""
        if any(looks.part_scripts(p) for p in parts):
            for n, p in enumerate(parts):
                known = looks.part_scripts(p)
                bits = "null" if known is None else sum(1 << looks.SCRIPTS.index(x) for x in known)
                rows.append(f"({code}, {n}, '{looks.latin_shape(p)}', {bits}, {c in looks.SHARED})")
    return ", ".join(rows)


_LETTERS = "\\p{L}\\p{Nl}\\p{No}\\x{300}-\\x{36f}"
_FORMS = (
    "with "
    + _mapped("documents", "doc_id", _plain)
    + f""", parts(cp, nth, latin, bits, shared) as (values {_part_rows()}),
 spelled(script, latin, letter) as (values {", ".join(f"({looks.SCRIPTS.index(script)}, '{latin}', '{letter}')" for (script, latin), letter in looks.spellings().items())}),
 runs as (select doc_id, unnest(regexp_extract_all(seen, '[{_LETTERS}]+|[^{_LETTERS}]+')) as run, unnest(range(len(regexp_extract_all(seen, '[{_LETTERS}]+|[^{_LETTERS}]+')))) as n from documents_text),
 letters as (select doc_id, n, unnest(regexp_extract_all(run, '(?s).')) as ch, unnest(range(len(run))) as pos from runs),
 known as (select doc_id, n, pos, nth, coalesce(latin, ch) as latin, bits, shared from letters left join parts on cp = unicode(ch)),
 chosen as (select doc_id, n, coalesce(bit_and(bits), 0) as bits, bool_or(shared) as shared from known group by 1, 2),
 scripts as (select *, case when bits = 0 or bits & {1 << looks.SCRIPTS.index("Latin")} > 0 then -1 else instr(reverse(bin(bits)), '1') - 1 end as script from chosen where shared),
 respelled as (select doc_id, n, nfc_normalize(string_agg(coalesce(letter, k.latin), '' order by pos, nth)) as run from scripts s join known k using (doc_id, n) left join spelled p on p.script = s.script and p.latin = k.latin group by 1, 2)
"""
)
_LEAKS = "with " + ", ".join([_mapped("documents", "doc_id", _word_letters), _mapped("benchmark", "item_id", _word_letters), _WINDOWS.format("documents", "doc_id"), _WINDOWS.format("benchmark", "item_id")])

_SLICES = "select distinct {1}, w[i:i + {2} - 1] as g from (select {1}, w, unnest(range(1, len(w) - {2} + 2)) as i from {0}_words)"
_WORDS = "{0}_words as (select {1}, regexp_extract_all(seen, '[\\p{{L}}\\p{{N}}]+') as w from {0}_text)"
_WITHOUT = "array_to_string(list_concat(g[1:k - 1], g[k + 1:]), ' ')"
#: One edit: a word less anywhere, another word or one more amid the window; all by equal texts.
_NEAR = (
    "with "
    + ", ".join([_mapped("documents", "doc_id", _word_letters), _mapped("benchmark", "item_id", _word_letters), _WORDS.format("documents", "doc_id"), _WORDS.format("benchmark", "item_id")])
    + f""", items as ({_SLICES.format("benchmark", "item_id", 10)}),
 d9 as ({_SLICES.format("documents", "doc_id", 9)}), d10 as ({_SLICES.format("documents", "doc_id", 10)}), d11 as ({_SLICES.format("documents", "doc_id", 11)}),
 wanted as (select item_id, 'same' as way, array_to_string(g, ' ') as t from items
   union all select item_id, 'less', {_WITHOUT} from items, range(1, 11) r(k)
   union all select item_id, 'other' || k, {_WITHOUT} from items, range(2, 10) r(k)
   union all select item_id, 'more', array_to_string(g, ' ') from items),
 had as (select doc_id, 'same' as way, array_to_string(g, ' ') as t from d10
   union all select doc_id, 'less', array_to_string(g, ' ') from d9
   union all select doc_id, 'other' || k, {_WITHOUT} from d10, range(2, 10) r(k)
   union all select doc_id, 'more', {_WITHOUT} from d11, range(2, 11) r(k))
"""
)

SQL = {
    "p7_near": _NEAR + "select doc_id, item_id, cast(min(case when way = 'same' then 0 else 1 end) as int) as edits from had join wanted using (way, t) group by 1, 2",
    "p3_found": _P3 + "select field, term, case when records < 5 then 'rare' else 'common' end as mark from counts where records < 5 or records > total * 0.5",
    "p3_counts": _P3 + "select field, term, rows, records from counts",
    "p7_found": _LEAKS + " select distinct doc_id, item_id from documents_grams join benchmark_grams using (gram)",
    "p8_found": _LOOKS + " select a.doc_id as doc_id_a, b.doc_id as doc_id_b from shown a join shown b on a.seen = b.seen and a.doc_id < b.doc_id and a.text <> b.text",
    "p8_forms": _FORMS
    + """, forms as (select doc_id, string_agg(coalesce(x.run, r.run), '' order by r.n) as form from runs r left join respelled x using (doc_id, n) group by 1)
 select d.doc_id, case when d.text is not null then coalesce(form, '') end as form, t.mixed_tokens, t.whole_tokens from documents d left join forms using (doc_id) join ("""
    + _TOKENS
    + " select d.doc_id, count(*) filter (where mixed) as mixed_tokens, count(*) filter (where whole) as whole_tokens from documents d left join kinds k on k.doc_id = d.doc_id group by 1) t on t.doc_id = d.doc_id",
    "p8_tokens": _TOKENS + " select d.doc_id, count(*) filter (where mixed) as mixed_tokens, count(*) filter (where whole) as whole_tokens from documents d left join kinds k on k.doc_id = d.doc_id group by 1",
    "p8_classes": _LOOKS + " select doc_id, min(doc_id) over (partition by seen) as class_id, min(doc_id) over (partition by text) as spelling_id from shown",
}
