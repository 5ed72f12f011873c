"""Text that looks the same, brought to one form.

A text is first normalised in all but its letters' scripts: invisible characters go; wide,
narrow and styled forms, ligatures, digraphs and all blanks become the plain ones; letters are
composed; runs of blanks become one space, none at the ends.

Then every token gets a consistent script.  Each letter has a resolved set of scripts, those
that have a letter of its shape; the sets of a token's letters are intersected.  If Latin is
left, the token is spelled in Latin (so a token wholly of look-alikes of another script, a
whole-script confusable, becomes Latin); else if another script is left, it is spelled in that
(so a Latin letter amid Cyrillic ones becomes Cyrillic); an empty set is a mixed token that no
one script can spell, whose letters become Latin wherever they have that shape.  The spelling
so depends on the letters' shapes alone: tokens that look the same are spelled the same.

``skeleton`` maps letter by letter to Latin shapes instead; it serves ``words``, for which
spelling does not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each script, its letters and after each the Latin letter of the same shape.
SAME_SHAPE = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ӀI ԌG ԚQ ԜW ѴV ӔÆ ӘƏ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl үy ӕæ әə",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp ιi υu γy ϳj ϲc ϹC ͿJ",
    "Armenian": "օo ՕO հh սu ոn ցg զq յj ՏS ՍU Լl",
    "Cherokee": "ᎠD ᎡR ᎢT ᎥI ᎩY ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏂH ᏃZ ᏏB ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏧD ᏳG ᏴB",
    "Lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "Coptic": "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⳐL ⲟo ⲣp ⲥc",
    "Canadian": "ᐯV ᑌU ᑕC ᑭP ᑯd ᑲb ᒍJ ᒪL ᕼH ᖇR ᖴF ᗅA ᗞD ᗰM ᗷB ᙭X",
    "Deseret": "𐐄O 𐐕C 𐐛L 𐐠S 𐐬o 𐐽c 𐑈s",
    "Tifinagh": "ⵔO ⵝX ⵏI ⴸV",
    "Georgian": "ჿo",
}
#: All scripts that a token can be spelled in; of several other than Latin the first is taken.
SCRIPTS = sorted([*SAME_SHAPE, "Latin"])
#: Letters of the Latin script that have the shape of a basic one.
LATIN_VARIANTS = "ɡg ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs ɑa"
#: Invisible characters that Unicode does not class as format or variation characters.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Compatibility forms that look like their plain characters (the tags of Unicode's decompositions).
PLAIN_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: The tags of letters in the shape that they take beside others; their plain letters take it as well.
SHAPED_TAGS = ("<isolated>", "<initial>", "<medial>", "<final>")
#: Code points looked through to build the tables: the planes that hold letters, signs and format characters.
CODES = [*range(0x80, 0x20000), *range(0xE0000, 0xE0200)]

_latin = {pair[0]: pair[1] for pairs in (*SAME_SHAPE.values(), LATIN_VARIANTS) for pair in pairs.split()}
_script = {pair[0]: script for script, pairs in SAME_SHAPE.items() for pair in pairs.split()}
#: (script, Latin shape) -> the letter of the script; the first of several.
_respell: dict[tuple[str, str], str] = {}
for _script_name, _pairs in SAME_SHAPE.items():
    for _pair in _pairs.split():
        _respell.setdefault((_script_name, _pair[1]), _pair[0])


def _first_map() -> dict[int, str | None]:
    """Code point -> what is seen of it, before decomposition; None: nothing."""
    table: dict[int, str | None] = {c: None for c in [*range(0x9), *range(0xE, 0x1C), 0x7F]}
    for code in CODES:
        c = chr(code)
        if c.isspace() or c == "\u2800":
            table[code] = " "
            continue
        category = unicodedata.category(c)
        if category in ("Cf", "Cc") or c in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            table[code] = None
            continue
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if tag in PLAIN_TAGS or tag in SHAPED_TAGS and " " not in unicodedata.normalize("NFKC", c) or tag == "<compat>" and _as_letters(c):
            table[code] = unicodedata.normalize("NFKC", c)
    return table


def _as_letters(c: str) -> bool:
    """Is this compatibility character seen as the letters it stands for?  Ligatures, digraphs, numerals and radicals are."""
    parts = unicodedata.normalize("NFKC", c)
    if any(word in unicodedata.name(c, "") for word in ("LIGATURE", "ROMAN NUMERAL", "KANGXI RADICAL", "MICRO SIGN")):
        return True
    return len(parts) > 1 and c.isalpha() and all(unicodedata.category(p)[0] in "LM" for p in parts)


_first = _first_map()
_second = str.maketrans(_latin)


#: Characters that the first table changes; composed ones and their parts; those of which a part is a letter of the second table.
_first_chars = frozenset(map(chr, _first))
_composed_chars = {c: frozenset(unicodedata.normalize("NFD", c)) for c in map(chr, CODES) if unicodedata.decomposition(c)[:1] not in ("", "<")}
_second_chars = frozenset(_latin) | frozenset(c for c, parts in _composed_chars.items() if not parts.isdisjoint(_latin))
#: The letters of the scripts that share shapes with Latin (by their names), and the Latin letters that are variants of others.
SHARED = frozenset(c for c in map(chr, CODES) if c.isalpha() and unicodedata.name(c, "").split(" ")[0].capitalize() in SAME_SHAPE) | frozenset(p[0] for p in LATIN_VARIANTS.split())
#: A token: a run of letters and combining marks.
_token = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")


def _composed(text: str, letters: frozenset[str], shapes: dict) -> str:
    """A text after the first table, its letters composed and those with a part in ``letters`` replaced part by part."""
    chars = set(text)
    if not _first_chars.isdisjoint(chars):
        text = text.translate(_first)
        chars = set(text)
    if text.isascii():
        return text
    if letters.isdisjoint(chars):
        return unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(shapes))


def plain(text: str) -> str:
    """A text with all but its letters' scripts normalised."""
    return _composed(text, frozenset(), {})


def latin_shape(part: str) -> str:
    return _latin.get(part, part)


def spellings() -> dict[tuple[str, str], str]:
    """(script, Latin shape) -> the letter of the script."""
    return dict(_respell)


def skeleton(text: str) -> str:
    """What is seen of a text, in Latin shapes wherever there is one."""
    return " ".join(_composed(text, _second_chars, _second).split())


def part_scripts(letter: str) -> frozenset[str] | None:
    """The scripts that have a letter of this shape; None if it says nothing (marks, other scripts' signs)."""
    letter = _latin.get(letter, letter)
    if letter in _writable:
        return _writable[letter]
    name = unicodedata.name(letter, "").split(" ")[0].capitalize()
    return frozenset([name]) if name in ("Latin", *SAME_SHAPE) else None


_writable = {shape: frozenset(["Latin", *(s for s, other in _respell if other == shape)]) for shape in set(_latin.values())}


@lru_cache(maxsize=200_000)
def respell(token: str) -> str:
    """A token in the one script that all its letters can be written in; see the module's text."""
    parts = unicodedata.normalize("NFD", token)
    sets = [s for s in map(part_scripts, parts) if s is not None]
    shared = frozenset.intersection(*sets) if sets else frozenset()
    latin = [_latin.get(c, c) for c in parts]
    if "Latin" in shared or not shared:
        return unicodedata.normalize("NFC", "".join(latin))
    script = min(shared)
    return unicodedata.normalize("NFC", "".join(_respell.get((script, c), c) for c in latin))


def form(text: str) -> str:
    """The one form of all texts that look like this one."""
    seen = plain(text)
    if not seen.isascii() and not SHARED.isdisjoint(seen):
        seen = _token.sub(lambda m: m[0] if SHARED.isdisjoint(m[0]) else respell(m[0]), seen)
    return " ".join(seen.split())


def own_script(c: str) -> str | None:
    """The script of a letter as written; None for marks and for scripts that share no shapes with Latin."""
    if c in _script:
        return _script[c]
    name = unicodedata.name(c, "").split(" ")[0].capitalize() if c.isalpha() else ""
    return name if name in ("Latin", *SAME_SHAPE) else None


@lru_cache(maxsize=200_000)
def token_kind(token: str) -> str:
    """'mixed': letters of several scripts; 'whole': of one other script, but each looks Latin; else 'plain'."""
    letters = [c for c in unicodedata.normalize("NFD", token) if own_script(c)]
    scripts = set(map(own_script, letters))
    if len(scripts) > 1:
        return "mixed"
    return "whole" if letters and all(c in _latin for c in letters) else "plain"


def letter_script(c: str) -> tuple[str, bool, bool] | None:
    """(script, all Latin shapes, of a script or kind that shares shapes with Latin) of a composed letter; None if it says nothing."""
    own = [p for p in unicodedata.normalize("NFD", c) if own_script(p)]
    return (own_script(own[0]), all(p in _latin for p in own), c in SHARED) if own else None


def token_kinds(text: str) -> list[str]:
    """The kinds of a text's tokens that have a letter of a script sharing shapes with Latin."""
    seen = plain(text)
    if SHARED.isdisjoint(seen):
        return []
    return [token_kind(m) for m in _token.findall(seen) if not SHARED.isdisjoint(m)]


#: Letters that differ in case only, or look alike in some case, have one key: lower case of the Latin shape.
_fold = {c: shape.lower() for c, shape in _latin.items()}
for _c, _shape in list(_latin.items()):
    if _c.isupper() and _c.lower() not in _latin:
        _fold[_c.lower()] = _shape.lower()
_folds = str.maketrans(_fold)
_fold_chars = frozenset(_fold) | frozenset(c for c, parts in _composed_chars.items() if not parts.isdisjoint(_fold))


def folded(text: str) -> str:
    """What is seen of a text, equal where texts look the same but for case and the number of blanks."""
    return _composed(text, _fold_chars, _folds).casefold()


def words(text: str | None) -> list[str]:
    """The words of a text (runs of letters and digits), equal where they look the same but for case."""
    return _word.findall(folded(text)) if text else []


_word = re.compile(r"[^\W_]+")


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts)
    both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form, mixed_tokens, whole_tokens) per document.

    ``form`` is equal for texts that look the same; the counts are of tokens with letters of
    several scripts and of tokens wholly of look-alikes.  Null texts give null and 0, empty and
    blank ones an empty form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kinds = [], ([], [])
            for t in batch.column("text").to_pylist():
                out.append(None if t is None else form(t))
                found = token_kinds(t) if t else []
                kinds[0].append(found.count("mixed"))
                kinds[1].append(found.count("whole"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(kinds[0], pa.int64()), pa.array(kinds[1], pa.int64())], names=["doc_id", "form", "mixed_tokens", "whole_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, form string, mixed_tokens bigint, whole_tokens bigint")


def form_keys(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f1, f2, t1, t2): 128-bit keys of the form and of the text itself.

    Null, empty and blank texts are left out.  Texts never leave the task that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            seen = [form(t) if t else "" for t in texts]
            keep = [i for i, f in enumerate(seen) if f]
            f1, f2 = _hashes([seen[i] for i in keep])
            t1, t2 = _hashes([texts[i] for i in keep])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), *(pa.array(x, pa.int64()) for x in (f1, f2, t1, t2))], names=["doc_id", "f1", "f2", "t1", "t2"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, f1 bigint, f2 bigint, t1 bigint, t2 bigint")


def look_alikes(keys: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of equal form and unequal text, from ``form_keys``.

    Copies are counted into spellings first, which combines before its shuffle, so a group of a
    third of all rows is one row.  Only forms with several spellings go on; pairs are made
    between spellings, then expanded to the documents, so no pair of equal texts is ever built.
    ``keys`` is read several times: pass a written table.  Rows of one document id make no pair with
    each other, and no pair of ids comes twice; null ids make no pairs.
    """
    look, text = ["f1", "f2"], ["t1", "t2"]
    spelled = keys.groupBy(*look, *text).agg(F.count(F.lit(1)).alias("n"))
    varied = spelled.groupBy(*look).agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1").select(*look)
    classes = spelled.join(varied, look, "left_semi")
    a, b = classes.alias("a"), classes.alias("b")
    below = (F.col("a.t1") < F.col("b.t1")) | ((F.col("a.t1") == F.col("b.t1")) & (F.col("a.t2") < F.col("b.t2")))
    pairs = a.join(b, (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2")) & below).select("a.f1", "a.f2", "a.t1", "a.t2", F.col("b.t1").alias("u1"), F.col("b.t2").alias("u2"))
    one = keys.withColumnRenamed("doc_id", "x").join(pairs, [*look, *text])
    two = keys.select(*look, F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("doc_id").alias("y")).join(one, [*look, "u1", "u2"])
    return two.where("x != y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def classes(keys: DataFrame) -> DataFrame:
    """(doc_id, class_id, spelling_id) per document, from ``form_keys``: the linear form of ``look_alikes``.

    ``class_id`` is the smallest id of the documents that look the same, ``spelling_id`` of those
    with the same text: the pairs are those of one class and two spellings.  Rows of one id count
    once for each text; null ids are left out.  Groups are reduced on the map side to their
    smallest id before they are shuffled, and joined back to the documents.
    """
    look, text = ["f1", "f2"], ["t1", "t2"]
    known = keys.where("doc_id is not null")
    spelled = known.groupBy(*look, *text).agg(F.min("doc_id").alias("spelling_id"))
    seen = spelled.groupBy(*look).agg(F.min("spelling_id").alias("class_id"))
    named = spelled.join(seen, look)
    return known.join(named, [*look, *text]).select("doc_id", "class_id", "spelling_id").distinct()
