"""Licence scan by a positional rare-token index, with DataFrame functions only.

Licence notices are templates: their words with positions, and key phrases that must be
there. How rare each licence word is (inverse document frequency) is counted over all
files. Of each template a file looks up the rarest words that it holds: a notice has so many of its
words in place, so of the positions whose word the file holds at all, rarest first, one of the
first few is in place in every notice. One pass over the file's words meets the postings of
all templates and gives the beginnings on which they agree; at each of these the
template's words and its key phrases are checked, so no notice is missed.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {0} of the license or at your option any later version"


def _template(label: str, text: str, *keys: str) -> Template:
    return Template(label, " ".join(text.split()), keys)


#: Notices as licences ask for them, whole texts of short licences and tags in sources, in lower
#: case, marks left out, and phrases they can't lack.
TEMPLATES = (
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge", "associated documentation files"),
    _template("mit", _MIT, "hereby granted free of charge", "substantial portions of the software", "without warranty of any kind"),
    _template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    _template("apache-2", _APACHE, "apache license version 2", "governing permissions and limitations"),
    _template("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license", "redistribute it and or modify"),
    _template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _template("gpl-2", _GPL.format(2), "gnu general public license", "either version 2 of the license"),
    _template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _template("gpl-3", _GPL.format(3), "gnu general public license", "either version 3 of the license"),
    _template("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    _template("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms", "following conditions are met"),
    _template("bsd", _BSD, "source and binary forms", "retain the above copyright notice", "reproduce the above copyright notice"),
    _template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products", "specific prior written permission"),
    _template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    *[
        _template(label, f"spdx license identifier {tag}", f"license identifier {tag}")
        for label, tag in (("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("unlicense", "unlicense"))
    ],
)

#: Share of a template's words that must stand in their places.
LEAST_SHARE = 0.8

#: What stands between words, as a pattern in SQL text.
_BREAK = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_PLACES = "cast(array() as array<int>)"


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    phrases = [t.text for t in templates] + [k for t in templates for k in t.keys] + list(BASE_PHRASES)
    return sorted({w for p in phrases for w in p.split()})


def _strings(values) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


def _words(text: str) -> str:
    """Words of a text in order; the first and the last entry are empty if marks stand there."""
    return f"split({text}, '{_BREAK}')"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def rarity(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every licence word, over all files (a fixed list of words)."""
    known = vocabulary(templates)
    present = f"array_intersect({_words(f'lower(cast({_name(text_col)} as string))')}, {_strings(known)})"
    counts = docs.selectExpr(f"explode({present}) as word").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    # the number of files would only shift all values alike, so it is not counted
    found = {row.word: row.n for row in counts}
    return {w: -math.log(found.get(w, 0) + 1) for w in known}


def _follows(at: str, phrase: str, first: int = 0) -> str:
    return " and ".join(f"get(words, {at} + {k}) = '{w}'" for k, w in enumerate(phrase.split()) if k >= first) or "true"


def _phrase_places(phrase: str) -> str:
    return f"filter(sequence(0, size(words) - 1), i -> {_follows('i', phrase)})"


def words_needed(n: int) -> int:
    """Words that must stand in their places for ``LEAST_SHARE`` of n."""
    return next(k for k in range(n + 1) if k / n >= LEAST_SHARE)


_INDEX = "array<struct<t:int,label:string,n:int,need:int,at:array<struct<w:string,at:int>>,keys:array<array<struct<w:string,at:int>>>>>"


def postings(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The index as one constant: of each template its words with their positions, rarest first, and its key phrases."""
    rows = []
    for t, template in enumerate(templates):
        own = template.text.split()
        rarest = sorted(range(len(own)), key=lambda i: (-idf[own[i]], -len(own[i]), i))
        keys = [[{"w": w, "at": k} for k, w in enumerate(key.split())] for key in template.keys]
        rows.append({"t": t, "label": template.label, "n": len(own), "need": words_needed(len(own)), "at": [{"w": own[i], "at": i} for i in rarest], "keys": keys})
    return f"from_json('{json.dumps(rows)}', '{_INDEX}')"


def _notices(index: str) -> str:
    """In SQL: ``array<struct<label, share>>`` of every place in ``words`` where a template is."""
    # of the positions whose word the file holds, so many of the rarest that any notice has one of them in place
    held = "filter(p.at, x -> array_contains(present, x.w))"
    rarest = f"transform(slice({held}, 1, greatest(size({held}) - p.need + 1, 0)), x -> named_struct('t', p.t, 'w', x.w, 'at', x.at))"
    chosen = f"flatten(transform({index}, p -> {rarest}))"
    places = "filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(wanted, x.w))"
    starts = "array_distinct(flatten(transform(places, x -> transform(filter(c, y -> y.w = x.w), y -> named_struct('t', y.t, 's', x.i - y.at)))))"
    keys = "forall(p.keys, key -> exists(sequence(b.s - 2, b.s + p.n + 2), i -> forall(key, k -> coalesce(get(words, i + k.at) = k.w, false))))"
    share = "size(filter(p.at, x -> get(words, b.s + x.at) = x.w)) / cast(p.n as double)"
    # transforms over arrays of one element bind a value that is used several times
    checked = f"get(transform(array(get({index}, b.t)), p -> named_struct('label', p.label, 'share', if({keys}, {share}, 0.0D))), 0)"
    found = f"filter(transform(starts, b -> {checked}), x -> x.share >= {LEAST_SHARE}D)"
    inner = f"get(transform(array({starts}), starts -> {found}), 0)"
    looked_up = f"get(transform(array(array_distinct(transform(c, y -> y.w))), wanted -> get(transform(array({places}), places -> {inner}), 0)), 0)"
    return f"get(transform(array({chosen}), c -> {looked_up}), 0)"


def scan(docs: DataFrame, idf: dict[str, float], id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    Base columns tell all places of ``BASE_PHRASES``; ``labels`` adds those of templates that
    are found, ``score`` is 1 with a base phrase, else the best template's share of words.
    Null and empty texts have no words and no labels. Files that lack a word of every key
    phrase are settled after one look at their words.
    """
    known = vocabulary(templates)

    def holds(phrases) -> str:
        wanted = sorted({w for p in phrases for w in p.split()})
        return "(" + " and ".join(f"array_contains(present, '{w}')" for w in wanted) + ")"

    possible = " or ".join(sorted({holds(t.keys) for t in templates} | {holds([p]) for p in BASE_PHRASES}))
    # generators of one row keep the words from being cut anew for every use
    source = docs.selectExpr(f"cast({_name(id_col)} as long) as id", f"coalesce(cast({_name(text_col)} as string), '') as text")
    cut = source.selectExpr("id", "text", f"explode(array({_words('lower(text)')})) as words")
    size = "size(words) - if(get(words, 0) = '', 1, 0) - if(element_at(words, -1) = '', 1, 0)"
    seen = cut.selectExpr("id", "text", f"cast(greatest({size}, 0) as long) as n_words", f"explode(array(array_intersect(words, {_strings(known)}))) as present")
    # exact lower case (A to Z only), and no empty entry before the first word
    exact = _words(f"regexp_replace(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '^{_BREAK}', '')")
    narrowed = seen.selectExpr("id", "n_words", "present", f"explode(array(if(size(present) > 0 and ({possible}), {exact}, null))) as words")
    base = ", ".join(f"if({holds([p])}, {_phrase_places(p)}, {_NO_PLACES})" for p in BASE_PHRASES)
    measured = narrowed.selectExpr("id", "n_words", f"explode(array(if(words is null, null, named_struct('base', array({base}), 'own', {_notices(postings(idf, templates))})))) as found")
    places = "flatten(found.base)"
    base_labels = f"filter(transform(found.base, (p, i) -> if(size(p) > 0, get({_strings(BASE_PHRASES.values())}, i), null)), x -> x is not null)"
    own_labels = "transform(found.own, x -> x.label)"
    best = "array_max(transform(found.own, x -> x.share))"
    return measured.selectExpr(
        "id",
        "n_words",
        f"cast(if(found is null, 0, size({places})) as long) as n_base",
        f"cast(array_min({places}) as long) as first_word",
        f"cast(array_max({places}) as long) as last_word",
        f"coalesce(array_join(sort_array(array_distinct({base_labels})), ','), '') as base_labels",
        f"coalesce(array_join(sort_array(array_distinct(concat({base_labels}, {own_labels}))), ','), '') as labels",
        f"case when found is null then 0.0D when size({places}) > 0 then 1.0D else coalesce({best}, 0.0D) end as score",
    )
