"""License scan by template-markup matching.

A template is wording with two kinds of markup: `[[ ... ]]` is optional, and `{{n}}` is replaceable by up to n
words. Templates compile to automata over words (a word, an optional branch, or a bounded gap), all joined in one
table that is entered at any word; a text is accepted where all mandatory wording stands consecutively and in order.

There are templates of whole licences, all clauses and disclaimers (weight 1), of the notices that files carry for longer ones (0.9), of notices that name a licence
(0.8), and of mentions (0.6). A text in which a word of a clause differs is no whole licence, though its notice may still count. The texts of the Apache, Mozilla and
GNU licences and of Creative Commons' legal code have no template of their own: files name them by notices.

After "SPDX-License-Identifier:" stands an expression of identifiers with AND, OR, WITH, brackets and +, up to the end of its line or the first word that can't go on
with it; each identifier is looked up whole, so that MIT-0 isn't MIT, and counts like a template (0.9). One that isn't in the table gives no label.

Words are runs of ASCII letters and digits and of code points from U+0080 on, after lower-casing A-Z only. Base phrases are templates
without markup. Null or empty text has no word and no label, an empty table no rows. Rows are independent, so repeats and ties give equal results.
Overlapping places all count. Very long texts are scanned whole: a word costs a look-up, a place that begins a template as many steps as words agree.
Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_texts

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WHOLE, BY_ID, OF_FILE, NOTICE, MENTION = 1.0, 0.9, 0.9, 0.8, 0.6

# The licences' own words.
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of
contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions
in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution"""
_BSD_NAMES = """[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission"""
_BSD_END = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any
way out of the use of this software even if advised of the possibility of such damage"""
_USE = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_USE_END = """the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the
use or performance of this software"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be
removed or altered from any source distribution"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that
recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law"""
_BOOST = """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the
software and to permit third parties to whom the software is furnished to do so all subject to the following"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use {{4}} except in compliance with the license you may obtain a copy of
the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
obtain one at [[http]] [[https]] mozilla org mpl 2 0"""
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
#: Label, what stands before "general public license", and its version.
_GNU = (("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.0", "library", "2"), ("lgpl-2.1", "lesser", "2 1"), ("lgpl-3.0", "lesser", "3"), ("agpl-3.0", "affero", "3"))
#: Label, and the words of its name.
_CREATIVE = (
    ("cc-by", ""), ("cc-by-sa", "sharealike"), ("cc-by-sa", "share alike"), ("cc-by-nd", "noderivatives"), ("cc-by-nd", "noderivs"), ("cc-by-nd", "no derivatives"),
    ("cc-by-nc", "noncommercial"), ("cc-by-nc", "non commercial"), ("cc-by-nc-sa", "noncommercial sharealike"), ("cc-by-nc-nd", "noncommercial noderivatives"),
)
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "BSD-3-Clause-Clear", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "MPL-2.0", "EPL-2.0", "Artistic-2.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
)


def _families() -> list[tuple[str, float, str]]:
    """Templates that follow a rule: the notices of the GNU licences and of Creative Commons."""
    out = []
    for label, kind, version in _GNU:
        name = f"{kind} general public license"
        out.append((label, NOTICE, f"gnu {name} [[as published by the free software foundation]] [[either]] version {version}"))
        out.append((label, NOTICE, f"gnu {name} v{version}"))
        short = {"": "gpl", "lesser": "lgpl", "affero": "agpl"}.get(kind)  # LGPLv2 alone also begins LGPLv2.1
        out += [(label, MENTION, f"{short}{v}{version}") for v in ("v", " v", " version ") if short]
        out.append((label, OF_FILE, f"this {{{{3}}}} {_FREE} {name} as published by the free software foundation [[either]] version {version} [[of the license]] [[or at your option any later version]] [[this]] {{{{3}}}} {_HOPE} see the gnu {name} for more details"))
    for label, words in _CREATIVE:
        out.append((label, NOTICE, f"creative commons attribution {words} [[{{{{1}}}} 0]] [[international]] [[unported]] [[public]] license"))
    return out


#: (label, weight of the evidence, template).
TEMPLATES = (
    ("mit", MENTION, "released under the [[terms of the]] mit license"),
    ("mit", NOTICE, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", WHOLE, f"{_MIT} {_AS_IS}"),
    ("apache-2.0", NOTICE, "licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", NOTICE, "apache license [[version]] 2 0 january 2004"),
    ("apache-2.0", OF_FILE, _APACHE),
    ("cc-by-nc", MENTION, "licensed under [[a]] [[the]] cc by nc [[{{1}} 0]]"),
    ("cc-by-sa", MENTION, "licensed under [[a]] [[the]] cc by sa [[{{1}} 0]]"),
    ("cc0", NOTICE, "to the extent possible under law {{12}} waived all copyright and related or neighboring rights to"),
    ("bsd", NOTICE, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", WHOLE, f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", WHOLE, f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("isc", WHOLE, f"{_USE} provided that the above copyright notice and this permission notice appear in all copies {_USE_END}"),
    ("0bsd", WHOLE, f"{_USE} {_USE_END}"),
    ("zlib", WHOLE, _ZLIB),
    ("bsl-1.0", WHOLE, f"""{_BOOST} the copyright notices in the software and this entire statement including the above license grant this restriction and the following
disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative
works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty
of any kind express or implied"""),
    ("unlicense", WHOLE, f"{_UNLICENSE} {_AS_IS}"),
    ("mpl-2.0", OF_FILE, _MPL),
    ("epl", NOTICE, "made available under the terms of the eclipse public license"),
    ("wtfpl", NOTICE, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("copyright", 0.5, "copyright [[c]] {{6}} all rights reserved"),
    *_families(),
)
BASE_WEIGHT = 0.4

_SPDX_MARK = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*")
_SPDX_TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.+-]*)")
_AND, _OR, _WITH, _OPEN, _SHUT = b"and", b"or", b"with", b"(", b")"


def _spdx_labels() -> dict[bytes, str]:
    """Labels of identifiers in lower case: those of the GNU family also with what follows a version, those of Creative Commons without their version."""
    out = {}
    for spdx in SPDX:
        label = re.sub("-4.0$|-1.0$", "", spdx.lower()) if spdx.startswith("CC") else spdx.lower()
        for end in ("", "-only", "-or-later") if "GPL" in spdx else ("",):
            out[(spdx.lower() + end).encode()] = label
    return out


def spdx_expressions(text: bytes) -> list[tuple[int, list[bytes]]]:
    """(place of the mark, identifiers) of each SPDX expression in a lower-case text."""
    out = []
    for mark in _SPDX_MARK.finditer(text):
        ids, depth, at, wanted = [], 0, mark.end(), True
        while m := _SPDX_TOKEN.match(text, at):
            token = m[1]
            if token == _OPEN and wanted:
                depth += 1
            elif token == _SHUT and not wanted and depth:
                depth -= 1
            elif not wanted and token in (_AND, _OR, _WITH):
                wanted = True
                if token == _WITH:  # the name of an exception, which is no licence
                    if not (exception := _SPDX_TOKEN.match(text, m.end())) or exception[1] in (_OPEN, _SHUT):
                        break
                    m, wanted = exception, False
            elif wanted and token not in (_SHUT, _AND, _OR, _WITH):
                ids.append(token.rstrip(b".").removesuffix(b"+"))
                wanted = False
            else:
                break
            at = m.end()
        out.append((mark.start(), ids))
    return out


@dataclass
class Automaton:
    """step[state][word] and gap[state] give next states; skip[state] states entered without a word; label of accepting states; closed[state] is what it reaches without a word."""

    step: list[dict[bytes, list[int]]]
    gap: list[list[int]]
    skip: list[list[int]]
    accepts: dict[int, tuple[int, str, float]]
    first: dict[bytes, list[int]]
    closed: list[frozenset[int]] = field(default_factory=list)


def _new(a: Automaton) -> int:
    a.step.append({})
    a.gap.append([])
    a.skip.append([])
    return len(a.step) - 1


def compile_templates(templates: tuple[tuple[str, float, str], ...]) -> Automaton:
    a = Automaton([], [], [], {}, {})
    for k, (label, weight, text) in enumerate(templates):
        at = start = _new(a)
        opened: list[int] = []
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", text):
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                end = _new(a)
                a.skip[at].append(end)
                a.skip[opened.pop()].append(end)
                at = end
            elif token.startswith("{{"):
                end = _new(a)
                for _ in range(int(token[2:-2])):
                    a.skip[at].append(end)
                    nxt = _new(a)
                    a.gap[at].append(nxt)
                    at = nxt
                a.skip[at].append(end)
                at = end
            else:
                nxt = _new(a)
                a.step[at].setdefault(token.encode(), []).append(nxt)
                at = nxt
        a.accepts[at] = (k, label, weight)
        for state in closure(a, {start}):
            if a.gap[state] or state in a.accepts:
                raise ValueError(f"a template must begin with a word: {text}")
            for word, to in a.step[state].items():
                a.first.setdefault(word, []).extend(to)
    a.closed = [frozenset(closure(a, {s})) for s in range(len(a.step))]
    return a


def closure(a: Automaton, states: set[int]) -> set[int]:
    out, todo = set(states), list(states)
    while todo:
        for s in a.skip[todo.pop()]:
            if s not in out:
                out.add(s)
                todo.append(s)
    return out


def places(a: Automaton, words: list[bytes]) -> list[tuple[int, int]]:
    """(start word, template number), each once, for every start from which a template is accepted."""
    found: set[tuple[int, int]] = set()
    if a.first.keys().isdisjoint(words):
        return []
    n = len(words)
    for i, word in enumerate(words):
        if word not in a.first:
            continue
        states, j = set().union(*(a.closed[s] for s in a.first[word])), i + 1
        while states:
            found |= {(i, a.accepts[s][0]) for s in states if s in a.accepts}
            if j == n:
                break
            states = set().union(*(a.closed[t] for s in states for t in (*a.step[s].get(words[j], ()), *a.gap[s])))
            j += 1
    return sorted(found)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, float, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places array<struct<word, label>>, n_base, first_word, last_word, base_labels, labels, score) of every row, in one map over whole texts.

    n_base, first_word and last_word speak of base phrases only. score is 1 - the product of (1 - weight) over distinct matched templates.
    """
    every = tuple((label, BASE_WEIGHT, phrase) for phrase, label in BASE) + tuple(templates)

    def make():
        automaton, by_id = compile_templates(every), _spdx_labels()

        def one(text: str) -> dict:
            raw = text.encode("utf-8", "surrogatepass").lower()
            words = _WORD.findall(raw)
            got = places(automaton, words)
            spdx = [(place, by_id[i]) for place, ids in spdx_expressions(raw) for i in ids if i in by_id]
            if spdx:
                begins = [m.start() for m in _WORD.finditer(raw)]
                spdx = [(bisect_left(begins, place), label) for place, label in spdx]
            base = [i for i, k in got if k < len(BASE)]
            rest = 1.0
            for k in sorted({k for _, k in got}):
                rest *= 1 - every[k][1]
            for _ in {label for _, label in spdx}:
                rest *= 1 - BY_ID
            return {
                "n_words": len(words),
                "places": [{"word": i, "label": label} for i, label in sorted([*((i, every[k][0]) for i, k in got), *spdx], key=lambda x: x[0])],
                "n_base": len(base),
                "first_word": min(base, default=None),
                "last_word": max(base, default=None),
                "base_labels": ",".join(sorted({every[k][0] for _, k in got if k < len(BASE)})),
                "labels": ",".join(sorted({every[k][0] for _, k in got} | {label for _, label in spdx})),
                "score": 1 - rest,
            }

        def work(texts: list[str]) -> dict[str, list]:
            rows = [one(t) for t in texts]
            return {k: [r[k] for r in rows] for k in (rows[0] if rows else ())}

        return work

    return map_texts(docs, make, "n_words bigint, places array<struct<word: bigint, label: string>>, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", id_col, text_col)
