"""License notices in texts by patience alignment.

A template's words are aligned with a stretch of text: words that occur once in both are anchors, the longest sequence
of them that rises in both is kept, and the gaps between anchors are aligned in the same way, down to equal ends. The
coverage is the share of the template's words that are aligned. Stretches start where enough of a template's
words, repeated ones counted as often, stand close together, so any number of notices in a text of any length is found.
Templates are notices (one line or a header) and the whole texts in ``license_texts``, read on the driver alone.

Null and empty texts have no notice. Every row gives one row, also without or with repeated ids; of notices that cover
the same words the one with more aligned words stays, of equal ones the better covered, then the first by name. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import columns, emit

WORD = re.compile(r"[^\W_]+")

# Short notices and the opening terms of common licenses; those of Creative Commons and of the GNU family are added below.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                 "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
                 "the following conditions:",
    "MIT notice": "Licensed under the MIT License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

CC_FORMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _form, _words in CC_FORMS.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _scope = {"4.0": " International", "3.0": " Unported"}.get(_version, "")
        TEMPLATES[f"CC-{_form}-{_version} short"] = f"Licensed under CC {_form} {_version}."
        TEMPLATES.setdefault(f"CC-{_form}-{_version}", f"This work is licensed under the Creative Commons {_words} {_version}{_scope} License.")
for _name, _words, _versions in (("GPL", "General", ("2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("AGPL", "Affero General", ("3.0",))):
    for _version in _versions:
        _short = _version.removesuffix(".0")
        TEMPLATES.setdefault(f"{_name}-{_version}", f"This work is licensed under the GNU {_words} Public License, version {_short}.")
        TEMPLATES.setdefault("GPL header" if (_name, _version) == ("GPL", "3.0") else f"{_name}-{_version} header", TEMPLATES["GPL header"].replace(
            "GNU General", f"GNU {_words}").replace("version 3", f"version {_short}"))
# Words that many texts hold; they serve last to tell which templates a text may hold.
USUAL = set("a an and any are as at be by for from in is it its may no not of on or that the these this to under with work license licensed version".split())


def all_templates() -> dict[str, str]:
    """The notices and the whole texts."""
    texts = {f"{f.name.removesuffix('.txt')} text": f.read_text("utf-8") for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | texts


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in its second part too, by patience sorting; pairs come by their first part."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of aligned words, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[k]: k for k in range(b0, b1) if in_b[b[k]] == 1}
        anchors = rising([(k, place[a[k]]) for k in range(a0, a1) if in_a[a[k]] == 1 and a[k] in place])
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(found)


def template_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Wanted:
    """Templates with what a text must hold of each."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.templates, self.least = templates, least
        self.counts = {name: Counter(ws) for name, ws in templates.items()}
        # Words of a template that have to be aligned; no alignment has more than the words in common.
        self.need = {name: max(1, math.ceil(least * len(ws) - 1e-9)) for name, ws in templates.items()}
        # Of some words of a template, more than may be missing, a text must hold one.
        self.keys: dict[str, list[str]] = {}
        for name, ws in templates.items():
            spare = len(ws) - self.need[name]
            for w in sorted(self.counts[name], key=lambda w: (w in USUAL or w.isdigit(), -len(w), w)):
                self.keys.setdefault(w, []).append(name)
                spare -= self.counts[name][w]
                if spare < 0:
                    break

    def possible(self, text: str) -> list[str]:
        """Templates of which a text has enough words, wherever they stand."""
        words = WORD.findall(text.lower())
        names = {name for w in self.keys.keys() & set(words) for name in self.keys[w] if self.need[name] <= len(words)}
        if not names:
            return []
        have = Counter(words)
        return [name for name in self.templates if name in names and sum(min(n, have[w]) for w, n in self.counts[name].items()) >= self.need[name]]


def notices(text: str, templates: dict[str, list[str]] | Wanted, least: float) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, aligned words, start, end) of the notices in a text, in code points, by start."""
    wanted = templates if isinstance(templates, Wanted) else Wanted(templates, least)
    names = wanted.possible(text)
    if not names:
        return []
    vocabulary = {w for name in names for w in wanted.counts[name]}
    places, spans = [], {}
    for n, m in enumerate(WORD.finditer(text)):
        w = m[0].lower()
        if w in vocabulary:
            places.append((n, w))
            spans[n] = m.span()
    found = []
    for name in names:
        ws, own, need = wanted.templates[name], wanted.counts[name], wanted.need[name]
        near, reach = [(k, w) for k, w in places if w in own], len(ws) + len(ws) // 2 + 2
        have: Counter = Counter()
        i = j = common = 0
        # After an alignment that failed: the place up to which words must enter before another can succeed.
        wait = 0
        while i < len(near):
            while j < len(near) and near[j][0] < near[i][0] + reach:
                w = near[j][1]
                have[w] += 1
                common += have[w] <= own[w]
                j += 1
            after = i + 1
            if common >= need and j >= wait:
                stretch = near[i:j]
                pairs = align(ws, [w for _, w in stretch])
                if len(pairs) >= need:
                    start, end = stretch[pairs[0][1]][0], stretch[pairs[-1][1]][0]
                    found.append((name, len(pairs) / len(ws), len(pairs), spans[start][0], spans[end][1]))
                    after = i + pairs[-1][1] + 1
                else:
                    # Every word that enters aligns at most one more; half as many, since the anchors chosen need not be the best.
                    wait = j + max(1, (need - len(pairs)) // 2)
            for _, w in near[i:after]:
                common -= have[w] <= own[w]
                have[w] -= 1
            i = after
    found.sort(key=lambda f: (-f[2], -f[1], f[0], f[3]))
    kept: list[tuple] = []
    for f in found:
        if all(f[4] <= k[3] or k[4] <= f[3] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, notices (license, coverage, aligned, start, end)."""
    split = {name: template_words(text) for name, text in sorted((templates or all_templates()).items())}
    wanted = Wanted({name: ws for name, ws in split.items() if ws}, least)
    schema = pa.schema([("doc_id", pa.int64()), ("notices", pa.list_(pa.struct([
        ("license", pa.string()), ("coverage", pa.float64()), ("aligned", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("license", "coverage", "aligned", "start", "end")
        yield from emit(((i, [dict(zip(names, f)) for f in notices(t or "", wanted, least)]) for i, t in columns(batches)), schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, notices array<struct<license:string,coverage:double,aligned:long,start:long,`end`:long>>")
