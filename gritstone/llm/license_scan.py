"""License scan: template markup compiled to token automata.

A template is words with two kinds of markup:

* ``[[ ... ]]``    an optional region, which may be left out (regions may nest);
* ``{{min,max}}``  a replaceable region of that many words, whatever they are.

All other words are mandatory and must match exactly. A compiled template is a position automaton
whose states fit one integer, simulated over the words of a text from every place where a first
word of the template stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_or_null, mapped, words_of

#: Fixed values of the contract: phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The wording of public licenses and notices, with what may vary marked up. A template's label is given
#: where all of its mandatory words stand; changed, missing or added words elsewhere reject it.
TEMPLATES = {
    # Notices that name a license.
    "gpl-3.0": "licensed under [[the terms of]] the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-2.0": "licensed under [[the terms of]] the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 2",
    "apache-2.0": "licensed under the apache license [[software foundation]] version 2 [[0]]",
    "mit-named": "released under the [[terms of the]] mit license",
    "cc-by-nc-4.0": "licensed under [[a]] cc by nc 4 0",
    "cc-by-4.0": "licensed under [[a]] creative commons attribution [[{{0,2}} ]] 4 0 [[international]] license",
    "all-rights-reserved": "copyright [[c]] {{1,6}} all rights reserved",
    # Whole grants and notices.
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the {{1,12}} be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]""",
    "isc": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies
        [[the software is provided as is and {{1,8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness]]""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution
        [[3]] neither the name of {{1,12}} nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http [[s]] www apache org licenses license 2 0
        [[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license]]""",
    "gpl-3.0-notice": """is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or [[at your option]] any later version""",
    "gpl-2.0-notice": """is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 2 of the license or [[at your option]] any later version""",
    "lgpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu [[library]] [[lesser]] general public license
        as published by the free software foundation either version {{1,2}} of the license or [[at your option]] any later version""",
    "agpl-3.0-notice": """is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
        as published by the free software foundation either version 3 of the license or [[at your option]] any later version""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at http [[s]] mozilla org mpl 2 0""",
    "unlicense": """this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
        for any purpose commercial or non commercial and by any means""",
}


class Template:
    """A position automaton. State k stands before cell k; ``skips`` holds its empty moves."""

    def __init__(self, markup: str):
        self.cells: list[bytes | None] = []  # a word, or None for any word
        jumps: dict[int, set[int]] = {}
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(len(self.cells))
            elif part == "]]":
                jumps.setdefault(opened.pop(), set()).add(len(self.cells))
            elif part.startswith("{{"):
                low, high = map(int, part[2:-2].split(","))
                for k in range(high):
                    if k >= low:
                        jumps.setdefault(len(self.cells), set()).add(len(self.cells) + high - k)
                    self.cells.append(None)
            else:
                self.cells.append(part.encode())
        if opened or not any(self.cells):
            raise ValueError(f"a template needs balanced regions and a mandatory word: {markup}")
        self.end = 1 << len(self.cells)
        # Empty moves go forward only, so one sweep from the right closes them.
        self.closure = [1 << k for k in range(len(self.cells) + 1)]
        for k in range(len(self.cells), -1, -1):
            for to in jumps.get(k, ()):
                self.closure[k] |= self.closure[to]
        if self.closure[0] & self.end:
            raise ValueError(f"a template must not accept nothing: {markup}")
        self.any, self.by_word = 0, {}
        for k, cell in enumerate(self.cells):
            if cell is None:
                self.any |= 1 << k
            else:
                self.by_word[cell] = self.by_word.get(cell, 0) | 1 << k
        self.first = {c for k, c in enumerate(self.cells) if self.closure[0] >> k & 1}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``; -1 for none."""
        state, found = self.closure[0], -1
        for k in range(at, len(words)):
            moving = state & (self.by_word.get(words[k], 0) | self.any)
            if not moving:
                break
            state = 0
            while moving:
                low = moving & -moving
                state |= self.closure[low.bit_length()]
                moving ^= low
            if state & self.end:
                found = k + 1
        return found


class Scanner:
    """Several templates, tried only where one of their first words stands."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.compiled = [(label, Template(markup)) for label, markup in templates]
        self.starts: dict[bytes, list[int]] = {}
        self.anywhere = [k for k, (_, t) in enumerate(self.compiled) if None in t.first]
        for k, (_, t) in enumerate(self.compiled):
            for word in t.first - {None}:
                self.starts.setdefault(word, []).append(k)
        self.triggers = set(self.starts)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, end, number of the template) of every place, by start."""
        if not self.anywhere and self.triggers.isdisjoint(words):
            return []
        found, starts = [], self.starts
        for at, word in enumerate(words):
            for k in (*starts.get(word, ()), *self.anywhere):
                end = self.compiled[k][1].longest(words, at)
                if end >= 0:
                    found.append((at, end, k))
        return found


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``base`` maps phrases to labels, ``templates`` labels to markup; both compile to the same
    automata. n_base counts every place of every base phrase, first_word and last_word are their smallest and
    largest start (null for none). score is 0 for no license wording, 0.5 for base phrases only, and
    more the larger the share of base places that lie in a template's span; a template without a base
    place scores 1. Null and empty texts have no words. Whole texts are scanned, however long. Repeated rows stay,
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    n_base_templates = len(base)
    source = docs.select(column_or_null(docs, id_col, "bigint").alias("doc_id"), column_or_null(docs, text_col, "binary").alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner([(label, phrase) for phrase, label in base.items()] + list(templates.items()))
        label = [x for x, _ in scanner.compiled]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = scanner.find(words)
                plain = [x for x in found if x[2] < n_base_templates]
                own = [x for x in found if x[2] >= n_base_templates]
                inside = sum(any(a <= s and e <= b for a, b, _ in own) for s, e, _ in plain)
                score = 0.0 if not found else 1.0 if not plain else 0.5 + 0.5 * inside / len(plain)
                rows.append((
                    len(words), len(plain), plain[0][0] if plain else None, plain[-1][0] if plain else None,
                    ",".join(sorted({label[k] for _, _, k in plain})), ",".join(sorted({label[k] for _, _, k in found})), score,
                    [{"start": s, "end": e, "label": label[k]} for s, e, k in found],
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=names)

    return mapped(
        source, run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"
    )
