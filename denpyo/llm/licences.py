"""Licence scans by sentence rules.

Texts are cut into pieces, at line ends and after . ! ? ; before white space. A piece, or a run of pieces that
only single line breaks part (wrapped text), is known where its normalised form
(lower-case letters and digits, single spaces) is that of a known sentence, which maps to an identifier; a rule
is a sequence of identifiers, which must come in order with at most `gap` other sentences between
two of them. Rules with more sentences go first, matches of all rules do not overlap in known sentences.

A null or empty text has no matches. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import sliced
from .tables import fresh, read, small_batches

# Known sentences by identifier.
SENTENCES = {
    "mit-ref": "Released under the MIT License",
    "mit-ref-2": "Licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-ref-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc0-ref": "Licensed under CC0 1.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free": "This program is free software",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "version-2-later": "either version 2 of the License, or (at your option) any later version",
    "version-21-later": "either version 2.1 of the License, or (at your option) any later version",
    "version-3-later": "either version 3 of the License, or (at your option) any later version",
    "lgpl-free": "This library is free software",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
# Licences by ordered sentences.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-ref",)), ("MIT", ("mit-ref-2",)), ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-ref-the", "apache-use", "apache-copy")), ("Apache-2.0", ("apache-ref-the",)), ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-warranty")), ("GPL-3.0-or-later", ("gpl-grant",)), ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)), ("CC-BY-4.0", ("cc-by-ref",)), ("CC-BY-SA-4.0", ("cc-by-sa-ref",)), ("CC0-1.0", ("cc0-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title-the", "mit-grant", "mit-notice")), ("MIT", ("mit-title-2", "mit-grant", "mit-notice")), ("MIT", ("mit-title-the",)), ("MIT", ("mit-title-2",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "version-2-later")), ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "version-3-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "version-21-later")), ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-terms", "version-3-later")),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)), ("AGPL-3.0-or-later", ("agpl3-grant",)), ("MPL-2.0", ("mpl-form",)),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-and",)), ("Unlicense", ("unlicense",)),
)

_CUT = re.compile(r"[^\S\n]*\n\s*|(?<=[.!?;])\s+")


def normalise(sentence: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", sentence.lower()))


class Scanner:
    def __init__(self, sentences: dict[str, str] | None = None, rules: tuple | None = None, gap: int = 1):
        self.known = {normalise(s): k for k, s in (sentences or SENTENCES).items()}
        self.rules = sorted(rules or RULES, key=lambda r: -len(r[1]))
        self.gap = gap
        self.starts = {" ".join(w[:i]) for w in (n.split() for n in self.known) for i in range(1, len(w) + 1)}
        # A word of each sentence, the longest: a text without any of them has no known sentence.
        self.anchors = tuple({max(n.split(), key=len) for n in self.known})

    def sentences(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and text of each piece."""
        at = 0
        for m in _CUT.finditer(text):
            if m.start() > at:
                yield at, m.start(), text[at : m.start()]
            at = m.end()
        if at < len(text):
            yield at, len(text), text[at:]

    def marked(self, text: str) -> list[tuple[int, int, int, str]]:
        """Sentence number, start, end and identifier of each known sentence, the longest at each place.

        Other pieces count as one sentence up to a piece that ends one, a blank line or a known sentence.
        """
        pieces = [(s, e, normalise(x)) for s, e, x in self.sentences(text)]
        last = len(pieces) - 1
        ends = [i == last or not n or not pieces[i + 1][2] or text[e - 1] in ".!?;" or text.count("\n", e, pieces[i + 1][0]) > 1 for i, (_, e, n) in enumerate(pieces)]
        out, number, inside, i = [], 0, False, 0
        while i <= last:
            run, best = "", None
            for j in range(i, last + 1):
                run = f"{run} {pieces[j][2]}".strip()
                if run not in self.starts:
                    break
                best = j if run in self.known else best
                if best == j:
                    name = self.known[run]
                if ends[j]:
                    break
            if best is None:
                inside = bool(pieces[i][2]) or inside
                if ends[i]:
                    number, inside = number + inside, False
                i += 1
                continue
            number += inside
            out.append((number, pieces[i][0], pieces[best][1], name))
            number, inside, i = number + 1, False, best + 1
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, start, end) of each match, by start; offsets in code points."""
        low = (text or "").lower()
        if not any(a in low for a in self.anchors):
            return []
        marked = self.marked(text)
        used, found = set(), []
        for licence, sequence in self.rules:
            for first in range(len(marked)):
                if first in used or marked[first][3] != sequence[0]:
                    continue
                chain = [first]
                for want in sequence[1:]:
                    nxt = next((j for j in range(chain[-1] + 1, len(marked)) if marked[j][0] - marked[chain[-1]][0] > self.gap + 1 or (j not in used and marked[j][3] == want)), None)
                    if nxt is None or marked[nxt][0] - marked[chain[-1]][0] > self.gap + 1:
                        break
                    chain.append(nxt)
                if len(chain) == len(sequence):
                    used.update(chain)
                    found.append((licence, marked[chain[0]][1], marked[chain[-1]][2]))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), scanner: Scanner | None = None) -> DataFrame:
    """`keep` and matches (array of licence, start, end; replaces a column of that name) of each row."""
    scanner = scanner or Scanner()
    small_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c != "matches")
    name = fresh(keep, "t")
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(name))
    kind = "array<struct<licence:string,start:int,end:int>>"
    schema = source.drop(name).withColumn("matches", F.expr(f"cast(array() AS {kind})")).schema
    arrow = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, name):
                found = [[dict(zip(("licence", "start", "end"), m)) for m in scanner.scan(t)] for t in part.column(name).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, arrow)], names=[*keep, "matches"])

    return source.mapInArrow(run, schema)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["start"].cast("string"), m["end"].cast("string")))
    licences = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(licences, ",").alias("licences"), F.array_join(spans, ",").alias("spans"))
