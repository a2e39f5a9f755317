"""License scan by conditional compression.

Candidate blocks are the paragraphs with a licensing cue, whole, with line breaks as
spaces; a line without words ends a paragraph.  Each block is compressed alone and
with every template as a raw zstandard dictionary; templates are ranked by the share
of bytes that the dictionary saves.  Down this ranking, every template that stands
somewhere in the block, with exact wording differences within its tolerance, is
confirmed and takes its words from the templates after it.  Numbers and the words that tell licenses apart may not differ.  The templates
of SPDX lines are ranked only in blocks with an SPDX marker.

Defined results: null or empty text has no block and no license; a block that no
template confirms counts as a block and leaves the best-ranked template as
``closest``; repeated rows repeat; other columns are ignored."""

from __future__ import annotations

import difflib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries

# Identifiers, kinds and common wordings of license notices.
TEMPLATES = [
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "no-derivatives", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "public-domain", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("all-rights-reserved", "reserved", "All rights reserved."),
]
# The GNU project's notices; the first two name the version before its publisher.
_GNU = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}General Public "
        "License {version} as published by the Free Software Foundation")
_GNU_LATER = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General "
              "Public License as published by the Free Software Foundation, either version {version} of the License, or (at your "
              "option) any later version.")
for _id, _name, _what in (("GPL", "", "program"), ("LGPL", "Lesser ", "library"), ("LGPL", "Library ", "library"),
                          ("AGPL", "Affero ", "program")):
    for _version in {"": ("2", "3"), "Lesser ": ("2.1", "3"), "Library ": ("2",), "Affero ": ("3",)}[_name]:
        _full = _version if "." in _version else _version + ".0"
        TEMPLATES.append((f"{_id}-{_full}-or-later", "copyleft", _GNU_LATER.format(what=_what, name=_name, version=_version)))
        for _given in (f"version {_version}", f", version {_version},"):
            TEMPLATES.append((f"{_id}-{_full}-only", "copyleft", _GNU.format(what=_what, name=_name, version=_given)))
TEMPLATES = list({" ".join(re.findall(r"\w+", t[2].lower())): t for t in reversed(TEMPLATES)}.values())[::-1]
# Kinds of SPDX identifiers.
SPDX = {
    "permissive": "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
                  "BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BlueOak-1.0.0 ISC MIT MIT-0 NCSA OFL-1.1 OpenSSL PHP-3.01 "
                  "PostgreSQL Python-2.0 PSF-2.0 UPL-1.0 W3C X11 Zlib",
    "copyleft": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 EPL-1.0 "
                "EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only "
                "GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 "
                "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 MS-RL OSL-3.0",
    "attribution": "CC-BY-3.0 CC-BY-4.0",
    "non-commercial": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0",
    "no-derivatives": "CC-BY-ND-4.0",
    "public-domain": "CC0-1.0 Unlicense WTFPL",
}
TEMPLATES += [(i, kind, f"SPDX-License-Identifier: {i}") for kind, ids in SPDX.items() for i in ids.split()]
# The older spelling of "or later".
TEMPLATES += [(f"{i}-or-later", "copyleft", f"SPDX-License-Identifier: {i}+") for i in
              "AGPL-3.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0".split()]
_CUE = re.compile(rb"licen[sc]|copyright|\xc2\xa9|rights reserved|spdx|warranty|permission|redistribut|creative commons"
                  rb"|public domain|\bcc[ -]by|\bcc0|public license", re.I)
_PARAGRAPH_END = re.compile(r"\n[\W_]*\n")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*\+?")
SPDX_MARKER = "spdx-license-identifier"
#: Words that tell one license from another; as little as a number may they be missing or foreign.
TELLING = frozenset("lesser library affero gnu mozilla apache mit bsd isc cc by nc sa nd non noncommercial not".split())
#: A template may miss one word in this many; shorter templates must be complete.
WORDS_PER_DIFFERENCE = 20
LEVEL = 3

SCHEMA = ("doc_id long, n_blocks long, licenses string, license string, kind string, closest string, "
          "n_differences long, saved double")


def words(text: str) -> list[str]:
    """Lower-case words; each identifier of an SPDX expression stands behind a marker of its own."""
    out = _WORD.findall(text.lower())
    inside = 0  # 1: an identifier is next, 2: an operator may be next, 3: an exception is next
    for at, w in enumerate(out):
        if w == SPDX_MARKER:
            inside = 1
        elif inside == 2 and w in ("or", "and"):
            out[at] = SPDX_MARKER
            inside = 1
        elif inside == 2 and w == "with":
            inside = 3
        else:
            inside = 2 if inside in (1, 3) else 0
    return out


def candidate_blocks(text: bytes | None) -> list[str]:
    """Paragraphs with a cue, in text order, each on one line."""
    if not text or not _CUE.search(text):
        return []
    parts = _PARAGRAPH_END.split(text.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
    return [" ".join(x.split()) for x in parts if _CUE.search(x.encode())]


#: Stands for a word of a confirmed notice; no word is a line break.
TAKEN = "\n"


def _tells(word: str) -> bool:
    return word == TAKEN or word in TELLING or any(c.isdigit() for c in word)


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(i, kind, words(body)) for i, kind, body in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                " ".join(t[2]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.templates]

    @staticmethod
    def differences(template: list[str], block: list[str]):
        """Template words the block lacks, foreign words between those it has, and where
        the match stands in the block."""
        ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()
        ops = [o for o in ops if o.size]
        if not ops:
            return template, [], (0, 0)
        missing, foreign, i, j = [], [], 0, ops[0].b
        for o in ops:
            missing += template[i:o.a]
            foreign += block[j:o.b]
            i, j = o.a + o.size, o.b + o.size
        return missing + template[i:], foreign, (ops[0].b, j)

    def _judge(self, template: list[str], own: list[str], low: int, high: int, allowed: int):
        """``(differences, start, end)`` of the template in ``own[low:high]``, None beyond ``allowed``."""
        missing, foreign, (i, j) = self.differences(template, own[low:high])
        if len(missing) > allowed or len(foreign) > allowed or any(map(_tells, missing + foreign)):
            return None
        return len(missing) + len(foreign), low + i, low + j

    def take_all(self, template: list[str], own: list[str], where: dict[str, list[int]]):
        """Every stand of the template, best first (fewest differences, then earliest), each on
        words of its own, which become ``TAKEN``.
        A match with ``allowed`` missing and foreign words has one of 2 * allowed + 1
        pieces unbroken, so only the surroundings of such pieces are compared; a stand is
        compared again only when words of its surroundings were taken."""
        size = len(template)
        allowed = size // WORDS_PER_DIFFERENCE
        cuts = [size * k // (2 * allowed + 1) for k in range(2 * allowed + 2)]
        stands: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # surroundings -> unbroken pieces
        for x, y in zip(cuts[:-1], cuts[1:]):
            piece = template[x:y]
            k = min(range(len(piece)), key=lambda k: len(where.get(piece[k], ())))  # the rarest word
            for at in where.get(piece[k], ()):
                at -= k
                if at >= 0 and own[at:at + len(piece)] == piece:
                    stands.setdefault((max(at - x - allowed, 0), at + size - x + allowed), []).append((at, x, y))
        places = sorted(stands)
        now = {p: self._judge(template, own, *p, allowed) for p in places}
        heap = [(got, p) for p, got in now.items() if got]
        heapq.heapify(heap)
        out = []
        while heap:
            got, p = heapq.heappop(heap)
            if now[p] != got:
                continue
            out.append(got)
            _, start, end = got
            own[start:end] = [TAKEN] * (end - start)
            for q in places[bisect_left(places, (start - size - 2 * allowed, 0)):bisect_left(places, (end, 0))]:
                if q[1] <= start:
                    continue
                whole = any(own[at:at + y - x] == template[x:y] for at, x, y in stands[q])
                again = self._judge(template, own, *q, allowed) if whole else None
                if again != now[q]:
                    now[q] = again
                    if again:
                        heapq.heappush(heap, (again, q))
        return out

    def scan_all(self, block: str):
        """``(closest index, its saved share, [(index, differences, saved share), ...])`` with
        every confirmed template, each on words of its own, in the order of the ranking."""
        own = words(block)
        data = " ".join(own).encode()
        alone = len(self.plain.compress(data))
        where: dict[str, list[int]] = {}
        for at, w in enumerate(own):
            where.setdefault(w, []).append(at)
        used = [i for i, (_, _, t) in enumerate(self.templates) if t[0] != SPDX_MARKER or SPDX_MARKER in where]
        saved = {i: (alone - len(self.given[i].compress(data))) / alone for i in used}
        ranked = sorted(used, key=lambda i: (-saved[i], i))
        won = []
        for i in ranked:
            taken = self.take_all(self.templates[i][2], own, where)
            if taken:
                won.append((i, taken[0][0], saved[i]))
        return ranked[0], saved[ranked[0]], won

    def scan(self, block: str):
        """``(winner index or None, closest index, differences, saved share)`` of the best-ranked confirmed template."""
        closest, share, won = self.scan_all(block)
        if won:
            return won[0][0], closest, *won[0][1:]
        return None, closest, 0, share


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES) -> DataFrame:
    """One row per document: its candidate blocks, the distinct confirmed licenses,
    the one with the largest saving (with kind, word differences and saved share) and,
    if none is confirmed, the closest template."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for text in binaries(b.column(1)):
                got = [scanner.scan_all(x) for x in candidate_blocks(text)]
                won = sorted((w for g in got for w in g[2]), key=lambda w: (-w[2], w[0]))
                names = ",".join(sorted({scanner.templates[g[0]][0] for g in won}))
                if won:
                    i, diff, saved = won[0]
                    rows.append((len(got), names, scanner.templates[i][0], scanner.templates[i][1], None, diff, saved))
                elif got:
                    near = max(got, key=lambda g: g[1])
                    rows.append((len(got), "", None, None, scanner.templates[near[0]][0], None, near[1]))
                else:
                    rows.append((0, "", None, None, None, None, None))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.float64()]
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                  names=["doc_id", "n_blocks", "licenses", "license", "kind", "closest",
                                         "n_differences", "saved"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
