"""Licence scans by sentence rules.

A text is cut into paragraphs (at lines without letters or digits), lines and
parts of lines (after ``.``, ``!``, ``?`` or ``;`` and a space). A sentence is a
part, or parts of following lines of a paragraph, up to one that such a mark
ends: a known sentence takes as many parts as it can. A sentence that holds a licence word is normalised:
lower case, words and version numbers only, one space between them. Known
sentences map to identifiers, by equality or, where a sentence has a free part
(a holder's name, a year), by a pattern that begins with a fixed word. The
document's identifiers in order are matched against ordered rules: a rule is a
sequence of identifiers that must come in that order, with other identifiers
between them at most ``gap`` places apart; longer rules win, and identifiers
that a rule took serve no other. Licence-like sentences that are not known are
counted, so that unknown licences show.

Everything is row by row. The tables of sentences and rules are parameters of
fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from finquery.llm.scratch import with_columns_of
from finquery.llm.words import slices

#: Words of which a licence sentence holds one. Fixed values.
HINT = r"licen[cs]|copyright|permission|redistribut|warrant|spdx|free and unencumbered|extent possible under law|all{0}rights{0}reserved|public{0}domain|©".replace("{0}", r"(?: |\s*[\r\n]\W*)")

#: Normalised sentences -> identifier. Fixed values.
SENTENCES = {
    "released under the mit license": "mit-ref", "licensed under the mit license": "mit-ref", "this project is licensed under the mit license": "mit-ref", "spdx license identifier mit": "mit-spdx",
    "the mit license": "mit-title", "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "licensed under the apache license version 2.0": "apache2-ref", "licensed under the apache license version 2.0 the license": "apache2-ref", "spdx license identifier apache 2.0": "apache2-spdx",
    "you may not use this file except in compliance with the license": "apache-use", "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref", "licensed under the gnu general public license version 3": "gpl3-ref", "this work is licensed under the gnu general public license version 2": "gpl2-ref", "licensed under the gnu general public license version 2": "gpl2-ref", "spdx license identifier gpl 3.0": "gpl3-spdx",
    "this program is free software": "gpl-free", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "licensed under cc by nc 4.0": "ccbync4-ref", "licensed under cc by 4.0": "ccby4-ref", "licensed under cc by sa 4.0": "ccbysa4-ref", "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-ref", "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-ref", "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary", "licensed under the bsd license": "bsd-ref", "licensed under the mozilla public license version 2.0": "mpl2-ref",
    "all rights reserved": "reserved", "this work is in the public domain": "pd-ref",
}
#: More sentences of licence texts. Fixed values.
SENTENCES |= {
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-asis",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liable", "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liable",
    "loss of use data or profits": "bsd-loss", "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-advised",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-asis",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liable",
    "this is free and unencumbered software released into the public domain": "unlicense-free", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form", "this source code form is subject to the terms of the mozilla public license version 2.0": "mpl2-form",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope", "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope", "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "this library is free software": "gpl-free", "cc 0 1.0 universal": "cc0-title", "apache license version 2.0 january 2004": "apache2-ref", "isc license": "isc-title", "the unlicense": "unlicense-title", "eclipse public license v 2.0": "epl2-ref",
}
#: The family of the GNU licences: name, version, identifier of the licence, date of its text. Fixed values.
GNU = (
    ("general public license", "2", "GPL-2.0", "june 1991"), ("general public license", "3", "GPL-3.0", "29 june 2007"), ("lesser general public license", "2.1", "LGPL-2.1", "february 1999"), ("lesser general public license", "3", "LGPL-3.0", "29 june 2007"), ("affero general public license", "3", "AGPL-3.0", "19 november 2007"),
)
#: Licences by names that a sentence may give them. Fixed values.
NAMES = {
    "MIT": ("mit license",), "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"), "BSD": ("bsd license",), "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"), "BSD-3-Clause": ("bsd 3 clause license", "new bsd license"), "ISC": ("isc license",), "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0"), "EPL-1.0": ("eclipse public license version 1.0", "eclipse public license 1.0"), "GPL-2.0": ("gnu general public license version 2", "gnu general public license v 2.0", "gnu gpl v 2", "gpl v 2"), "GPL-3.0": ("gnu general public license version 3", "gnu general public license v 3.0", "gnu gpl v 3", "gpl v 3"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "lgpl v 2.1"), "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v 3"), "AGPL-3.0": ("gnu affero general public license version 3", "agpl v 3"), "Unlicense": ("unlicense",), "CC0-1.0": ("cc 0 1.0", "cc 0 1.0 universal", "creative commons zero v 1.0 universal"), "BSL-1.0": ("boost software license version 1.0",), "Zlib": ("zlib license",),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0 international license"), "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"), "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"), "CC-BY-ND-4.0": ("cc by nd 4.0",), "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",), "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",),
}
#: What a sentence that names a licence says of it. Fixed values.
FRAMES = ("licensed under the {}", "licensed under {}", "licensed under a {}", "released under the {}", "released under {}", "distributed under the {}", "available under the {}", "made available under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "this work is licensed under a {}", "this software is licensed under the {}", "this file is licensed under the {}", "this project is released under the {}", "this software is released under the {}", "use of this source code is governed by the {}")
#: Identifiers that may follow ``SPDX-License-Identifier:``. Fixed values.
SPDX = "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim WTFPL X11 Zlib ZPL-2.1".split()
WORD = r"[a-z]+(?:/[a-z]+)?|[0-9]+(?:\.[0-9]+)*"


def generated() -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Sentences that follow a rule, and the rules for them."""
    sentences, rules = {}, []
    for name, version, licence, date in GNU:
        terms = f"redistribute it and/or modify it under the terms of the gnu {name}"
        by = "as published by the free software foundation"
        later, only = f"{licence}-later", f"{licence}-only"
        for what in ("this program", "this library", "this file", "this software"):
            for start in (f"{what} is free software you can ", "you can "):
                sentences[f"{start}{terms} {by} either version {version} of the license or at your option any later version"] = later
                sentences[f"{start}{terms} version {version} {by}"] = sentences[f"{start}{terms} {by} version {version}"] = sentences[f"{start}{terms} {by} version {version} of the license"] = only
            sentences[f"you should have received a copy of the gnu {name} along with {what}"] = "gpl-copy"
        sentences[f"see the gnu {name} for more details"] = "gpl-see"
        sentences[f"gnu {name} version {version} {date}"] = f"{licence}-title"
        rules += [(f"{licence}-or-later", "text", (later,)), (f"{licence}-only", "text", (only,)), (licence, "reference", (f"{licence}-title",))]
    for licence, names in NAMES.items():
        rules.append((licence, "reference", (f"{licence}-named",)))
        sentences |= {frame.format(name): f"{licence}-named" for frame in FRAMES for name in names}
    for licence in SPDX:
        rules.append((licence, "reference", (f"spdx-{licence}",)))
        sentences["spdx license identifier " + " ".join(regex.findall(WORD, licence.lower()))] = f"spdx-{licence}"
    return sentences, rules


#: Sentences with a free part: (first word, pattern, identifier). Fixed values.
PATTERNS = (
    ("if", r"if a copy of the mpl was not distributed with this file you can obtain one at .{1,80}", "mpl2-copy"),
    ("to", r"to the extent possible under law .{1,80} (?:has|have) (?:waived|dedicated) all copyright and related (?:or|and) neighbou?ring rights to .{1,80}", "cc0-waive"),
    ("this", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2.0.{0,120}", "epl2-terms"),
    ("this", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1.0.{0,120}", "epl1-terms"),
    ("copyright", r"copyright (?:c )?(?:[0-9]{4} ?)*(?:by )?.{1,80}", "copyright"),
    ("neither", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
)
#: (licence, kind, identifiers in order). Fixed values.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-asis")), ("MIT", "text", ("mit-grant", "mit-notice")), ("MIT", "reference", ("mit-ref",)), ("MIT", "reference", ("mit-spdx",)), ("MIT", "reference", ("mit-title",)),
    ("Apache-2.0", "text", ("apache2-ref", "apache-use", "apache-copy", "apache-asis", "apache-see")), ("Apache-2.0", "reference", ("apache2-ref",)), ("Apache-2.0", "reference", ("apache2-spdx",)),
    ("GPL-3.0-or-later", "text", ("gpl-free", "gpl3-later", "gpl-hope")), ("GPL-3.0-or-later", "text", ("gpl3-later",)), ("GPL-3.0", "reference", ("gpl3-ref",)), ("GPL-3.0", "reference", ("gpl3-spdx",)), ("GPL-2.0", "reference", ("gpl2-ref",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync4-ref",)), ("CC-BY-4.0", "reference", ("ccby4-ref",)), ("CC-BY-SA-4.0", "reference", ("ccbysa4-ref",)),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD", "reference", ("bsd-ref",)), ("MPL-2.0", "reference", ("mpl2-ref",)), ("public-domain", "reference", ("pd-ref",)), ("all-rights-reserved", "notice", ("reserved",)),
    ("ISC", "text", ("isc-grant", "isc-asis", "isc-liable")), ("ISC", "text", ("isc-grant",)), ("ISC", "reference", ("isc-title",)), ("0BSD", "text", ("0bsd-grant",)), ("Unlicense", "text", ("unlicense-free", "unlicense-grant")), ("Unlicense", "text", ("unlicense-free",)), ("Unlicense", "reference", ("unlicense-title",)),
    ("MPL-2.0", "text", ("mpl2-form", "mpl2-copy")), ("MPL-2.0", "text", ("mpl2-form",)), ("CC0-1.0", "text", ("cc0-waive",)), ("CC0-1.0", "reference", ("cc0-title",)), ("EPL-2.0", "text", ("epl2-terms",)), ("EPL-2.0", "reference", ("epl2-ref",)), ("EPL-1.0", "text", ("epl1-terms",)),
)
_MADE = generated()
SENTENCES = _MADE[0] | SENTENCES  # what stands in the table by itself comes first
RULES += tuple(_MADE[1])
GAP = 3


@cache
def beginnings() -> set[str]:
    """What known sentences begin with, in whole words, and the sentences."""
    return {" ".join(words[:k]) for words in map(str.split, SENTENCES) for k in range(1, len(words) + 1)}


@cache
def tools() -> tuple:
    return regex.compile(HINT, regex.I), regex.compile(r"(?<=[.!?;])\s+"), regex.compile(WORD), [(w, regex.compile(p), i) for w, p, i in PATTERNS]


def normalised(sentence: str) -> str:
    return " ".join(tools()[2].findall(sentence.lower()))


def identifier(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    if (known := SENTENCES.get(sentence)) is not None:
        return known
    return next((i for word, pattern, i in tools()[3] if sentence.startswith(word) and pattern.fullmatch(sentence)), None)


def matched(ids: list[str], gap: int = GAP) -> list[tuple[int, int]]:
    """``(place, rule)`` of every rule that fits, by place; longer rules first, each identifier used once."""
    where: dict[str, list[int]] = {}
    for k, i in enumerate(ids):
        where.setdefault(i, []).append(k)
    used, out = [False] * len(ids), []
    for r in sorted(range(len(RULES)), key=lambda r: (-len(RULES[r][2]), r)):
        want = RULES[r][2]
        for start in where.get(want[0], ()):
            took = [] if used[start] else [start]
            for w in want[1:] if took else ():
                nxt = next((k for k in range(took[-1] + 1, min(took[-1] + 2 + gap, len(ids))) if ids[k] == w and not used[k]), None)
                if nxt is None:
                    took = []
                    break
                took.append(nxt)
            if took:
                out.append((start, r))
                for k in took:
                    used[k] = True
    return sorted(out)


def paragraphs(text: str) -> Iterator[list[str]]:
    """Parts of lines, by paragraph."""
    parts: list[str] = []
    for line in regex.split(r"\r\n|[\r\n\f\v]", text):
        if regex.search(r"[^\W_]", line):
            parts += filter(None, tools()[1].split(line))
        elif parts:
            yield parts
            parts = []
    yield parts


def known(parts: list[str], k: int, any_words: bool) -> tuple[str | None, int]:
    """The identifier of the sentence that begins at part ``k``, and how many parts it takes. Without ``any_words`` it must hold a licence word."""
    hint, _, _, patterns = tools()
    hinted = hint.search(parts[k]) is not None
    if not hinted and len(parts[k]) >= 2000:
        return None, 1
    one = joined = normalised(parts[k])
    found, last = (None, 1), k
    while joined in beginnings():
        if joined in SENTENCES and (any_words or hint.search(joined)):
            found = SENTENCES[joined], last - k + 1
        if parts[last].rstrip()[-1:] in ".!?;" or last + 1 == len(parts) or len(parts[last + 1]) >= 2000:
            break
        last += 1
        joined += " " + normalised(parts[last])
    if found[0] is None and (hinted or any_words):
        found = identifier(one), 1
    if found[0] is None and any(one.startswith(word) for word, *_ in patterns):
        joined, last = one, k
        while len(joined) < 400 and parts[last].rstrip()[-1:] not in ".!?;" and last + 1 < len(parts) and len(parts[last + 1]) < 2000:
            last += 1
            joined += " " + normalised(parts[last])
            if (any_words or hint.search(joined)) and (i := identifier(joined)):
                return i, last - k + 1
    return found


def scanned(text: str) -> tuple[list[str], list[str], int]:
    """Licences in order of first place, the sequence of known identifiers, and how many licence-like sentences are unknown."""
    hint = tools()[0]
    ids, unknown = [], 0
    for parts in paragraphs(text):
        k, counted = 0, False
        while k < len(parts):
            found, took = known(parts, k, bool(ids))
            if found:
                ids.append(found)
                counted = False
            else:
                if not counted and hint.search(parts[k]):
                    unknown, counted = unknown + 1, True
                if parts[k].rstrip()[-1:] in ".!?;":
                    counted = False
            k += took
    return list(dict.fromkeys(RULES[r][0] for _, r in matched(ids))), ids, unknown


def licences(documents: DataFrame) -> DataFrame:
    """``doc_id, licences, sentences, n_unknown, verdict`` for each row of ``documents``.

    ``verdict``: licensed, unknown (licence-like sentences, but no rule fits) or
    none. Null and empty texts have none. Repeated rows each give a row; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text")
                likely = pc.match_substring_regex(texts, "(?i)" + HINT).fill_null(False).to_pylist()
                found = [scanned(t) if is_likely else ([], [], 0) for t, is_likely in zip(texts.to_pylist(), likely, strict=True)]
                names = [",".join(x) for x, _, _ in found]
                verdicts = ["licensed" if n else "unknown" if u or ids else "none" for n, (_, ids, u) in zip(names, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array([",".join(x) for _, x, _ in found], pa.string()), pa.array([u for *_, u in found], pa.int64()), pa.array(verdicts, pa.string())], ["doc_id", "licences", "sentences", "n_unknown", "verdict"])

    return with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, licences string, sentences string, n_unknown long, verdict string")


