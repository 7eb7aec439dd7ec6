"""Cases in which an operator once did less than its whole job."""

import random
import textwrap

from brute import frame, shingles

from finquery.llm import license_rules as LR
from finquery.llm.template_decontam import leaks


def near(rows, width, percent):
    """Smallest doc_id that links reach, for each document."""
    sets = {i: shingles(t, width) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for i, s in sets.items():
            for j, t in sets.items():
                if s and t and 100 * len(s & t) >= percent * len(s | t):
                    least[i] = min(least[i], least[j])
    return least


def test_pipeline_joins_near_copies_of_five_words_at_80_percent(spark):
    import corpus_pipeline as P

    rng, rows = random.Random(8), []
    for g in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((10 * g, " ".join(text)))
        for k, (edits, tail) in enumerate([(1, 0), (2, 0), (3, 0), (0, 15), (0, 24), (0, 30)], 1):
            copy = list(text)
            for at in rng.sample(range(5, 95), edits):
                copy[at] = f"edit{g}x{k}"
            rows.append((10 * g + k, " ".join(copy + [f"t{g}x{k}x{j}" for j in range(tail)])))
    want = near(rows, 5, 80)
    assert want != near(rows, 3, 90)
    got = {r["doc_id"] for r in P.near_duplicates(spark, frame(spark, rows), "unused").collect()}
    assert got == {i for i, least in want.items() if i == least}


def leaked(spark, item, texts, **options):
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, h string")
    return {r["doc_id"]: r["verbatim"] for r in leaks(spark, frame(spark, list(enumerate(texts))), bench, **options).collect()}


STRETCHES = {"one_to_one": False, "stretches": True}


def test_stretches_leak_where_values_meet_or_part(spark):
    item = "A farmer keeps 40 cows in the north field and 2 goats near the old barn and sells some of them each week in town"
    assert leaked(spark, item, [item.replace("40", "90").replace("2 goats", "90 goats")], **STRETCHES) == {0: False}
    item = "In the quiet garden there are 5 birds on the fence and under the tall green tree sleep 5 cats while it rains all day long"
    assert leaked(spark, item, [item.replace("5 birds", "6 birds"), item, item.replace("garden", "park").replace("fence", "wall").replace("tree", "oak").replace("rains", "snows")], **STRETCHES) == {0: False, 1: True}


NAMES = ["Tom", "Lisa", "Omar", "Ann", "Carla", "Dave", "Igor", "Mei", "Noor", "Paul"]
NOUNS = ["apples", "coins", "stones", "books", "tickets", "chairs", "letters", "boats", "lamps", "shirts", "bottles", "cards"]
PLACES = ["market", "station", "garden", "school", "harbour", "library", "museum", "bakery", "office", "farm"]
VERBS = ["buys", "sells", "carries", "counts", "hides", "finds", "paints", "breaks", "borrows", "loses"]


def problem(rng):
    """A word problem as a list of literal words and slots (kind, number of the value)."""
    out = []
    for k in range(rng.randrange(3, 6)):
        out += [("p", rng.randrange(2)), rng.choice(VERBS), ("n", 2 * k), rng.choice(NOUNS), "near", "the", rng.choice(PLACES), "and", "then", "walks", ("n", 2 * k + 1), rng.choice(["km", "miles", "minutes", "hours"]), "to", "the", rng.choice(PLACES) + "."]
    return out


def told(parts, rng, most):
    values: dict = {}
    return " ".join(x if isinstance(x, str) else values.setdefault(x, rng.choice(NAMES) if x[0] == "p" else str(rng.randrange(1, most))) for x in parts)


def test_recall_on_questions_with_other_values(spark):
    rng = random.Random(12)
    problems = [problem(rng) for _ in range(60)]
    bench = spark.createDataFrame([(k, told(p, rng, 40), "x") for k, p in enumerate(problems)], "item_id long, text string, h string")
    prose = lambda n: " ".join(rng.choice(NOUNS + PLACES + VERBS + NAMES + ["the", "a", "of", "7"]) for _ in range(n))
    docs, want = [], {}
    for k, p in enumerate(problems):
        for few in (40, 4):  # with few numbers values meet by chance
            i = len(docs)
            docs.append((i, f"{prose(30)} {told(p, rng, few)} {prose(30)}"))
            want[i] = k
        i = len(docs)
        docs.append((i, f"{prose(10)} {told(p[: len(p) * 2 // 3], rng, 40)} {prose(10)}"))  # a part of it
        want[i] = k
    clean = [(10_000 + k, prose(120)) for k in range(100)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark, frame(spark, docs + clean), bench, **STRETCHES).collect()}
    caught = sum((i, k) in got for i, k in want.items()) / len(want)
    assert caught >= 0.9, caught
    assert not [i for i, _ in got if i >= 10_000]


def test_items_rich_in_numbers_leak(spark):
    item = "It costs 12 dollars and 30 cents plus 4 dollars and 5 cents today"  # one window of seven has four literal words
    assert leaked(spark, item, [f"Before. {item} after.", item.replace("12", "9").replace("30", "77"), "It costs nothing and nobody pays 4 dollars for it today"]) == {0: True, 1: False}
    whole = "alpha 1 2 3 4 5 beta 6 7 8 9 10 gamma 11 12 13 14 15 delta"  # none has
    assert leaked(spark, whole, [f"see {whole} there", whole.replace("delta", "omega"), whole.replace("13", "99"), whole.replace("13", "1")]) == {0: True, 2: False}


def test_names_leak_wherever_they_stand(spark):
    item = "Tom has 3 apples and 5 pears in a box. Tom gives 2 apples to Ann every day."
    assert leaked(spark, item, [item, item.replace("Tom", "Lisa"), item.replace("Tom", "Lisa", 1), item.lower()]) == {0: True, 1: False, 2: True, 3: True}
    item = "every morning our old baker gives Ann 3 loaves of bread while Bob waits outside with 2 dogs"
    other = item.replace("Ann", "Carla").replace("Bob", "Dave")
    assert leaked(spark, item, [other, other.replace("gives ", "gives\n"), other.replace("while ", "while  ").replace("of ", "of\t")]) == {0: False, 1: False, 2: False}


def test_a_conflict_spoils_its_run_only(spark):
    item = "early one day Alice met ten old friends near the quiet and shallow river by our house and much later Alice went home again with all of them by train"
    torn = item.replace("day Alice", "day Eve").replace("later Alice", "later Zoe")
    assert leaked(spark, item, [torn.replace("house", "garden"), torn]) == {0: False}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for x in text.split("\n") for line in textwrap.wrap(x, width) or [""])


def test_wrapped_licences(spark):
    head = "MIT License\nCopyright (c) 2020 Jane Doe\n"
    rows = [(k, wrapped(t, w, m)) for k, (t, w, m) in enumerate((t, w, m) for t in (head + MIT, APACHE, BSD) for w in (40, 75, 5000) for m in ("", "# ", " * "))]
    rows += [(50, "This work is in the public\n# domain"), (51, "Licensed under the Foo\nLicence 9, a licence of\nthe licensor."), (52, "The licence is old.\nReleased under the MIT License")]
    got = {r["doc_id"]: (r["licences"], r["n_unknown"]) for r in LR.licences(frame(spark, rows)).collect()}
    assert [got[k] for k in range(9)] == [("MIT", 0)] * 9
    assert [got[k][0] for k in range(9, 27)] == ["Apache-2.0"] * 9 + ["BSD-3-Clause"] * 9
    assert [got[k] for k in (50, 51, 52)] == [("public-domain", 0), ("", 1), ("MIT", 1)]
    assert LR.scanned(wrapped(APACHE, 75))[1] == ["apache2-ref", "apache-use", "apache-copy", "apache-asis", "apache-see"]


GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.

You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
CC0 = "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to This Work."
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"


def gnu(name, version):
    return GPL.format(name, version, name, name)


def test_standard_texts_are_named():
    texts = {
        "MIT": "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + MIT, "Apache-2.0": APACHE, "BSD-3-Clause": BSD, "GPL-3.0-or-later": gnu("General Public License", "3"), "GPL-2.0-or-later": gnu("General Public License", "2").replace("software: you", "software; you"),
        "LGPL-2.1-or-later": gnu("Lesser General Public License", "2.1").replace("program", "library"), "AGPL-3.0-or-later": gnu("Affero General Public License", "3"), "ISC": "Copyright (c) 2020, Jane Doe\n\n" + ISC, "Unlicense": UNLICENSE, "MPL-2.0": MPL, "CC0-1.0": CC0, "EPL-2.0": EPL,
    }
    for name, text in texts.items():
        for width in (45, 75, 5000):
            for mark in ("", "# ", " * "):
                assert LR.scanned(wrapped(text, width, mark))[0] == [name], (name, width, mark, LR.scanned(wrapped(text, width, mark)))


def test_identifiers_and_names_are_found():
    for name in LR.SPDX:
        assert LR.scanned(f"// SPDX-License-Identifier: {name}\nint x;")[0] == [name], name
    lines = {"This project is licensed under the ISC License.": "ISC", "Released under the BSD 3-Clause License": "BSD-3-Clause", "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "This work is licensed under CC0 1.0.": None, "Licensed under CC0 1.0.": "CC0-1.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0"}
    for line, name in lines.items():
        assert LR.scanned(line)[0] == ([name] if name else []), line
