import random

from tracewright.llm import license as lic


def value(e):
    p = lic.to_postfix(e)
    v = lic.evaluate(p) if p else None
    return None if v is None else v[0]


def test_expressions():
    assert value("MIT") == 0
    assert value("MIT OR GPL-3.0-only") == 0
    assert value("MIT AND GPL-3.0-only") == 2
    assert value("GPL-2.0-only WITH Classpath-exception-2.0") == 1
    assert value("MIT OR AGPL-3.0-only AND GPL-2.0-only") == 0
    assert value("(MIT OR AGPL-3.0-only) AND GPL-2.0-only") == 2
    assert value("GPL-2.0+") == 2 and value("LGPL-2.1") == 1 and value("Artistic-2.0") == 0 and value("MIT.") == 0
    assert value("GPL-2.0-or-later WITH GCC-exception-3.1 AND MIT") == 1
    assert value("Unheard-Of") == lic.UNKNOWN
    for bad in ("", "MIT OR", "(MIT", "MIT)", "MIT GPL-2.0", "OR MIT", "MIT WITH (A OR B)", "MIT ; x", "()", "(MIT OR ISC) WITH x", "GPL-3.0-only WITH MIT", "GPL-3.0-only WITH Unheard-Of"):
        assert value(bad) is None, bad


def test_against_recursive_evaluation():
    r = random.Random(3)
    names = [*lic.CLASS_OF][:12]

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            n = r.choice(names)
            return n, lic.CLASS_OF[n]
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        op = r.choice(["and", "or"])
        return f"({a} {op.upper()} {b})", max(x, y) if op == "and" else min(x, y)

    for _ in range(300):
        text, want = make(4)
        assert value(text) == want


def test_scan_and_brute_force(spark, odd, none):
    texts = ["/* SPDX-License-Identifier: MIT OR GPL-3.0-only */\nx", "Released under the MIT License. And GNU General Public License, version 3.", "# spdx-license-identifier: (MIT\ny", "nothing", None]
    out = {r.doc_id: r for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0].licence_class == 0 and out[0].licences == ["gpl-3.0-only", "mit"] and out[0].allowed
    assert out[1].licence_class == 2 and out[1].n_notices == 2 and not out[1].allowed
    assert out[2].licence_class == lic.UNKNOWN and out[2].n_broken == 1
    assert out[3].licence_class is None and out[3].allowed and out[4].licences == []
    for i, t in enumerate(texts[:4]):
        assert out[i].n_notices == sum(t.lower().count(p) for p in lic.NOTICES)
    assert lic.scan(odd).count() == odd.count() and lic.scan(none).count() == 0


def test_wrapped_headers():
    found = lic.automaton()
    for text, licence, kind in (
        (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted", "bsd-3-clause", 0),
        ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.", "mpl-2.0", 1),
        ("// under the terms of the GNU Lesser General\r\n//   Public License as published", "lgpl-3.0-only", 1),
        ("/* GNU Affero General */\n/* Public License */", "agpl-3.0-only", 3),
        (" * the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or", "gpl-3.0-or-later", 2),
        ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2.0-or-later", 2),
        ("-- Released  under\tthe\n\n-- MIT License", "mit", 0),
    ):
        licences, _, notices, _, strictest = lic.scan_text(text, found)
        assert (licences, notices, strictest) == ([licence], 1, kind), text
    # A tag still ends with its line.
    assert lic.scan_text("# SPDX-License-Identifier: MIT\n# OR GPL-3.0-only", found)[:2] == (["mit"], ["mit"])
    assert lic.scan_text("-" * 200_000 + " " * 200_000, found)[2] == 0


def test_phrases_against_a_plain_search():
    """Every phrase at every place, the longest from a place counting."""
    r = random.Random(5)
    found, phrases = lic.automaton(), {lic.on_one_line(p): x for p, x in lic.NOTICES.items()}
    names = list(phrases)
    for _ in range(200):
        text = " ".join(r.choice([r.choice(names), r.choice(names)[:-3], "words", "\n * more"]) for _ in range(r.randint(0, 6)))
        flat = lic.on_one_line(text)
        at = {}
        for p, x in phrases.items():
            for i in range(len(flat)):
                if flat.startswith(p, i) and len(p) > at.get(i, (0, ""))[0]:
                    at[i] = (len(p), x)
        want = sorted({x for _, x in at.values()})
        licences, _, n, _, strictest = lic.scan_text(text, found)
        assert (licences, n) == (want, len(at)) and strictest == max((lic.CLASS_OF[x] for x in want), default=None)
    assert all(x in lic.CLASS_OF for x in phrases.values())
