"""Secret scan, licence scan, perplexity rules and quality classifier."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from factpack.llm import license_scan as L
from factpack.llm import ordinal_quality as Q
from factpack.llm import perplexity_rules as P
from factpack.llm import secret_scan as S

from .conftest import SCHEMA, odd_rows, prose, rows

BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
)


def brute_spans(text):
    found = []
    for i, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (6, 20, 24)[i]:
                found.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def secrets():
    draw = random.Random(2)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [
        f"é token = \"{pick(hexes, 40)}\" and {prose(1, 30)}",
        f"PassWord: 'abc' secret=token: abcdefgh AKIA{pick(b64[:26], 16)}",
        f"aKIA AKIAAKIA{pick('0123456789', 12)} {pick(hexes, 23)} {pick(hexes, 24)} api_key=x_y.z-1/2",
        f"toſen = {pick(hexes, 30)} toKen: abcdefghij",
        None,
        "",
        f"{prose(3, 300)} {pick(b64, 44)} {prose(4, 200)}",
        "a_very_long_identifier_of_words_that_people_write and_another-long-one-that-is-written",
        "0123456789012345678901234567890123456789 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    ]
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(20 + i, prose(i, 80), "en", "a", 1) for i in range(20)]


def test_secret_base_spans_are_brute_force(spark, odd, odd_clash, none):
    for data, df in ((secrets(), None), (odd_rows(), odd), (odd_rows(), odd_clash)):
        got = S.find_secrets(df if df is not None else spark.createDataFrame(data, SCHEMA)).collect()
        by_text = {}
        for id_, text, *_ in data:
            by_text.setdefault(id_, []).append(brute_spans(text))
        assert len(got) == len(data)
        for r in got:
            spans = r.spans.split(",") if r.spans else []
            base = [x for x in spans if not x.startswith("random")]
            assert base in by_text[r.doc_id]
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
            assert r.n_random == len(spans) - len(base)
    assert rows(S.find_secrets(none)) == []


def test_randomness_finds_keys_and_leaves_writing(spark):
    got = {r.doc_id: r for r in S.find_secrets(spark.createDataFrame(secrets(), SCHEMA)).collect()}
    assert got[6].n_random == 1
    start, end = map(int, got[6].spans.split(":")[1:])
    assert end - start == 44
    assert got[7].n_random == 0 and got[8].n_random == 0
    assert sum(got[20 + i].n_random for i in range(20)) == 0


def test_random_spans_are_brute_force_step_up(spark):
    draw = random.Random(12)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
    words = ["".join(x.split()) for x in (prose(500 + i, 12) for i in range(60))] + ["/".join(prose(700 + i, 9).split()) for i in range(40)]
    tokens = words + ["".join(draw.choices(draw.choice(kinds), k=draw.choice([20, 24, 31, 32, 40, 64, 90, 200]))) for _ in range(120)]
    draw.shuffle(tokens)
    texts = [" ".join(tokens[i : i + 4]) for i in range(0, len(tokens), 4)]
    p, where = {}, {}
    for i, text in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            if any(int(x.split(":")[1]) < m.end() and m.start() < int(x.split(":")[2]) for x in brute_spans(text)):
                continue
            letters = S.ALPHABETS[S.encoding(m[0])]
            fair = min(S.battery(m[0], letters)) >= S.LEVEL / 3
            step = min(S.STEPS, int(-10 * S.against_writing(m[0], letters))) if fair else 0
            p[i, m.start(), m.end()] = 10 ** (-step / 10)
            where[i, m.start(), m.end()] = sum(len(m[0]) >= x for x in S.LENGTHS)
    want = set()
    for band in range(4):
        mine = sorted((v, k) for k, v in p.items() if where[k] == band)
        last = max((r for r, (v, _) in enumerate(mine, 1) if v < 1 and v <= S.Q * r / len(mine)), default=0)
        want |= {k for _, k in mine[:last]}
    got = S.find_secrets(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {(r.doc_id, *map(int, x.split(":")[1:])) for r in got for x in r.spans.split(",") if x.startswith("random")} == want
    found = {texts[i][a:b] for i, a, b in want}
    assert not found & set(words) and len(found) > 20


def test_battery_holds_its_level():
    draw, letters = random.Random(4), S.ALPHABETS["base64"]
    passed = sum(min(S.battery("".join(draw.choices(letters, k=40)), letters)) >= S.LEVEL / 3 for _ in range(800))
    assert passed >= 784
    assert min(S.battery(letters[:40], letters)) < S.LEVEL / 3


def test_licence_rules(spark, odd, odd_clash, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in it.\nThe above copyright notice and this permission notice shall be included in all copies or portions.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    texts = {
        1: "Some words.\nLicensed under the Apache License, Version 2.0.\nMore words.",
        2: "Released under the MIT License.",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "Licensed under CC BY-NC 4.0.",
        5: f"Copyright (c) 2020 Some One\n{mit}",
        6: f"{mit}\nReleased under the MIT license. Licensed under the Apache License, Version 2.0.",
        7: "Licence terms: this is licensed under terms that nobody knows.",
        8: "Copyright 2019 Some One. All rights reserved.",
        9: "SPDX-License-Identifier: BSD-3-Clause",
        10: "A driver's licence is a permission to drive.",
        11: "# * Licensed under the Apache License, Version 2.0 (the \"License\");\n# * you may not use this file except in compliance with the License.\n# * You may obtain a copy of the License at\n# * Unless required by applicable law or agreed to in writing, software\n",
    }
    got = {r.doc_id: r.licences for r in L.scan_licences(spark.createDataFrame([(k, v, "en", "a", 1) for k, v in texts.items()], SCHEMA)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["GPL-3"], 4: ["CC-BY-NC-4.0"], 5: ["MIT"], 6: ["MIT", "Apache-2.0"], 7: ["UNMATCHED"], 8: [], 9: ["BSD-3-CLAUSE"], 10: [], 11: ["Apache-2.0"]}
    assert {len(r.licences) for r in L.scan_licences(odd).collect()} == {0}
    assert L.scan_licences(odd_clash).count() == len(odd_rows()) and rows(L.scan_licences(none)) == []


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
GPL = """    This program is free software%s you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

    You should have received a copy of the GNU General Public License
    along with this program.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


ALONE = {
    "SPDX": "SPDX-License-Identifier: MIT", "COPYRIGHT": "Copyright (c) 2020 Some One", "ALLRIGHTS": "All rights\nreserved.",
    "APACHE_UNDER": "Licensed under the Apache License, Version 2.0", "APACHE_COMPLY": "you may not use this file except in compliance with the License", "APACHE_COPY": "You may obtain a copy of the License at",
    "APACHE_ASIS": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "MIT_UNDER": "Released under the MIT License", "MIT_GRANT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT_NOTICE": "The above copyright notice and this permission notice shall be included in all copies",
    "MIT_ASIS": "The software is provided as is, without warranty of any kind", "BSD_UNDER": "Released under the 3-clause BSD license", "BSD_GRANT": "Redistribution and use in source and binary forms are permitted",
    "BSD_SOURCE": "Redistributions of source code must retain the above copyright notice", "BSD_BINARY": "Redistributions in binary form must reproduce the above copyright notice", "BSD_NAME": "Neither the name of X may be used to endorse or promote products",
    "BSD_ASIS": "This software is provided by the authors as is and any express or implied warranties", "LGPL_UNDER": "Licensed under the GNU Lesser General Public License", "AGPL_UNDER": "Licensed under the GNU Affero General Public License",
    "GPL_UNDER": "Licensed under the GNU General Public License, version 3", "GPL_FREE": "It is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GPL_NOWARRANTY": "It is distributed in the hope that it will be useful, but without any warranty",
    "GPL_RECEIVED": "You should have received a copy of the GNU General Public License", "MPL_UNDER": "subject to the terms of the Mozilla Public License, version 2.0",
    "CC_BY_NC_ND": "Licensed under CC BY-NC-ND 4.0", "CC_BY_NC_SA": "Licensed under CC BY-NC-SA 4.0", "CC_BY_NC": "Licensed under CC BY-NC 4.0", "CC_BY_SA": "Licensed under CC BY-SA 4.0", "CC_BY_ND": "Licensed under CC BY-ND 4.0", "CC_BY": "Licensed under CC BY 4.0",
    "CC0": "All images are CC0.", "OTHER_LICENSE": "Some licence agreement",
}


def test_every_known_sentence_alone_is_found(spark):
    assert list(ALONE) == [name for name, _ in L.SENTENCES]
    texts = {i: x for i, x in enumerate([*ALONE.values(), "dedicated to the public\ndomain"])}
    got = {r.doc_id: [x.id for x in r.sentences] for r in L.scan_licences(spark.createDataFrame([(i, x, "en", "a", 1) for i, x in texts.items()], SCHEMA)).collect()}
    assert got == {i: [name] for i, name in enumerate([*ALONE, "CC0"])}


def test_wrapped_notices_are_whole():
    whole = {"MIT": (MIT, ["MIT_GRANT", "MIT_NOTICE", "MIT_ASIS"]), "BSD-3-Clause": (BSD, ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME", "BSD_ASIS"]), "Apache-2.0": (APACHE, ["APACHE_UNDER", "APACHE_COMPLY", "APACHE_COPY", "APACHE_ASIS"])}
    whole |= {f"GPL{x}": (GPL % x, ["GPL_FREE", "GPL_NOWARRANTY", "GPL_RECEIVED"]) for x in ":;"}
    for name, (text, wanted) in whole.items():
        for mark in ("", "# ", " * ", "// "):
            found = L.sentences("".join(f"{mark}{x}\n" for x in text.splitlines()))
            assert [x[2] for x in found if x[2] not in L.WEAK] == wanted
            assert L.licences(found) == [name.rstrip(":;")]
    two = L.sentences("Code is released under the MIT License\nDocs are licensed under CC BY 4.0\nand more")
    assert [x[2] for x in two] == ["MIT_UNDER", "CC_BY"]
    assert L.licences(L.sentences("Licensed under the\nApache License, Version\n2.0")) == ["Apache-2.0"]


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_word_measures_are_brute_force(spark, odd, odd_clash, none):
    draw = random.Random(8)
    extra = [(100 + i, "".join(draw.choice(["a b c ", "a b ", "é#\n", "x y z\n", " \n", "q\x0b", "<*| ", "\x1c"]) for _ in range(draw.randrange(40))), "en", "a", 1) for i in range(60)]
    for df, data in ((odd, odd_rows()), (odd_clash, odd_rows()), (spark.createDataFrame(extra, SCHEMA), extra)):
        got = P.judge(df).collect()
        want = {}
        for id_, text, *_ in data:
            want.setdefault(id_, []).append(brute_measures(text))
        assert len(got) == len(data)
        for r in got:
            m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert m in want[r.doc_id]
            assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
            assert not (r.base_failed and r.kept)
    assert rows(P.judge(none)) == []


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney by dictionaries, over the code points of texts."""
    counts = {P.ORDER: {}}
    for text in texts:
        s = [0] * (P.ORDER - 1) + [ord(c) for c in text]
        for i in range(P.ORDER, len(s) + 1):
            g = tuple(s[i - P.ORDER : i])
            counts[P.ORDER][g] = counts[P.ORDER].get(g, 0) + 1
    for n in range(P.ORDER - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    d = {n: P.discounts(*[list(c.values()).count(i) for i in (1, 2, 3, 4)]) for n, c in counts.items()}
    follow = {}
    for c in counts.values():
        for g, v in c.items():
            follow.setdefault((len(g), g[:-1]), []).append(v)

    def p(g):
        if not g:
            return 1 / P.ALPHABET
        n, held = len(g), counts[len(g)].get(g, 0)
        context = follow.get((n, g[:-1]))
        if not context:
            return p(g[1:])
        gamma = sum(d[n][min(v, 3) - 1] for v in context) / sum(context)
        return (held - (d[n][min(held, 3) - 1] if held else 0)) / sum(context) + gamma * p(g[1:])

    return p


def test_model_is_modified_kneser_ney_of_the_other_fold(spark):
    texts = [prose(i, 60) for i in range(12)] + ["naïve \U0001f600 кириллица и слова", "中文 中文字"]
    df = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], SCHEMA)
    fold = [r[0] for r in df.orderBy("doc_id").select(P.fold()).collect()]
    assert set(fold) == {0, 1}
    model = [brute_kneser_ney([x for x, f in zip(texts, fold, strict=True) if f != k]) for k in (0, 1)]
    got = {r.doc_id: r.surprise for r in P.score(df).collect()}
    for i, (x, f) in enumerate(zip(texts, fold, strict=True)):
        s = [0] * (P.ORDER - 1) + [ord(c) for c in x]
        want = np.mean([-np.log(model[f](tuple(s[j - P.ORDER : j]))) for j in range(P.ORDER, len(s) + 1)])
        assert abs(got[i] - want) < 1e-4


def test_copies_share_a_fold_and_sorted_keys_find_all(spark):
    assert spark.createDataFrame([("a b\tc",), ("abc",), ("a  bc\n",)], "text string").select(P.fold()).distinct().count() == 1
    draw = np.random.default_rng(1)
    keys = np.concatenate([draw.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, 1, 2, 3, (1 << 64) - 1], np.uint64)])
    some = draw.choice(keys, 20_000)
    found, at, which = P.distinct(some)
    assert (found == np.unique(some)).all() and (some[at] == found).all() and (found[which] == some).all()
    assert len(P.distinct(some[:0])[0]) == 0


def test_bands_reject_gibberish_and_keep_prose(spark):
    draw = random.Random(6)
    spell = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(7)) for _ in range(80))
    junk = [spell("qzxjkvwpQ0#") for _ in range(5)] + [spell("абвгдежзиклмнопрстуфхцчшщ") for _ in range(5)] + ["the the the " * 20 + f"{i} words " * 12 for i in range(2)]
    # prose in which a word says what may follow it, and the same words in any order
    names = list(dict.fromkeys(prose(99, 2000).split()))
    follow = {w: draw.sample(names, 4) for w in names}
    good = []
    for _ in range(200):
        words = [draw.choice(names)]
        while len(words) < 120:
            words.append(draw.choice(follow[words[-1]]))
        good.append(" ".join(words))
    for i in range(8):
        words = good[i].split()
        draw.shuffle(words)
        junk.append(" ".join(words))
    data = [(i, x, "en", "a", 1) for i, x in enumerate(good)] + [(1000 + i, x, "en", "a", 1) for i, x in enumerate(junk)]
    got = {r.doc_id: r for r in P.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not any(got[1000 + i].kept for i in range(12))
    # five code points see the joins of words alone: a wrong order always costs, though not each is beyond the band
    assert all(got[1012 + i].perplexity > got[i].perplexity for i in range(8))
    assert all(got[i].kept or got[i].base_failed for i in range(len(good)))


def test_bands_leave_outliers_out_on_both_sides(spark):
    draw = random.Random(12)
    bulk = [draw.gauss(1.5, 0.03) for _ in range(2000)]
    apart = [1.5 + 0.03 * x for x in (-9, -6, 6, 9)]
    scored = spark.createDataFrame([("en", x, False) for x in bulk + apart] + [("en", 9.0, True)], "lang string, surprise double, base_failed boolean")
    low, high = P.bands(scored)["en"]
    assert not any(low <= x <= high for x in apart)
    assert np.mean([low <= x <= high for x in bulk]) > 0.995


def graded(n):
    draw, docs, labels = random.Random(11), [], []
    for i in range(n):
        words, kind = prose(i, draw.randrange(30, 120)).split(), i % 3
        if kind == 0:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "moron", "clown"]))
        if kind == 1:
            words = [w + draw.choice(["!!", "%%"]) for w in words]
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return docs, labels


def test_classifier_on_held_out_rows(spark, odd, odd_clash, none):
    docs, labels = graded(600)
    df = spark.createDataFrame(docs, SCHEMA)
    some = spark.createDataFrame([*labels[:400], (None, 1, 0), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(df, some).collect()}
    right = [got[i].kept == (i % 3 == 2) for i in range(400, 600)]
    assert np.mean(right) >= 0.97
    means = [np.mean([got[i].expected_grade for i in range(400, 600) if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    for frame in (odd, odd_clash):
        assert Q.classify(frame, some, rated_docs=df).count() == len(odd_rows())
    assert rows(Q.classify(none, some)) == [] and all(r.kept for r in Q.classify(df, some.limit(0)).collect())


def test_tails_are_ordered_and_features_are_distinct():
    places, bounds = Q.features(pa.array(["A a b", None, "", "zz"]))
    assert np.diff(bounds).tolist() == [4, 0, 0, 2]
    model = Q.OrdinalModel(np.zeros(1 << Q.BITS, np.float32), np.array([-1.0, 1.0]))
    tails = model.tails(places, bounds)
    assert (tails[:, 0] > tails[:, 1]).all()
