"""Jaccard join, suffix dedup, decontamination, licences and quality against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ribospark.llm import jaccard_join
from ribospark.llm.common import components
from ribospark.llm.decontaminate import decontaminate, leaks
from ribospark.llm.jaccard_join import jaccard_components
from ribospark.llm.licenses import scan_licenses
from ribospark.llm.quality import fit, fit_quality, keep_good, ngrams, score_quality
from ribospark.llm.prefix_doubling import repeats_by_doubling
from ribospark.llm.suffix_dedup import remove_repeats

EXTRA = "doc_id long, text string, node string, n int"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], EXTRA).repartition(parts)


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(900, x) for x in range(901, 950)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = union_find({x for e in real for x in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    own = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    edges = [(a, b) for x, a in enumerate(own) for b in own[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = union_find(own, edges)
    least = defaultdict(lambda: 1 << 62)
    for a in own:
        least[root[a]] = min(least[root[a]], rows[a][0])
    return Counter((i, len(sets[k]), least[root[k]] if k in root else i) for k, (i, _) in enumerate(rows))


def variants(rng, base, n, edits):
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("tile", [1500, 7])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, tile):
    """With tiles of 7 texts the groups below take the path of large blocks."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqr") + str(rng.randint(0, 9))
    passage = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "\x1f \t"), (4, "one two"), (5, "ONE  two\n"), (5, "one two"), (None, "one two"), (6, "a b c d"), (7, "a b c d e"), (8, "\u00c9 x y z"), (9, "\u00e9 x y z")]
    texts = []
    for size, edits in ((20, 1), (40, 3), (80, 6), (200, 14)):
        texts += variants(rng, [word() for _ in range(size)], 25, edits)
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 40))]) for _ in range(40)]
    texts += [" ".join(passage + passage[:k]) for k in range(12)] + [" ".join(word() for _ in range(5000))] * 2
    rows += [(rng.randint(0, 2000), t) for t in texts]
    got = jaccard_components(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(docs(spark, [])).collect() == []


def removed(rows, length):
    key = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], 1 << 63), key(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < key(i):
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[(i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("length", "parts"), [(50, 1), (50, 4), (11, 3)])
def test_suffix_dedup_matches_brute_force(spark, length, parts):
    rng = random.Random(length)
    text = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [text(30) for _ in range(5)]
    rows = []
    for _ in range(90):
        cut = [rng.choice(shared)[rng.randint(0, 20) : rng.randint(40, 200)] + text(rng.randint(0, 8)) for _ in range(rng.randint(0, 3))]
        rows.append((rng.randint(0, 150), text(rng.randint(0, 20)) + "".join(cut)))
    rows += [(7, None), (8, ""), (None, shared[0]), (None, shared[0] + "x"), (3, "a" * 300), (5, "a" * 170), (9, "a" * 49), (11, "a" * 50), (21, shared[1]), (21, shared[1]), (20, shared[1]), (201, shared[2][:49]), (202, shared[2][:49])]
    got = remove_repeats(docs(spark, rows, parts), length, with_kept=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeats(docs(spark, [])).collect() == []
    if length == 50 and parts == 4:
        got = repeats_by_doubling(docs(spark, rows, parts), length).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, length)


def test_colliding_ranks_remove_nothing(spark, monkeypatch):
    """With ranks of two bits nearly all strings collide; their bytes decide."""
    from ribospark.llm import suffix_dedup as x

    raw = np.frombuffer(b"abcabdabcabeabcab" * 20 + bytes(range(256)), np.uint8)
    for length in (5, 8, 50):
        where = np.arange(len(raw) - length + 1)
        order, begins = x._ordered(raw, where, np.zeros(len(where), np.uint64), length)
        names = np.cumsum(begins)
        strings = [raw[w : w + length].tobytes() for w in where[order]]
        assert len(set(zip(strings, names.tolist(), strict=True))) == len(set(strings)) == names[-1]
    plain = np.zeros(len(raw) - 49, np.uint64) + np.arange(len(raw) - 49, dtype=np.uint64) % np.uint64(2)
    assert x._ordered(raw, np.arange(len(plain)), plain, 50)[1].sum() == len({raw[w : w + 50].tobytes() for w in range(len(plain))})


def test_suffix_dedup_takes_long_texts_whole(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long[:1_500_000]), (2, long), (3, "x" + long[2_999_900:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: (1_500_000, 0, 0), 2: (3_000_000, 1_500_000, 1), 3: (101, 100, 1)}


def test_leaks_of_templates(spark):
    item = "A train of the line leaves at 9 and runs 120 km before Anna meets it at 11 in the town"
    other = "Which of the two rivers in the north is longer than the other river in the south"
    texts = {
        1: f"before this. {item} after that", 2: item.replace("9", "7").replace("120", "95").replace("Anna", "Maria").replace("11", "8"),
        3: "words " * 50, 4: None, 5: "", 6: " ".join(item.split()[:9]), 7: other.upper() + "!", 8: item + "\n" + other, 9: "x " * 30_000 + item,
    }
    bench = spark.createDataFrame([(10, item, 0), (11, other, 0), (12, None, 0), (13, "", 0), (11, other, 0)], "item_id long, text string, doc_id int")
    rows = [*texts.items(), (8, texts[8]), (None, other)]
    got = leaks(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.changed) for r in got} == {(1, 10, False), (2, 10, True), (7, 11, False), (8, 10, False), (8, 11, False), (9, 10, False), (None, 11, False)}
    assert len(got) == 7
    kept = decontaminate(docs(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "node", "n"] and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert leaks(docs(spark, []), bench).collect() == [] and leaks(docs(spark, rows), bench.limit(0)).collect() == []


SWAPPED = "Tom has 5 apples. Jerry has 7 apples. Anna has 2 apples. How many apples do they have in all?"


def test_copies_in_another_case_or_place_and_swapped_names(spark):
    item = "What is the length of the river that runs from Bern to the northern sea"
    short, name = "What is gravity", "In which year did Columbus sail"
    bench = spark.createDataFrame([(1, item), (2, SWAPPED), (3, short), (4, name), (5, "gravity"), (6, "The Old Man And The Sea By Hemingway")], "item_id long, text string")
    rows = {
        1: item.lower(), 2: item.upper(), 3: f"Question: {item}? Answer", 4: f"1) {item}\n2) next", 5: "\u201c" + item + "\u201d",
        6: SWAPPED.replace("Tom", "Maria").replace("Jerry", "Ivan").replace("Anna", "Lena"), 7: SWAPPED.replace("Tom", "Maria").replace("5", "9"), 8: SWAPPED.replace("Jerry", "Tom"),
        9: "He asked her: what is gravity, and why?", 10: f"Q: {name}? Or not", 11: "Gravity!", 12: "gravity is what we feel", 13: "A Long List Of Other Capital Words In A Title",
        14: "1 2 3 4 5 6 7 8 9 10 11 12 13", 15: "the old man and the sea by hemingway", 16: f"x {name.lower()} y",
    }
    got = {(r.doc_id, r.item_id, r.changed) for r in leaks(docs(spark, list(rows.items())), bench).collect()}
    assert got == {*((i, 1, False) for i in (1, 2, 3, 4, 5)), (6, 2, True), (7, 2, True), (8, 2, True), (9, 3, False), (10, 4, False), (11, 5, False), (15, 6, False), (16, 4, False)}


def test_leaks_match_brute_force_and_the_shuffled_join(spark, monkeypatch):
    """Random texts of few words with names, numbers and units; the windows and their consistency in plain Python."""
    import re

    from ribospark.llm import decontaminate as d

    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "Anna", "Bob", "sea", "5", "72", "km", "h", "runs", "x1", "River,", "is.", "Go:", "and"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 4, 6, 9])))) for i in range(40)]
    rows = []
    for i in range(150):
        part = [word() for _ in range(rng.randint(0, 12))]
        copy = rng.choice(items)[1].split()
        copy = [{"5": "8", "72": "90", "Anna": "Eve"}.get(w, w) if rng.random() < 0.3 else w for w in copy]
        rows.append((i, " ".join(part[:6] + [w.lower() if i % 3 == 0 else w for w in copy] + part[6:])))

    def words(text):
        text = re.sub("[^A-Za-z0-9 ]", "", text).split()
        types, after = [], False
        for w in text:
            kind = "N" if re.search("[0-9]", w) else "U" if after and w.lower() in d.UNITS.split("|") else "C" if re.match("[A-Z][a-z]", w) else ""
            after = kind == "N"
            types.append(kind)
        return [w.lower() for w in text], types

    def forms(text, width):
        low, types = words(text)
        for a in range(max(len(low) - width, 0) + 1):
            w, t = low[a : a + width], types[a : a + width]
            typed = lambda which, w=w, t=t: (tuple(k if k in which else x for x, k in zip(w, t, strict=True)), tuple(x if k in which else None for x, k in zip(w, t, strict=True)))
            numbers = sum(k in ("N", "U") for k in t)
            yield a, *(typed(("N", "U")) if numbers <= width - d.LITERAL else (tuple(w), ()))
            if "C" in t and numbers + t.count("C") <= width - d.LITERAL:
                yield a, *typed(("N", "U", "C"))

    want = set()
    for i, item in items:
        n = len(words(item)[0])
        own = [*forms(item, 5)]
        for k, text in rows:
            size = len(words(text)[0])
            width = 5 if n >= 5 or size < 5 and size == n else n
            if n < d.SHORTEST and size != n:
                continue
            lines = defaultdict(list)
            for a, key, values in forms(text, width):
                for b, other, theirs in own:
                    if key == other:
                        lines[a - b].append((b, values, theirs))
            matched = set()
            for hits in lines.values():
                pairs = {(y, x) for _, xs, ys in hits for x, y in zip(xs, ys, strict=False) if x or y}
                if len(pairs) == len({y for y, _ in pairs}):
                    matched |= {b for b, _, _ in hits}
            if len(matched) >= 0.8 * max(n - 4, 1):
                want.add((k, i, len(matched)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda: {(r.doc_id, r.item_id, r.matched) for r in leaks(docs(spark, rows), bench).collect()}
    assert find() == want and len(want) > 60
    monkeypatch.setattr(d, "MOST_BROADCAST", 10)
    assert find() == want


def test_inconsistent_slots_are_no_copy(spark):
    item = "Add 5 apples to the basket and then take 5 apples out of the basket again and count them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "8")), (2, item.replace("5", "8", 1))]
    assert {r.doc_id for r in leaks(docs(spark, rows), bench).collect()} == {1}


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied."
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = {
        1: "Word one.\nReleased under the MIT License.\nMore", 2: mit, 3: " ".join(bsd), 4: " ".join([*bsd, names]), 5: " ".join(bsd[::-1]), 6: None, 7: "",
        8: "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", 9: "the MIT License is released", 10: "x. " * 40_000 + "RELEASED UNDER THE MIT LICENSE",
    }
    rows = [*texts.items(), (1, texts[1]), (None, texts[1])]
    got = Counter((r.doc_id, r.license) for r in scan_licenses(docs(spark, rows)).collect())
    assert got == Counter([(1, "MIT"), (None, "MIT"), (2, "MIT"), (3, "BSD-2-Clause"), (4, "BSD-3-Clause"), (8, "Apache-2.0"), (8, "CC-BY-NC-4.0"), (10, "MIT")])
    assert scan_licenses(docs(spark, [])).collect() == []


#: Licence texts as they are published (fixed values).
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD2 = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
LGPL = GPL.replace("program", "library").replace("General", "Lesser General")
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
PUBLISHED = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2),
    "LGPL-2.1-or-later": LGPL.format(";", ";", "2.1"), "ISC": ISC, "MPL-2.0": MPL,
}


def wrapped(text, width, leader="", newline="\n"):
    import textwrap

    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    lines = "\n\n".join(textwrap.fill(p, width) if width else p for p in paragraphs).split("\n")
    return newline.join((leader + x).rstrip() for x in lines)


@pytest.mark.parametrize(("width", "leader", "newline"), [(0, "", "\n"), (79, "", "\n"), (60, "# ", "\n"), (70, " * ", "\n"), (72, "// ", "\r\n"), (40, ";; ", "\n"), (79, "  > ", "\n")])
def test_published_licences_wrapped_and_commented(spark, width, leader, newline):
    rows = [(i, f"code();{newline}{wrapped(t, width, leader, newline)}{newline}more code") for i, t in enumerate(PUBLISHED.values())]
    rows.append((99, " ".join(MIT.split()[7:])))
    got = {(r.doc_id, r.license) for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {(i, x) for i, x in enumerate(PUBLISHED)} | {(99, "MIT")}


def test_known_sentences_of_a_rule_may_not_be_far_apart(spark):
    first, rest = MIT.split("The above")
    rows = [(1, f"{first}{'Other words. ' * 20}The above{rest}"), (2, f"{first}{'Other words. ' * 40}The above{rest}")]
    assert [r.doc_id for r in scan_licenses(docs(spark, rows)).collect()] == [1]


def labelled(n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(5, 60))], i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    odd = [(None, "fine words here."), (1000, None), (1001, ""), (1002, "w " * 300_000), (5, rows[5][1])]
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    df = docs(spark, rows + odd)
    model = fit_quality(df, table)
    got = score_quality(df, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 40 and sum(a == b for a, b in out) / len(out) > 0.95
    kept = keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert fit_quality(df, table) == model


def test_quality_without_labels_or_rows(spark):
    rows, _ = labelled(20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(docs(spark, rows), none)
    assert {r.score for r in score_quality(docs(spark, rows), model).collect()} == {0.5}
    assert score_quality(docs(spark, []), model).collect() == []


def test_hinge_model_is_the_one_of_a_plain_solver():
    """The same margins as from projected gradient steps on the whole dual problem."""
    from ribospark.llm.quality import DIMS

    rows, labels = labelled(60)
    rng = random.Random(2)
    labels = [(i, v if rng.random() < 0.85 else 1 - v) for i, v in labels]  # not separable
    known = {}
    found, y = [ngrams(t, known) for _, t in rows], np.array([v for _, v in labels])
    model = fit(found, y, epochs=3000)
    margins = np.array([model.margin(f, np.frombuffer(model.weights)) for f in found])
    train = np.arange(len(found)) % 5 != 4
    counts = np.ones((2, DIMS))
    for f, v in zip(np.array(found, object)[train], y[train], strict=True):
        counts[v, f.astype(int)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((len(found), DIMS))
    for i, f in enumerate(found):
        x[i, f] = ratio[f] / np.sqrt(len(f))
    kernel, sign = x @ x.T + 1, np.where(y == 1, 1.0, -1.0)
    q = (kernel * np.outer(sign, sign))[np.ix_(train, train)]
    alpha, step = np.zeros(train.sum()), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, 1)
    want = kernel[:, train] @ (alpha * sign[train])
    assert np.abs(margins - want).max() < 0.02 and 0 < ((alpha > 0) & (alpha < 1)).sum()


def test_ngrams_cover_the_whole_text():
    base = "plain words " * 500_000
    assert set(ngrams(base + "ODD%%%", {})) > set(ngrams(base, {}))
