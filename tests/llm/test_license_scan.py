import random

from pyspark.sql import functions as F

from heathgrid.llm import license_scan as s


def brute(text, templates, threshold):
    found = {}
    for line in text.split("\n"):
        block = set(s.words_of(line))
        for k, x in templates.items():
            words = set(s.words_of(x))
            if len(words & block) / len(words) >= threshold - 1e-12:
                found[k] = max(found.get(k, 0), len(words & block) / len(words))
    return found


def test_join_equals_brute_force():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{i}": " ".join(rng.sample(vocabulary, rng.randint(1, 12))) for i in range(15)}
    hits = 0
    for threshold in (0.5, 0.8, 1.0):
        join = s.Join(templates, {w: rng.randint(0, 9) for w in vocabulary}, threshold)
        for _ in range(500):
            block = " ".join(rng.sample(vocabulary, rng.randint(0, 25)))
            want = brute(block, templates, threshold)
            assert join.matches(set(s.words_of(block))) == want
            hits += len(want)
    assert hits > 500


def naive_places(words):
    return [(i, v) for k, v in s.PHRASES.items() for p in [k.split()] for i in range(len(words)) if words[i : i + len(p)] == p]


def test_places_overlap_and_ignore_what_stands_between_words():
    for text in ("CC-BY cc by by cc\nBY", "General Public License; general public license", "all rights reserved" * 2, "", "xcc by"):
        words = s.words_of(text)
        assert sorted(s.places(f" {' '.join(words)} ", s.PHRASES)) == sorted(naive_places(words))


def test_scan(documents):
    texts = [
        "Hello there.\nThis work is licensed under the GNU General Public License, version 3.",
        "Released under the MIT License.\nAll rights reserved. All Rights Reserved", "", None, "été { cc | by }", "nothing here", "x " * 40_000 + "CC BY",
    ]
    docs = documents(*texts, (5, "nothing here", None, None)).withColumn("labels", F.lit("clash"))
    found = {r.doc_id: r for r in s.scan(docs).collect()}
    assert s.scan(docs).count() == 8
    assert (found[0].n_words, found[0].n_base, found[0].first_word, found[0].base_labels, found[0].score) == (14, 1, 9, "gpl", 1.0)
    assert "gpl-3.0" in found[0].labels.split(",")
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels, found[1].labels) == (2, 5, 8, "reserved", "mit,reserved")
    for i in (2, 3):
        assert (found[i].n_words, found[i].first_word, found[i].labels, found[i].score) == (0, None, "", 0.0)
    assert (found[4].n_base, found[4].first_word) == (1, 1)
    assert (found[5].n_base, found[5].score) == (0, 0.0)
    assert (found[6].first_word, found[6].last_word) == (40_000, 40_000)
    assert s.scan(docs.limit(0)).count() == 0


def test_blocks_equal_brute_force():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = {f"t{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 8))) for i in range(8)}
    apart = {k: ({rng.choice(v.split())}, {rng.choice(vocabulary)} - set(v.split())) for k, v in templates.items() if rng.random() < 0.6}
    join, hits = s.Join(templates, {}, 0.8, apart), 0
    for _ in range(400):
        words = [rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.randint(0, 40))]
        want = {}
        for k, v in templates.items():
            own, (needed, barred) = set(v.split()), apart.get(k, (set(), set()))
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + join.room[k]) + 1):
                    block = set(words[a:b])
                    share = len(own & block) / len(own)
                    if share >= 0.8 - 1e-12 and needed <= block and not barred & block:
                        want[k] = max(want.get(k, 0), share)
        assert join.block_matches(words) == want
        hits += len(want)
    assert hits > 100


def test_wrapped_notices_and_near_equal_templates(documents):
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit-text",
        "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without\nfee is hereby granted": "isc",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.": "cc-by,cc-by-nc-4.0,cc-by-sa-4.0",
        "Released under the BSD License.": "", "mit " + "x " * 5_000 + "released under the " + "x " * 5_000 + "license": "",
    }
    cases |= {s.TEMPLATES[k]: f"{k},gpl" if "gpl" in k and k != "gpl" else k for k in ("agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl", "mit", "apache-2.0", "mpl-2.0", "unlicense", "cc0-1.0", "bsd")}
    cases["This work is licensed under the GNU Lesser General Public License, version 3."] = "gpl,lgpl"
    found = {r.doc_id: r.labels for r in s.scan(documents(*cases)).collect()}
    assert [found[i] for i in range(len(cases))] == [",".join(sorted(filter(None, v.split(",")))) for v in cases.values()]


def test_names_are_no_chance_words_and_versions_are_told_apart(documents):
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    cases = {
        "He was at MIT and then released the work under a license": "",
        "The MIT group released the data under a new law. The license came later": "",
        "released under the mit campus roof with license plates": "",
        "the permission of any person to copy this software is granted free of charge and the documentation files were obtained": "",
        "Licensed under the GNU General Public License, version 2. Chapter 3 begins": "gpl,gpl-2.0",
        "Chapter 3. Version 2 of the GNU General Public License, version 3": "gpl,gpl-3.0",
        header.format("", 3): "gpl,gpl-3.0", header.format("", 2): "gpl,gpl-2.0", header.format("Lesser ", "2.1"): "gpl,lgpl", header.format("Affero ", 3): "agpl-3.0,gpl",
        "GNU General Public License version 3": "gpl,gpl-3.0", "The MIT License (MIT)": "mit", "licensed under MIT License": "mit",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "// SPDX-License-Identifier: AGPL-3.0": "agpl-3.0",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "BSD 3-Clause License": "bsd-3-clause", "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0", "CC BY 4.0": "cc-by,cc-by-4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0", "Mozilla Public License Version 2.0": "mpl-2.0",
    }
    found = {r.doc_id: r.labels for r in s.scan(documents(*cases)).collect()}
    assert {k: found[i] for i, k in enumerate(cases)} == cases


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scan_equals_every_block_looked_at(documents):
    rng = random.Random(8)
    keys = {(k, i): x for k, v in s.TEMPLATES.items() for i, x in enumerate([v, *s.FURTHER.get(k, [])])}
    told, texts = s.apart(keys), []
    for k, x in keys.items():
        words = s.words_of(x)
        for rate in (0, 0.04, 0.12):
            edited = [rng.choice(["foo", "version", "license", "2", "3", w[::-1]]) if rng.random() < rate else w for w in words if rng.random() >= rate / 2]
            at = rng.randrange(len(edited) + 1)
            texts.append(" ".join(["so", "the", *edited[:at], *(["bar"] if rng.random() < 0.3 else []), *edited[at:], "and", "license"]))
    texts += [f"{rng.choice(texts)}\n{rng.choice(texts)}" for _ in range(20)]
    found, hits = {r.doc_id: (r.labels, r.score) for r in s.scan(documents(*texts)).collect()}, 0
    for n, text in enumerate(texts):
        words = s.words_of(text)
        base = {v for _, v in naive_places(words)}
        labels, score = set(base), 1.0 if base else 0.0
        for k, x in keys.items():
            own = s.words_of(x)
            (needed, barred), span = told[k], len(own) + len(own) // 4
            for a in range(len(words)):
                block = words[a : a + span]
                block = block[: next((i for i, w in enumerate(block) if w in barred), len(block))]
                same = len(set(own) & set(block)) / len(set(own))
                if same >= 0.8 - 1e-12 and needed <= set(block):
                    share = longest(own, block) / len(own)
                    if share >= 0.8 - 1e-12:
                        labels.add(k[0])
                        score = max(score, share)
        assert found[n] == (",".join(sorted(labels)), score), text
        hits += len(labels - base)
    assert hits > 100
