"""Notices next to each other, broken by line ends, and of templates that a caller gives."""

import random

from hazmill.llm import licenses


def found(spark, texts, templates=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[m["license"] for m in r["matches"]] for r in sorted(licenses.license_matches(rows, templates).collect())]


def test_adjacent_and_wrapped_notices(spark):
    texts = [
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        "Licensed under CC BY 4.0.\nThis work is licensed under the GNU General Public License, version 2.\nReleased under the ISC License.",
        "This is free and unencumbered software released into the public\ndomain.",
        "Text.\nRedistribution and\nuse in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:",
        "Released under\nthe MIT\nLicense.",
        "Nothing of that kind.",
    ]
    assert found(spark, texts) == [["MIT", "Apache-2.0"], ["CC-BY-4.0", "GPL-2.0", "ISC"], ["Unlicense"], ["BSD"], ["MIT"], []]


def test_templates_of_the_caller(spark):
    own = [("House", "Members of the house may read and copy this text at will.")]
    assert found(spark, ["Hello.\nMembers of the house may read\nand copy this text at will.\nBye."], own) == [["House"]]


def test_whole_texts(spark):
    wrap = lambda t: "\n".join(" ".join(w) for w in zip(*[iter(t.split() + [""] * 7)] * 8, strict=False))
    texts = [f"Copyright 2020 Some One\n\n{wrap(t)}\n\nint main;" for _, t in licenses.TEXTS]
    got = found(spark, texts)
    assert all(name in g for (name, _), g in zip(licenses.TEXTS, got, strict=True))
    assert "BSD-3-Clause" not in got[1] and "BSD-2-Clause" not in got[2]


def test_winners_are_those_of_every_template_on_every_block():
    """Against plain comparison of each block's words with each template: the winner has its wording and none with that wording saves more."""
    rng = random.Random(8)
    every = [*licenses.TEMPLATES, *licenses.TEXTS]
    matcher = licenses.Matcher(every)
    filler = "the cat sat on a mat and license plates are copyright of nobody in the public garden".split()
    n_found = 0
    for _ in range(60):
        name, wording = rng.choice(every)
        words = wording.split()
        for _ in range(rng.choice([0, 0, 1, 4, 30])):
            words[rng.randrange(len(words))] = rng.choice(filler)
        text = " ".join([*rng.choices(filler, k=rng.randrange(6)), *words, *rng.choices(filler, k=rng.randrange(6))])
        block = licenses._words(text)
        fits = [k for k, (_, template, _) in enumerate(matcher.templates) if matcher.differences(block, template) is not None]
        saving = {k: x for x, k in matcher.ranked(text)}
        best = matcher.best(text, block)
        fits = [k for k in fits if saving[k] > 0]
        assert (best is None) == (not fits)
        if fits:
            n_found += 1
            top = max(saving[k] for k in fits)
            assert best[0]["saving"] == round(top, 6) and best[0]["license"] in {every[k][0] for k in fits if saving[k] == top}
    assert n_found > 20


def test_notices_in_long_blocks_and_their_places():
    """A short notice saves nothing of a long block, and is found all the same, where it stands."""
    rng = random.Random(3)
    matcher = licenses.Matcher([*licenses.TEMPLATES, *licenses.TEXTS])
    filler = "the cat sat on a mat and copyright plates are copyright of nobody in the garden of copyright owners".split()
    for size in (400, 2000, 4000):
        for _ in range(3):
            before, after = (". ".join(" ".join(rng.choices(filler, k=9)) + " copyright" for _ in range(size // 20)) for _ in range(2))
            text = f"{before}. Released under the MIT License. {after}. Licensed under the Apache License, Version 2.0."
            got = matcher.scan(text)
            assert [m["license"] for m in got] == ["MIT", "Apache-2.0"]
            assert [text[m["start"] : m["end"]] for m in got] == ["Released under the MIT License", "Licensed under the Apache License, Version 2.0"]
