from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest
from linetally.llm import divergence, licences

PROSE = "the quick brown fox and the lazy dog went to the river of the old town in search of a quiet place to rest and dream"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(PROSE.split()) for _ in range(n))


def quality_rows(rng: random.Random) -> list[tuple[int, str | None, str | None]]:
    rows: list[tuple[int, str | None, str | None]] = [(0, None, "en"), (1, "", "en"), (2, " \n\t", None)]
    rows += [(i + 3, prose(rng, rng.randrange(5, 300)) + ("\n" + prose(rng, 9)) * rng.randrange(3), "en") for i in range(60)]
    rows += [(100 + i, "\n".join(rng.choice(["a b c", "", " ", "x | y", "long line of # text"]) for _ in range(rng.randrange(30))), "de") for i in range(30)]
    rows += [(200, "word " * 100, "en"), (201, "$$$ ### %%% " * 60, "en"), (202, "\u00a0é\u00a0 ñ\x1cx " * 30, None), (200, prose(rng, 50), "en")]
    block = "one two three four five six seven eight"
    return [*rows, (203, f"{block} mid {block} nine ten eleven twelve thirteen", "en"), (204, " ".join(f"w{i}" for i in range(19)), "en")]


def test_base_counts_against_brute_force(spark):
    rows = quality_rows(random.Random(1))
    docs = spark.createDataFrame([(d, t, x, 0) for d, t, x in rows], "doc_id long, text string, lang string, kept int").repartition(3)
    got = divergence.judge(docs, divergence.references(docs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["id"], *[r[n] for n in names]) for r in got) == sorted((d, *brute.base_quality(t)) for d, t, _ in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_verdicts_and_references(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 150), "en") for i in range(200)]
    odd = [(900, " ".join(f"{w}$#" for w in prose(rng, 150).split()), "en"), (901, prose(rng, 150).upper().replace(" ", "!! "), "en"), (902, " ".join(f"q{i}x" for i in range(150)), "en")]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    found = divergence.references(docs)
    (_, classes, common, total, count), = found
    assert count == len(good + odd)
    assert total == sum(len(t.split()) if i != 900 else 150 for i, t, _ in good + odd)
    words = " ".join(t.lower() for _, t, _ in good + odd)
    assert common[b"the"] == sum(w.strip("$#!") == "the" for w in words.split())
    assert classes.sum() == sum(len(t) for _, t, _ in good + odd)
    kept = {r["id"]: r["kept"] for r in divergence.judge(docs, found).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i in (900, 901, 902))
    # short texts are guarded, and without references all distances are 0
    short = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(25)))], "doc_id long, text string")
    assert divergence.judge(short, found).collect()[0]["kept"] is True
    assert divergence.judge(short, []).collect()[0]["class_distance"] == 0
    assert divergence.references(docs.limit(0)) == [] and divergence.judge(docs.limit(0), found).count() == 0


def test_every_language_has_a_reference(spark):
    rng = random.Random(5)
    rows = []
    for i in range(140):
        own = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in PROSE.split()]
        rows += [(i * 10 + k, " ".join(rng.choice(own) for _ in range(260 - i)), f"l{i}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = divergence.references(docs, least_words=1, least_docs=1)
    assert len(found) == 140
    assert all(r["kept"] for r in divergence.judge(docs, found).collect())
    docs = docs.drop("lang")
    got = {r["id"]: r for r in divergence.judge(docs, found).collect()}
    assert all(r["kept"] for r in got.values())
    # the nearest of all is the nearer one of the nearest of two parts
    parts = [{r["id"]: r for r in divergence.judge(docs, part).collect()} for part in (found[:50], found[50:])]
    for name in ("class_distance", "word_distance"):
        assert all(r[name] == min(p[i][name] for p in parts) for i, r in got.items())


def plain_distance(p: dict, q: dict) -> float:
    p_all, q_all, out = sum(p.values()), sum(q.values()), 0.0
    if not p_all:
        return 1.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / p_all, q.get(k, 0) / q_all
        m = (x + y) / 2
        out += sum(v * np.log2(v / m) for v in (x, y) if v) / 2
    return float(np.sqrt(max(0.0, min(1.0, out))))


def plain_histograms(text: str) -> tuple[dict, dict]:
    chars: dict = {}
    for c in text:
        k = int(divergence._CLASS[c.encode()[0]])
        chars[k] = chars.get(k, 0) + 1
    counts: dict = {}
    for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", brute.lower(text)):
        counts[w] = counts.get(w, 0) + 1
    return chars, counts


def plain_kept(rows: list[tuple[int, str | None, str | None]], least_words: int, least_docs: int, common: int = 48) -> list[tuple]:
    refs: dict = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            chars, counts, n = refs.setdefault(lang, ({}, {}, [0]))
            n[0] += 1
            for into, own in zip((chars, counts), plain_histograms(text), strict=True):
                for k, v in own.items():
                    into[k] = into.get(k, 0) + v
    refs = {x: (chars, counts) for x, (chars, counts, n) in refs.items() if n[0] >= least_docs and sum(counts.values()) >= least_words}
    out = []
    for d, text, lang in rows:
        chars, counts = plain_histograms(text or "")
        by_class, by_word = [], []
        for x in [lang] if lang in refs else refs:
            top = sorted(refs[x][1], key=lambda w: (-refs[x][1][w], w.encode()))[:common]
            fold = lambda h: {w: h.get(w, 0) for w in top} | {None: sum(v for w, v in h.items() if w not in top)}  # noqa: B023, E731
            by_class.append(plain_distance(chars, refs[x][0]))
            by_word.append(plain_distance(fold(counts), fold(refs[x][1])))
        n, *_, failed = brute.base_quality(text)
        slack = 1 / np.sqrt(max(n, 1))
        near = n < 40 or (min(by_class, default=0) <= 0.16 + slack and min(by_word, default=0) <= 0.33 + slack)
        out.append((d, not failed and near))
    return sorted(out, key=str)


def test_verdicts_against_brute_force(spark):
    rng = random.Random(8)
    rows = quality_rows(rng) + [(300 + i, prose(rng, rng.randrange(200)).upper(), rng.choice(["en", "fr", None])) for i in range(20)]
    rows += [(400 + i, " ".join(f"m{rng.randrange(30)}" for _ in range(90)), "xx") for i in range(25)] + [(500, prose(rng, 90), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for least_words, least_docs in ((1, 1), (300, 20), (10**9, 1)):
        found = divergence.references(docs, least_words=least_words, least_docs=least_docs)
        got = sorted(((r["id"], r["kept"]) for r in divergence.judge(docs, found).collect()), key=str)
        assert got == plain_kept(rows, least_words, least_docs)


def test_a_small_label_is_no_reference_for_itself(spark):
    """A stray label neither admits its own junk nor the same junk under other labels."""
    rng = random.Random(9)
    junk = " ".join(f"q{i}$#" for i in range(150))
    rows = [(i, prose(rng, 150), "en") for i in range(200)] + [(900, junk, "zz"), (901, junk, "en"), (902, junk, None), (903, prose(rng, 150), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = divergence.references(docs)
    assert [r.lang for r in found] == ["en"]
    kept = {r["id"]: r["kept"] for r in divergence.judge(docs, found).collect()}
    assert not any(kept[i] for i in (900, 901, 902)) and kept[903] and all(kept[i] for i in range(200))


def test_distance():
    p = np.array([[1, 1, 0], [0, 0, 5], [0, 0, 0], [3, 3, 0]])
    got = divergence.distance(p, np.array([1, 1, 0]))
    assert got == pytest.approx([0, 1, 1, 0])
    half = divergence.distance(np.array([[1, 0]]), np.array([1, 1]))[0]
    assert half == pytest.approx(np.sqrt((np.log2(4 / 3) + 0.5 * np.log2(2 / 3) + 0.5) / 2))


NOTICES = [
    None,
    "",
    "!?",
    "Released under the MIT License.",
    "(c) under the MIT-license, under the mit_license; Apache License, Version 2.0 CC BY-NC CC by\nnc",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "the license of the general public is not a gnu license version",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "prefix words Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
    "redistribution source forms binary and met conditions following the that provided",
    "under the M\u0130T License under the mit\u212a license",
    "licensed under the creative commons attribution 4.0 international license",
]


def test_licences_against_brute_force(spark):
    rng = random.Random(3)
    filler = "lorem the of under license version by mit cc nc apache 2 and in to".split()
    texts = NOTICES + [" ".join(rng.choice(filler) for _ in range(rng.randrange(200))) for _ in range(80)]
    texts += [f"{prose(rng, 30)} {NOTICES[3]} {prose(rng, 20000)} {NOTICES[3]}"]
    rows = [(i, t, "w", "p") for i, t in enumerate(texts)] + [(3, texts[3], "w", "p"), (None, texts[4], "w", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, present string").repartition(3)
    got = licences.scan(docs, licences.rarity(docs)).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    have = sorted(((r["id"], *[r[n] for n in names]) for r in got), key=str)
    assert have == sorted(((d, *brute.base_licences(t)) for d, t, *_ in rows), key=str)
    labels = {r["id"]: r["labels"] for r in got}
    assert [labels[i] for i in range(len(NOTICES))] == ["", "", "", "mit", "apache-2,cc-by-nc,mit", "gpl,gpl-3", "apache-2", "", "mit", "bsd", "", "", "cc-by"]
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


def test_licence_words_beyond_the_basic_plane(spark):
    """Emoji, rare ideographs and mathematical letters are words, or parts of them, like all beyond ASCII."""
    far = ["\U0001F600", "\U00020000", "\U0001D400", "\U0010FFFF", "\uffff", "\u0080"]
    texts = [f"hi {x} there" for x in far] + [f"under the{x} mit license" for x in far] + [f"under the {x} mit license" for x in far]
    texts += [f"{x} under the MIT license {x}" for x in far] + [f"{x}under the mit license" for x in far] + [f"x{x}, Apache License: version 2{x} cc by nc" for x in far]
    texts += [x for x in far] + [f"a{chr(b)}cc{chr(b)}by{chr(b)}nc{chr(b)}\U0001F600" for b in range(128)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = licences.scan(docs, licences.rarity(docs)).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((r["id"], *[r[n] for n in names]) for r in got) == sorted((i, *brute.base_licences(t)) for i, t in enumerate(texts))
    labels = {texts[r["id"]]: r["labels"] for r in got}
    assert labels["under the\U0001F600 mit license"] == "" and labels["\U0001F600 under the MIT license \U0001F600"] == "mit"


def template_labels(text: str) -> str:
    """Labels by trying every beginning in plain Python, with base phrases."""
    words = brute.PLAIN.findall(brute.lower(text))
    labels = set(filter(None, brute.base_licences(text)[-1].split(",")))
    for t in licences.TEMPLATES:
        own = t.text.split()
        for s in range(-len(own), len(words)):
            share = sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(own)) / len(own)
            near = [words[i : i + len(k.split())] for k in t.keys for i in range(max(0, s - 2), max(0, s + len(own) + 3))]
            if share >= licences.LEAST_SHARE and all(k.split() in near for k in t.keys):
                labels.add(t.label)
    return ",".join(sorted(labels))


def test_notices_beside_stray_words(spark):
    """A template's rare words elsewhere in the file, and words changed within a notice, hide no notice."""
    rng = random.Random(6)
    texts = ["Released under the GNU General Public License version 2", "Released under the GNU General Public License version 2. The manual is licensed separately"]
    for t in licences.TEMPLATES:
        own = t.text.split()
        for lost in range(len(own) // 5 + 2):
            for _ in range(3):
                notice = list(own)
                for i in rng.sample(range(len(own)), lost):
                    notice[i] = "zzz"
                stray = [rng.choice(own) for _ in range(6)]
                texts += [" ".join(notice), " ".join([*stray, "x", *notice, "y", *own[-1:], *stray])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["labels"] for r in licences.scan(docs, licences.rarity(docs)).collect()}
    assert got[0] == got[1] == "gpl,gpl-2"
    assert got == {i: template_labels(t) for i, t in enumerate(texts)}


def test_whole_texts_and_tags(spark):
    long = next(t.text for t in licences.TEMPLATES if len(t.text.split()) > 150)
    texts = [long.upper(), "x " + long.replace("software", "program", 3), long[: len(long) // 3], "// SPDX-License-Identifier: GPL-2.0-only", "# SPDX-License-Identifier: Apache-2.0", "SPDX License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["labels"], r["score"]) for r in licences.scan(docs, licences.rarity(docs)).collect()}
    assert [got[i][0] for i in range(6)] == [template_labels(t) for t in texts] == ["mit", "mit", "mit", "gpl-2", "apache-2", ""]
    assert got[0][1] == 1 and got[5][1] == 0


def test_files_look_up_their_own_rarest_words():
    """Whatever positions a file holds, its rarest ones leave no notice without a look-up."""
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randrange(1, 30)
        need = licences.words_needed(n)
        in_place = set(rng.sample(range(n), rng.randrange(need, n + 1)))
        held = [i for i in range(n) if i in in_place or rng.random() < 0.5]
        rng.shuffle(held)  # any order of rarity
        assert in_place & set(held[: max(0, len(held) - need + 1)])


def test_licence_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    scanned = licences.scan(docs, licences.rarity(docs))
    shown = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Exchange" not in shown
    assert licences.scan(docs.limit(0), licences.rarity(docs.limit(0))).count() == 0
