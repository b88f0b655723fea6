"""The license scan against plain Python."""

import re

from lumenfold.llm import licenses

GPL = licenses.TEMPLATES[2][0]
PROSE = "one two three the of this work and file is a copy to any in with for as software public under free "


def brute(text, least=licenses.LEAST):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base, shares = {label for _, label in places}, {}
    for template, label in licenses.TEMPLATES:
        want, width = set(template.split()), 1
        while width < len(template.split()):
            width *= 2
        for at in range(0, len(words), width):
            share = len(want & set(words[at : at + 2 * width])) / len(want)
            if share * least[1] >= least[0] - 1e-12:
                shares[label] = max(share, shares.get(label, 0))
    at = [i for i, _ in places]
    score = 1.0 if at else max(shares.values(), default=0.0)
    ends = (min(at), max(at)) if at else (None, None)
    return (len(words), len(at), *ends, ",".join(sorted(base)), ",".join(sorted(base | set(shares))), round(score, 12))


def scanned(spark, rows, schema="doc_id bigint, text string, key string, blocks int, label string"):
    docs = spark.createDataFrame([(*r, "a", 1, None) for r in rows], schema)
    return sorted(((r[0], *r[1:7], round(r[7], 12)) for r in licenses.license_scan(docs).collect()), key=repr)


def test_equals_plain_python(spark):
    longest = PROSE * 4000 + GPL + " " + PROSE * 4000
    texts = [None, "", " \n", "...", "Released under the MIT License.", "MIT", "under the\nMIT  licenſe", "CC BY-NC, cc by nc cc by nc",
             GPL.upper(), GPL.replace("version 3", ""), GPL.replace("gnu general public", ""), PROSE * 3 + GPL, longest, "Apache License, Version 2.0 " * 500,
             licenses.TEMPLATES[3][0].replace(" the ", "\nTHE\n"), "été " * 20 + licenses.TEMPLATES[4][0], PROSE * 50]
    texts += [" ".join(t.split()[::-1][: len(t.split()) - cut]) for t, _ in licenses.TEMPLATES for cut in range(6)]
    rows = list(enumerate(texts)) + [(4, texts[4])] * 2 + [(None, GPL), (None, None)]
    assert scanned(spark, rows) == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert scanned(spark, []) == []


def test_prose_has_no_label(spark):
    assert {r[6] for r in scanned(spark, [(i, PROSE * i) for i in range(20)])} == {""}


def test_many_copies_of_one_line(spark):
    rows = [(i, f"{PROSE * (i % 3)}\n{GPL}") for i in range(400)]
    assert scanned(spark, rows) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
