import random

import numpy as np
import pytest

from watchline.llm.licenses import ALIKE, NONE, NOTICES, OTHERS, PLAIN, SURE, UNKNOWN, classifier, grams, licenses, split


def label(text):
    """Class of a paragraph, in plain Python."""
    weights, bias = classifier()
    w = split(text)
    found = [g for g in grams(w) if g in weights]
    if not found:
        return NONE
    z = np.array(bias) + sum(np.array(weights[g]) for g in found)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    best = int(p.argmax())
    if best < len(NOTICES) and p[best] >= SURE:
        family = list(NOTICES)[best]
        for notice in NOTICES[family]:
            n = set(split(notice))
            common = len(set(w) & n)
            if common >= 2 and common / min(len(set(w)), len(n)) >= ALIKE:
                return family
    return UNKNOWN if p[-1] < PLAIN else NONE


def brute(text):
    done = []
    for at, line in enumerate((text or "").split("\n")):
        family = label(line)
        if family == NONE:
            continue
        if done and at == done[-1][0] + 1 and (family == done[-1][2] or UNKNOWN in (family, done[-1][2])):
            _, before, known = done[-1]
            done[-1] = (at, before + " " + line, family if known == UNKNOWN else known)
        else:
            done.append((at, line, family))
    final = [(label(line) or UNKNOWN) if family == UNKNOWN and " " in line else family for _, line, family in done]
    known = [f for f in final if f != UNKNOWN]
    return ",".join(sorted(set(known))), len(known), len(final) - len(known)


def wrapped(text, width=6):
    w = text.split()
    return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))


def corpus():
    rng = random.Random(3)
    lines = [x for texts in NOTICES.values() for x in texts] + ["The license of the dog", "plain words here", "", "See the licence for all rights", "Copyright", "Licensed under the Zarvo License"]
    return [(i, "\n".join(rng.choice([x, x.upper(), f"anea {x} the tion", wrapped(x)]) for x in rng.choices(lines, k=rng.randint(0, 4)))) for i in range(80)]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.families, r.n_known, r.n_unknown) for r in sorted(licenses(docs).collect(), key=lambda r: r.doc_id)]


def test_same_as_plain_python(spark):
    docs = corpus() + [(None, "Released under the MIT License."), (500, None), (501, "")]
    docs += [docs[3], (502, "\n".join(t for _, t in docs[:80]) * 3)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, at int")
    got = sorted((tuple(r) for r in licenses(frame).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in docs), key=repr)


def test_every_notice_is_recognised(spark):
    """Alone, in the middle of a text, and with hard line ends."""
    for form in (lambda t: t, lambda t: f"Anea thon re.\n{t}\nOnti the ver.", lambda t: wrapped(t, 12)):
        for family, texts in NOTICES.items():
            for text, (families, known, _) in zip(texts, scan(spark, [form(t) for t in texts]), strict=True):
                assert families == family and known == 1, (family, text)


def test_unknown_licences(spark):
    """Notices of licences that the classifier was never shown, and texts that are no notices."""
    held_out = [
        "Licensed under the European Union Public Licence 1.2",
        "This font is licensed under the SIL Open Font License, Version 1.1",
        "Distributed under the Boost Software License, Version 1.0.",
        "This code is released under the zlib license",
        "SPDX-License-Identifier: Unlicense",
        "Licensed under the Educational Community License",
        "Released under the PostgreSQL License",
        "This package is licensed under the Ruby license",
    ]
    plain = ["The bridge was released to the public", "He was granted a fishing permit by the town", "The author owns a house", "Free tickets for the general public", "Anea thon re ver tionet", "Version 3 of the plan", "under the terms of the treaty", "This work is the best", "Use of this source"]
    got = scan(spark, held_out)
    assert sum(g == ("", 0, 1) for g in got) >= 7, list(zip(held_out, got, strict=True))
    assert scan(spark, plain + OTHERS) == [("", 0, 0)] * (len(plain) + len(OTHERS))


def test_probabilities_are_calibrated():
    """Of held-out paragraphs, those of a class's probability of 0.7 and more are of it about as often as it says."""
    from watchline.llm.licenses import paragraphs

    weights, bias = classifier()
    rows, labels = paragraphs(random.Random(123), 60)
    z = np.array([np.array(bias) + sum((np.array(weights[g]) for g in grams(r) if g in weights), np.zeros(len(bias))) for r in rows])
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    sure = p.max(1) >= SURE
    right = p.argmax(1) == np.array(labels)
    assert sure.mean() > 0.8
    assert right[sure].mean() == pytest.approx(p.max(1)[sure].mean(), abs=0.05)


def test_no_python_on_the_path(spark):
    plan = licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
