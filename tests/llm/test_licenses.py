import random
import re
import time

from fieldloom.llm import license_rules as L
from fieldloom.llm import license_texts as T

from .helpers import ODD, alnum, documents, wide

TEXTS = [
    *ODD,
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "cc-by CC by, cc\nBY soccer by; cc by-nc 4.0",
    "GNU General Public License v3 or any later version",
    "This is general public license all all rights reserved",
    "SPDX-License-Identifier: MIT",
    "allrights reserved; all rights preserved; general public licenses",
    "éall rights reservedé", "all – rights … reserved", "Copyright (c) 2020 Foo.",
]


def brute(text):
    w = alnum(text)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            # an ellipsis or a dash beyond ASCII is a word by the contract's classes
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_by_brute_force(spark):
    frame = wide(documents(spark, TEXTS))
    rows = {r["doc_id"]: r for r in L.license_scan(frame).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    assert L.license_scan(frame.limit(0)).count() == 0


def test_rules_are_many_and_gated():
    rules = L.rules()
    assert len(rules) >= 300
    scan = L.scanner()
    for rule, pattern in zip(scan.rules, scan.patterns, strict=True):
        # a rule's text, with every optional word, is detected by the rule and holds its keyword
        words = []
        for token in re.findall(r"\([^)]*\)\??|\S+", rule.words):
            inner = token.rstrip("?").strip("()").split("|")[0].strip()
            words.append("7" if inner == "#" else inner)
        text = " ".join(words)
        assert pattern.search(text.encode()), rule
        assert rule.keyword in text, rule


def labels(text):
    return [r.label for *_, r in L.scanner().detections(text.lower().encode())[1]]


def test_priority_and_containment():
    assert labels("Licensed under the Apache License, Version 2.0") == ["apache-2"]
    assert labels("the GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("GNU GPL and the MIT License") == ["gpl", "mit"]
    assert labels("CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"]
    a, b = L.Rule("a", "x", "x", 1, 1.0), L.Rule("b", "y", "y", 2, 1.0)
    assert L.resolve([(0, 5, b), (0, 5, a), (2, 4, b), (4, 8, b)]) == [(0, 5, a), (4, 8, b)]


def test_resolution_by_brute_force():
    g = random.Random(3)
    for _ in range(200):
        found = []
        for k in range(g.randrange(30)):
            a = g.randrange(12)
            found.append((a, a + g.randrange(1, 8), L.Rule(str(k), "x", "x", g.randrange(3), 1.0)))
        order = sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0]))
        kept = [x for i, x in enumerate(order) if not any(y[0] <= x[0] and x[1] <= y[1] for y in order[:i])]
        assert L.resolve(found) == sorted(kept, key=lambda x: x[:2])


def test_time_is_linear_in_notices():
    def seconds(n):
        text = b"copyright 2020 x all rights reserved " * n
        began = time.perf_counter()
        L.scanner().detections(text)
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(8_000) for _ in range(2)) < 16 * min(seconds(1_000) for _ in range(3))


def test_signatures_are_hand_written_sentences():
    held = T.signatures()
    assert len(held) >= 250 and len({words for _, words, *_ in held}) == len(held)
    assert labels("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.")[0] in ("isc", "0bsd", "curl")
    assert "agpl-3" in labels("Your modified version must prominently offer all users interacting with it remotely through a computer network (if ...)")
    assert labels("The Software shall be used for Good, not Evil.") == ["json"]
    assert labels("Alle Rechte vorbehalten") == ["reserved-long"]
