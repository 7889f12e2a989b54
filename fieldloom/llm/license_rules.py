"""License scans by ordered signature rules.

Rules are regular expressions over words: hand-written signatures of licence texts and notices (``license_texts``), and
names, versions and identifier tags of licence families. A keyword automaton runs over each lower-cased text once; only
rules whose keyword occurs are tried. Overlapping detections are resolved in order: a detection inside one of higher
priority, or inside a longer one of equal priority, is suppressed. Base phrases are rules too, but every place of theirs is
reported.

Defined results: null, empty or wordless texts have no words and no detection; very long texts are scanned whole, in time
linear in their length and ``n log n`` in their detections; repeated rows repeat; two rules that detect one span with equal
priority yield the one that comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.license_texts import signatures
from fieldloom.llm.text_kernel import ALNUM, LOWER, relieved, slices, utf8, word_spans

#: Phrases whose every place counts, with their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"


@dataclass(frozen=True)
class Rule:
    label: str
    words: str  # alternatives in (a|b), ? after an optional word, # for a version number
    keyword: str
    priority: int  # lower wins
    weight: float
    base: bool = False


def _families() -> list[tuple[str, list[str], list[str], list[str]]]:
    """Label stem, names as words, versions, and identifier stems of each license family."""
    return [
        ("gpl", ["gnu general public license", "gnu gpl"], ["1", "2", "3"], ["gpl"]),
        ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["2", "2 1", "3"], ["lgpl"]),
        ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["1", "3"], ["agpl"]),
        ("gfdl", ["gnu free documentation license"], ["1 1", "1 2", "1 3"], ["gfdl"]),
        ("apache", ["apache license", "apache software license"], ["1", "1 1", "2"], ["apache"]),
        ("mpl", ["mozilla public license"], ["1", "1 1", "2"], ["mpl"]),
        ("epl", ["eclipse public license"], ["1", "2"], ["epl"]),
        ("cddl", ["common development and distribution license"], ["1", "1 1"], ["cddl"]),
        ("cpl", ["common public license"], ["1"], ["cpl"]),
        ("eupl", ["european union public licence", "european union public license"], ["1", "1 1", "1 2"], ["eupl"]),
        ("artistic", ["artistic license"], ["1", "2"], ["artistic"]),
        ("bsl", ["boost software license"], ["1"], ["bsl"]),
        ("osl", ["open software license"], ["1", "1 1", "2", "2 1", "3"], ["osl"]),
        ("afl", ["academic free license"], ["1 1", "1 2", "2", "2 1", "3"], ["afl"]),
        ("ofl", ["sil open font license", "open font license"], ["1", "1 1"], ["ofl"]),
        ("odbl", ["open database license", "open data commons open database license"], ["1"], ["odbl"]),
        ("odc-by", ["open data commons attribution license"], ["1"], ["odc by"]),
        ("zpl", ["zope public license"], ["1 1", "2", "2 1"], ["zpl"]),
        ("ms-pl", ["microsoft public license"], [], ["ms pl"]),
        ("ms-rl", ["microsoft reciprocal license"], [], ["ms rl"]),
        ("python", ["python software foundation license"], ["2"], ["psf"]),
        ("php", ["php license"], ["3", "3 01"], ["php"]),
        ("ruby", ["ruby license"], [], []),
        ("cecill", ["cecill free software license agreement"], ["1", "1 1", "2", "2 1"], ["cecill"]),
        ("sspl", ["server side public license"], ["1"], ["sspl"]),
        ("busl", ["business source license"], ["1 1"], ["busl"]),
        ("elastic", ["elastic license"], ["2"], ["elastic"]),
        ("mit", ["mit license", "mit licence", "expat license"], [], ["mit"]),
        ("isc", ["isc license", "isc licence"], [], ["isc"]),
        ("zlib", ["zlib license", "zlib libpng license"], [], ["zlib"]),
        ("wtfpl", ["do what the fuck you want to public license"], ["2"], ["wtfpl"]),
        ("unlicense", ["the unlicense"], [], ["unlicense"]),
        ("bsd", ["bsd license", "bsd licence", "berkeley software distribution license"], [], []),
        ("bsd-2", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license", "freebsd license"], [], ["bsd 2 clause"]),
        ("bsd-3", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "revised bsd license", "modified bsd license", "three clause bsd license"], [], ["bsd 3 clause"]),
        ("bsd-4", ["bsd 4 clause license", "4 clause bsd license", "original bsd license"], [], ["bsd 4 clause"]),
        ("intel", ["intel open source license"], [], []),
        ("ibm", ["ibm public license"], ["1"], ["ipl"]),
        ("sun", ["sun industry standards source license"], ["1 1", "1 2"], ["sissl"]),
        ("nasa", ["nasa open source agreement"], ["1 3"], ["nasa"]),
        ("upl", ["universal permissive license"], ["1"], ["upl"]),
    ]


def _key(words: str) -> str:
    """The longest plain word of a rule, or its longest run of two where no word is long."""
    plain = [w for w in words.split() if re.fullmatch(r"[a-z]+", w)]
    return max(plain, key=len)


def rules() -> list[Rule]:
    """All rules in order. Families are expanded by the ways in which a license is named and granted."""
    out = [Rule(label, phrase, max(phrase.split(), key=len), 50, 0.6, True) for phrase, label in BASE.items()]
    for stem, names, versions, ids in _families():
        for name in names:
            for v in versions:
                label = f"{stem}-{v.replace(' ', '.')}"
                head, *tail = v.split()
                number = " ".join([f"({head}|v{head})", *tail] if tail else [f"({head}|v{head})", "0?"])
                out.append(Rule(label, f"{name} (version|v)? {number}", _key(name), 20, 0.95))
                out.append(Rule(label, f"(licensed|released|distributed|available|provided) under (the)? (terms)? (of)? (the)? {name} (version|v)? {number}", _key(name), 10, 1.0))
                out.append(Rule(f"{label}+", f"{name} (version|v)? {number} or (any)? (at)? (your)? (option)? (any)? later (version)?", _key(name), 8, 1.0))
            out.append(Rule(stem, f"(licensed|released|distributed|available|provided) under (the)? (terms)? (of)? (the)? {name}", _key(name), 25, 0.9))
            out.append(Rule(stem, name, _key(name), 30, 0.8))
        for tag in ids:
            out.append(Rule(f"{stem}-tag", f"spdx license identifier {tag}", "spdx", 6, 1.0))
            for v in versions:
                number = v if " " in v else f"{v} 0"
                out.append(Rule(f"{stem}-{v.replace(' ', '.')}", f"spdx license identifier {tag} {number} (only|or)? (later)?", "spdx", 5, 1.0))
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = f"cc-{parts.replace(' ', '-')}"
        long = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
        name = " ".join(long[x] for x in parts.split())
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"cc {parts} {v}", "cc", 12, 1.0))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"creative commons {name} {v} (international|unported|generic)? (public)? (license)?", "creative", 11, 1.0))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"creativecommons org licenses {parts} {v}", "creativecommons", 9, 1.0))
        out.append(Rule(label, f"cc {parts}", "cc", 40, 0.7))
        out.append(Rule(label, f"creative commons {name}", "creative", 35, 0.8))
    out += [
        Rule("cc0", "cc0 (1)? (0)? (universal)?", "cc0", 22, 0.9),
        Rule("cc0", "creativecommons org publicdomain zero 1 0", "publicdomain", 9, 1.0),
        Rule("public-domain", "(released|dedicated|placed|is|are) (in|into|to)? (the)? public domain", "domain", 30, 0.8),
        Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 10, 1.0),
        Rule("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 10, 1.0),
        Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 10, 1.0),
        Rule("bsd-3", "neither the name of the? (copyright)? (holder|organization|author|authors) nor the names of (its|their)? contributors", "neither", 9, 1.0),
        Rule("zlib", "this software is provided as is without any express or implied warranty", "warranty", 12, 0.9),
        Rule("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 8, 1.0),
        Rule("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "verbatim", 14, 0.8),
        Rule("gpl", "this program is free software you can redistribute it and or modify it", "redistribute", 15, 0.9),
        Rule("warranty", "without warranty of any kind", "warranty", 60, 0.4),
        Rule("copyright", "copyright c? # (# )?", "copyright", 60, 0.5),
        Rule("copyright", "copyright (c)? (by)? # ", "copyright", 61, 0.5),
        Rule("proprietary", "(proprietary|confidential) and (proprietary|confidential)", "proprietary", 45, 0.6),
        Rule("proprietary", "unauthorized (copying|use|reproduction|distribution) (of)? (this)? (file|material|document|software)? is? (strictly)? prohibited", "unauthorized", 45, 0.7),
        *(Rule(label, words, keyword, priority, weight) for label, words, keyword, priority, weight in signatures()),
        Rule("licensed", "(licensed|released) under (the)? (terms)? (of)? (a|an|the|this)? (open)? (source)? license", "license", 70, 0.3),
    ]
    return out


def compile_words(words: str) -> re.Pattern[bytes]:
    """A rule's words as a pattern over lower-cased UTF-8, between word edges."""
    pattern, begun = b"", False
    for token in re.findall(r"\([^)]*\)\??|\S+", words):
        optional = token.endswith("?") or (token.startswith("(") and "|" not in token)
        inner = token.rstrip("?")
        if inner.startswith("("):
            inner = inner[1:-1].strip()
        one = b"|".join(rb"[0-9]+" if x.strip() == "#" else re.escape(x.strip().encode()) for x in inner.split("|"))
        if not begun:
            pattern += rb"(?:(?:" + one + rb")" + _GAP + rb")?" if optional else rb"(?:" + one + rb")"
            begun = not optional
        else:
            step = _GAP + rb"(?:" + one + rb")(?!" + _WORD + rb")"
            pattern += rb"(?:" + step + rb")?" if optional else step
    return re.compile(rb"(?<!" + _WORD + rb")" + pattern + rb"(?!" + _WORD + rb")")


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.patterns = [compile_words(r.words) for r in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        self.gate = ahocorasick.Automaton()
        for keyword, found in by_keyword.items():
            self.gate.add_word(keyword, tuple(found))
        self.gate.make_automaton()

    def detections(self, text: bytes) -> tuple[list[tuple[int, int, Rule]], list[tuple[int, int, Rule]]]:
        """Base places, and the other detections that no better one suppresses, of a lower-cased text, by byte."""
        tried = sorted({i for _, found in self.gate.iter(text.decode()) for i in found})
        base, own = [], []
        for i in tried:
            rule = self.rules[i]
            for m in self.patterns[i].finditer(text):
                (base if rule.base else own).append((m.start(), m.end(), rule))
        return base, resolve(own)


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections in page order, without those inside one of higher priority or inside a longer one of equal priority.

    The better come first. Containment carries over, so a detection goes where any better one, kept or not, contains it:
    where the furthest end among those that begin at or before it, held in a tree of prefix maxima, reaches its end.
    """
    starts = sorted({a for a, _, _ in found})
    place = {a: k + 1 for k, a in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for a, b, rule in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0])):
        k, end = place[a], -1
        while k:
            end = max(end, furthest[k])
            k &= k - 1
        if end >= b:
            continue
        kept.append((a, b, rule))
        k = place[a]
        while k < len(furthest):
            furthest[k] = max(furthest[k], b)
            k += k & -k
    return sorted(kept, key=lambda x: x[:2])


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame) -> DataFrame:
    """Words, base places and labels of each row of ``docs(doc_id, text)``; the score is the surest detection's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            rows: list[tuple] = []
            for lo, hi in slices(offsets):
                part, at = LOWER[raw[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                starts, _, first = word_spans(part, at, ALNUM)
                data = part.tobytes()
                for k in range(hi - lo):
                    text = data[at[k] : at[k + 1]]
                    words = starts[first[k] : first[k + 1]] - at[k]
                    base, own = scan.detections(text) if len(words) else ([], [])
                    places = np.searchsorted(words, sorted(a for a, _, _ in base)).tolist()
                    base_labels = sorted({r.label for *_, r in base})
                    labels = sorted({*base_labels, *(r.label for *_, r in own)})
                    score = max((r.weight for *_, r in (*base, *own)), default=0.0)
                    rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base_labels), ",".join(labels), score))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(relieved(run), SCHEMA)
