r"""License scan: ordered signature rules over the words of a text.

Each rule is a regular expression over the lower-cased words, joined by spaces, with
a priority and the keywords without which it can't match.  Rules whose keywords are
missing aren't tried.  Rules for license texts, headers and rights notices are written
by hand (``license_rules``); those for the ways a license is named are five forms around
each license's names.  Detections are resolved in order of priority: one that lies
inside another of higher rank is suppressed.  As whatever lies inside a suppressed
detection also lies inside the one that suppressed it, one sweep over the detections by
start settles this.

Base phrases (fixed) are counted at every place, also where they overlap, and their
labels always stay.

Defined results.  A null text counts as empty: no words, no labels, score 0.  Rows are
judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import license_rules

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label -> names as words; a name is matched before "license".
NAMES = {
    "mit": "mit|expat|mit x11",
    "apache": "apache|apache software",
    "gpl": "gnu general public|general public|gnu gpl|gpl",
    "lgpl": "gnu lesser general public|lesser general public|gnu library general public|gnu lgpl|lgpl",
    "agpl": "gnu affero general public|affero general public|gnu agpl|agpl",
    "fdl": "gnu free documentation|free documentation",
    "bsd": "bsd|berkeley software distribution|new bsd|simplified bsd|bsd [234] clause|modified bsd",
    "mpl": "mozilla public|mpl",
    "epl": "eclipse public|epl",
    "cddl": "common development and distribution|cddl",
    "cpl": "common public",
    "ipl": "ibm public",
    "isc": "isc|internet systems consortium",
    "zlib": "zlib|zlib libpng|libpng",
    "boost": "boost software|boost",
    "artistic": "artistic|perl artistic",
    "psf": "python software foundation|psf|python",
    "ruby": "ruby",
    "php": "php",
    "openssl": "openssl",
    "wtfpl": "do what the fuck you want to public|wtfpl",
    "unlicense": "the unlicense|unlicense",
    "cc0": "creative commons zero|cc0",
    "cc-by": "creative commons attribution|cc by",
    "cc-by-sa": "creative commons attribution sharealike|creative commons attribution share alike|cc by sa",
    "cc-by-nc": "creative commons attribution noncommercial|creative commons attribution non commercial|cc by nc",
    "cc-by-nd": "creative commons attribution noderivatives|creative commons attribution no derivatives|cc by nd",
    "cc-by-nc-sa": "creative commons attribution noncommercial sharealike|cc by nc sa",
    "odbl": "open database|odbl",
    "odc-by": "open data commons attribution",
    "pddl": "open data commons public domain dedication and",
    "ofl": "sil open font|open font",
    "eupl": "european union public|eupl",
    "ms-pl": "microsoft public|ms pl",
    "ms-rl": "microsoft reciprocal|ms rl",
    "apsl": "apple public source",
    "ncsa": "university of illinois ncsa open source|ncsa",
    "afl": "academic free",
    "osl": "open software",
    "postgresql": "postgresql",
    "w3c": "w3c software notice and|w3c",
    "x11": "x11|x consortium",
    "sleepycat": "sleepycat",
    "vim": "vim",
    "zpl": "zope public",
    "qpl": "q public",
    "lppl": "latex project public|lppl",
    "cecill": "cecill",
    "upl": "universal permissive",
    "bsl": "business source",
    "sspl": "server side public|sspl",
    "elastic": "elastic",
    "openrail": "openrail|open rail|creativeml open rail m",
    "llama": "llama 2 community|llama 3 community|llama community",
}

#: Priority, name, pattern around a license's name, keyword that must occur, score.
FORMS = (
    (5, "identifier", r"spdx licen[cs]e identifier {slug}(?: only| or later)?(?: \d+)*", "spdx", 1.0),
    (4, "grant", r"(?:licensed|licenced|released|distributed|available|published|redistribute it) (?:and or modify it )?under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?: as published by the free software foundation)?(?:(?: either)? version| v)?(?: v?\d+){{0,2}}", "under", 0.95),
    (3, "versioned", r"(?:{name}) licen[cs]e (?:version |v )?v?\d+(?: \d+)?", "licen", 0.9),
    (2, "named", r"(?:{name}) licen[cs]e", "licen", 0.7),
    (1, "page", r"(?:opensource org|gnu org|apache org|creativecommons org) licenses (?:{slug})(?: \d+)*", "licenses", 0.8),
)


#: Priority and score of the hand-written blocks.
BLOCKS = ((license_rules.TEXTS, 6, 0.9), (license_rules.HEADERS, 5, 0.85), (license_rules.NOTICES, 0, 0.5))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: re.Pattern[str]
    #: The words without which it can't match: this one, and one of these.
    keyword: str
    one_of: tuple[str, ...]
    score: float


def _pattern(form: str) -> re.Pattern[str]:
    return re.compile(f"(?<= )(?:{form})(?= )")


class Rules(list):
    """Rules and a search for all their keywords at once."""

    def __init__(self, table: Iterable[Rule]) -> None:
        super().__init__(table)
        self.finder = ahocorasick.Automaton()
        for k in {k for rule in self for k in (rule.keyword, *rule.one_of)}:
            self.finder.add_word(k, k)
        self.finder.make_automaton()

    def keywords(self, line: str) -> set[str]:
        return {k for _, k in self.finder.iter(line)}


def rules() -> Rules:
    """All rules, the most telling first."""
    out = [Rule(label, priority, _pattern(form), keyword, (keyword,), score) for block, priority, score in BLOCKS for label, keyword, form in license_rules.lines(block)]
    for label, names in NAMES.items():
        longest = "|".join(sorted(names.split("|"), key=len, reverse=True))
        slug = re.escape(label.replace("-", " ")).replace(r"\ ", " ")
        for priority, _, form, keyword, score in FORMS:
            needs = names if "{name}" in form else label.replace("-", " ")
            one_of = tuple({max(name.split(" "), key=len) for name in needs.split("|")})
            out.append(Rule(label, priority, _pattern(form.format(name=longest, slug=slug)), keyword, one_of, score))
    return Rules(sorted(out, key=lambda r: -r.priority))


@dataclass(frozen=True)
class Hit:
    label: str
    start: int
    end: int
    priority: int
    score: float


def detect(line: str, table: Rules) -> list[Hit]:
    """Detections in `` word word ... `` after suppression; offsets are characters of ``line``."""
    found = []
    words = table.keywords(line)
    for rule in table if words else ():
        if rule.keyword in words and not words.isdisjoint(rule.one_of):
            found += [Hit(rule.label, m.start(), m.end(), rule.priority, rule.score) for m in rule.pattern.finditer(line)]
    found.sort(key=lambda h: (h.start, -h.end, -h.priority, h.label))
    kept: list[Hit] = []
    reach: dict[int, int] = {}  # the farthest end so far, by priority
    for h in found:
        if not any(end >= h.end for priority, end in reach.items() if priority >= h.priority):
            kept.append(h)
        reach[h.priority] = max(reach.get(h.priority, 0), h.end)
    return kept


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
def scan(text: str, table: Rules) -> tuple[list[int], set[str], list[Hit]]:
    """Word numbers of base places, their labels, and the method's detections."""
    line = " " + " ".join(_WORD.findall(text.translate(_FOLD))) + " "
    places, labels = [], set()
    for phrase, label in BASE:
        at = line.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = line.find(f" {phrase} ", at + 1)
    numbers, number, before = [], 0, 0
    for at in sorted(places):
        number += line.count(" ", before, at)
        before = at
        numbers.append(number)
    return numbers, labels, detect(line, table)


def _report() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules()
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(1)):
                first = B.spans(B.LOWER[data], offsets, B.ALNUM)[2]
                out = []
                for k in range(len(offsets) - 1):
                    places, base, hits = scan(data[offsets[k] : offsets[k + 1]].tobytes().decode(), table)
                    labels = base | {h.label for h in hits}
                    score = max([0.7 * bool(base), *(h.score for h in hits)])
                    out.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score)))
                columns = list(zip(*out, strict=True))
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(np.diff(first).astype(np.int64)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels for every row; no shuffle."""
    return docs.select(id_col, text_col).mapInArrow(_report(), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
