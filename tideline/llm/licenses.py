"""Licence statements in texts, recognised by sentence rules.

A text is cut into sentences at punctuation and blank lines, which are brought into one form: lower
case, and only words and numbers. A sentence may run over lines, wrapped and behind comment marks,
and a line may be a notice by itself: known sentences begin and end with lines. Known sentences become
identifiers with their parameter, such as a version. Ordered rules then match runs of identifiers and say which licence they stand for; a rule takes the identifiers
it matches, so that later, more general rules see only what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField

from tideline.llm.batches import others, with_results

# How licences are named. A name by itself, as a title, is a full one; a short one needs
# what says that it is a licence. Groups are parameters of the identifier.
_VERSION = r"(?: ?(?:version |ver |v ?)?([0-9][0-9.]*))?"
_LATER = r"(\+| or any later version| or later| only)?"
_FSF = r"(?: as published by the free software foundation)?"
_CC = r"((?:by|attribution)(?: (?:nc|sa|nd|non ?commercial|share ?alike|no ?deriv(?:ative)?s))*)"
NAMES: tuple[tuple[str, str, str], ...] = (
    ("AGPL", rf"(?:gnu )?affero general public license{_FSF}{_VERSION}{_LATER}", rf"(?:gnu )?agpl{_VERSION}{_LATER}"),
    ("LGPL", rf"(?:gnu )?(?:lesser|library) general public license{_FSF}{_VERSION}{_LATER}", rf"(?:gnu )?lgpl{_VERSION}{_LATER}"),
    ("GPL", rf"(?:gnu )?general public license{_FSF}{_VERSION}{_LATER}", rf"(?:gnu )?gpl{_VERSION}{_LATER}"),
    ("Apache", rf"apache (?:software )?license{_VERSION}", rf"apache{_VERSION}"),
    ("MIT", r"(?:mit(?: x11)?|x11|expat) license", r"mit(?: x11)?|x11|expat"),
    ("BSD", r"(?:([234]) clause )?(?:(?:new|revised|modified|simplified) )?bsd (?:([234]) clause )?license",
     r"(?:([234]) clause )?(?:(?:new|revised|modified|simplified) )?bsd(?: ([234]) clause)?"),
    ("MPL", rf"mozilla public license{_VERSION}", rf"mpl{_VERSION}"),
    ("EPL", rf"eclipse public license{_VERSION}", rf"epl{_VERSION}"),
    ("BSL", rf"boost software license{_VERSION}", rf"bsl{_VERSION}|boost"),
    ("ISC", r"isc license", r"isc"),
    ("Zlib", r"zlib(?: libpng)? license", r"zlib(?: libpng)?"),
    ("Artistic", rf"artistic license{_VERSION}", rf"artistic{_VERSION}"),
    ("Unlicense", r"unlicense", r"unlicense"),
    ("WTFPL", r"do what the fuck you want to public license", rf"wtfpl{_VERSION}"),
    ("CC", rf"(?:creative commons|cc) {_CC}{_VERSION}(?: (?:international|unported|generic))?(?: public)? license|creative commons {_CC}{_VERSION}"
           rf"(?: (?:international|unported|generic))?|(?:creative commons )?cc ?(0){_VERSION}(?: universal)?(?: public domain dedication)?",
     rf"(?:cc|creative commons) {_CC}{_VERSION}(?: (?:international|unported|generic))?|creative commons (0|zero){_VERSION}|cc (zero){_VERSION}"),
)
# What goes before a name: a statement, or a label; and what may go after it.
_VERB = (r"(?:(?:licensed|released|distributed|available|provided|covered|published|offered|shared) (?:under|by)|governed by|subject to) "
         r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?(?:version ([0-9][0-9.]*) of the )?")
_LABEL = r"license(?: type| name)? (?:the )?"
_TAIL = r"(?: (?:the )?license)?(?: (?:see|which|found|that|as found|as described) .*)?"
_TITLE_TAIL = r"(?: (?:mit|isc|epl|mpl|bsl|zlib|expat|gpl|lgpl|agpl))?(?: [0-9]{1,2} [a-z]+ [0-9]{4}| [a-z]+(?: [0-9a-z]+)? [0-9]{4})?"
_BARE = re.compile(r"\((?!\?)")


def _any(full: str, short: str) -> str:
    return f"(?:{full}|{short})"


# What licence texts say. A sentence's pattern is matched against all of its form,
# or against some of its lines, where a space may be a line break.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("Not", r"(?:.* )?(?:not|never|no longer|neither|nor) (?:[a-z]+ )?(?:be )?" + _BARE.sub(
        "(?:", _VERB + _any(*("|".join(n[k] for n in NAMES) for k in (1, 2)))) + _TAIL),
    *((name, "(?:.* )?" + _VERB + _any(full, short) + _TAIL) for name, full, short in NAMES),
    *((name, f"(?:{_LABEL}{_any(full, short)}{_TAIL}|(?:the )?{_any(full, f'(?:{short}) license')}{_TITLE_TAIL})")
      for name, full, short in NAMES),
    ("GPL", r"(?:.* )?redistribute it and or modify it under the terms of the (?:gnu )?general public license(?: (?:version|v) ?([0-9.]+))?(?: as published by the free software foundation)?(?: (?:either )?version ([0-9.]+)(?: of the license)?)?(?:( or)(?: at your option)?( any later version)| only)?"),
    ("LGPL", r"(?:.* )?redistribute it and or modify it under the terms of the (?:gnu )?(?:lesser|library) general public license(?: (?:version|v) ?([0-9.]+))?(?: as published by the free software foundation)?(?: (?:either )?version ([0-9.]+)(?: of the license)?)?(?:( or)(?: at your option)?( any later version)| only)?"),
    ("AGPL", r"(?:.* )?redistribute it and or modify it under the terms of the (?:gnu )?affero general public license(?: (?:version|v) ?([0-9.]+))?(?: as published by the free software foundation)?(?: (?:either )?version ([0-9.]+)(?: of the license)?)?(?:( or)(?: at your option)?( any later version)| only)?"),
    ("ISCGrant", r"permission to use copy modify and (?:or )?distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroGrant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("Grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MITCondition", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIs", r"(?:the|this) software is provided (?:by .* )?as is .*"),
    ("BSDGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSDSource", r"(?:1 )?redistributions of source code must retain the above copyright notice .*"),
    ("BSDBinary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BSDName", r"(?:[34] )?neither the name .* may be used to endorse or promote products .*"),
    ("SPDX", r"spdx license identifier ([a-z0-9. +]+)"),
    ("Copyright", r"(?:.* )?(?:copyright|c) (?:c )?((?:19|20)[0-9]{2})(?: .*)?"),
    ("AllRights", r"(?:.* )?all rights reserved"),
    ("PublicDomain", r"(?:.* )?(?:released|placed|dedicated) (?:in|into|to) the public domain(?: .*)?"),
)
# A rule: the licence, and the identifiers it takes, one after the other. ``{0}`` is a parameter of
# the first sentence. A name that ends in ? may be missing.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDName", "AsIs?")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "AsIs?")),
    ("MIT", ("Grant", "MITCondition", "AsIs?")),
    ("MIT", ("MIT",)),
    ("ISC", ("ISCGrant", "AsIs?")),
    ("0BSD", ("ZeroGrant", "AsIs?")),
    ("Zlib", ("AsIs?", "ZlibGrant")),
    ("BSL-1.0", ("BoostGrant", "AsIs?")),
    ("AGPL{0}", ("AGPL",)),
    ("LGPL{0}", ("LGPL",)),
    ("GPL{0}", ("GPL",)),
    ("Apache{0}", ("Apache",)),
    ("BSD{0}", ("BSD",)),
    ("MPL{0}", ("MPL",)),
    ("EPL{0}", ("EPL",)),
    ("BSL{0}", ("BSL",)),
    ("ISC", ("ISC",)),
    ("Zlib", ("Zlib",)),
    ("Artistic{0}", ("Artistic",)),
    ("Unlicense", ("Unlicense",)),
    ("WTFPL{0}", ("WTFPL",)),
    ("CC{0}", ("CC",)),
    ("SPDX{0}", ("SPDX",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Proprietary", ("AllRights",)),
)
# What most sentences lack: only those with one of these are compared with the patterns. Every
# pattern implies one of them.
CUES = re.compile(
    r"licen[sc]e|copyright|©|permission|redistribut|software|endorse|rights|domain|gpl|commons"
    r"|(?:released|distributed|available|provided|covered|published|offered|shared)[^a-z0-9]+(?:under|by)(?![a-z0-9])"
    r"|governed[^a-z0-9]+by|subject[^a-z0-9]+to|(?<![a-z0-9])cc(?:0|(?![a-z0-9]))"
    r"|(?<![a-z0-9])c[^a-z0-9]+(?:19|20)[0-9]{2}", re.I | re.A)
# Ends of lines, marks of comments around them, blank lines, and ends of sentences, which "v." is not;
# the notices of the GPL have a semicolon before their version.
_LINE = re.compile(r"\r\n|\r|\n")
_BEFORE, _AFTER = "/*#-;%<!>| \t", "/*#->| \t"
_BLANK = re.compile(r"\n{2,}")
_END = re.compile(r"(?<=[.!?])(?<![^a-z0-9]v\.)\s+|(?<=;)(?!\s*either\s+version)\s+", re.I)
_OTHER = re.compile(r"[^a-z0-9.+]+")
_DOTS = re.compile(r"(?<![0-9])\.|\.(?![0-9])")


def normalise(sentence: str) -> str:
    """Lower case; dots only within numbers; all else but letters, digits and plus is one space."""
    plain = _OTHER.sub(" ", sentence.lower().replace("©", "copyright").replace("licence", "license"))
    return " ".join(_DOTS.sub(" ", plain).split())


# Long forms of parameters.
_SHORT = (
    (re.compile("attribution"), "by"), (re.compile("non ?commercial"), "nc"), (re.compile("share ?alike"), "sa"),
    (re.compile("no ?deriv(?:ative)?s"), "nd"), (re.compile("zero"), "0"), (re.compile(r"\+"), "or later"),
)
_EITHER = re.compile("-(?:or|and)-(?!later)")


def _detail(m: re.Match) -> tuple[str, ...]:
    out = []
    for g in filter(None, m.groups()):
        for long, short in () if g[0].isdigit() else _SHORT:
            g = long.sub(short, g)
        out.append("-".join(g.split()))
    return tuple(out)


@dataclass(frozen=True)
class Sentence:
    name: str
    detail: tuple[str, ...] = ()

    def __str__(self) -> str:
        return self.name + "".join(f"-{d}" for d in self.detail)


_PATTERNS = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: A line that begins a sentence with an open middle ends the middle of the one before.
_AGAIN = "(?:the|this) software is provided|(?:[34] )?neither the name"


def _over_lines(pattern: str) -> re.Pattern:
    """``pattern`` for whole lines of a sentence: what is open before or after stays on its line."""
    head, tail = "(?:.* )?", "(?: .*)?"
    first = head if pattern.startswith(head) else ""
    last = tail if pattern.endswith(tail) else ""
    core = pattern[len(first):len(pattern) - len(last)]
    end = ".*" if core.endswith(".*") else ""
    core = core[:len(core) - len(end)].replace(".*", f"(?:.|\n(?!{_AGAIN}))*?")
    core = re.sub(r"\[[^\]]*\]| ", lambda m: "[ \n]" if m[0] == " " else m[0], core)
    return re.compile(f"^{first}{core}{end}{last}$", re.M)


_WRAPPED = [(name, _over_lines(pattern)) for name, pattern in SENTENCES]


def identify(sentence: str) -> Sentence | None:
    """The identifier of a sentence in its normal form, of the first pattern that fits."""
    for name, pattern in _PATTERNS:
        if m := pattern.fullmatch(sentence):
            return Sentence(name, _detail(m))
    return None


def _of_lines(lines: str) -> list[Sentence]:
    """Identifiers of a sentence in its normal form by lines; earlier patterns take their lines first."""
    if "\n" not in lines:
        return [s] if (s := identify(lines)) else []
    took: list[tuple[int, Sentence]] = []
    taken = bytearray(len(lines))
    for name, pattern in _WRAPPED:
        for m in pattern.finditer(lines):
            if taken.find(1, m.start(), m.end()) < 0:
                took.append((m.start(), Sentence(name, _detail(m))))
                taken[m.start():m.end()] = b"\1" * (m.end() - m.start())
    return [s for _, s in sorted(took, key=lambda t: t[0])]


def sentences(text: str | None) -> list[Sentence]:
    """Identifiers of the known sentences of a text, in order."""
    if not text or not CUES.search(text):
        return []
    found = []
    for paragraph in _BLANK.split("\n".join(line.strip().lstrip(_BEFORE).rstrip(_AFTER) for line in _LINE.split(text))):
        if CUES.search(paragraph):
            for s in _END.split(paragraph):
                if CUES.search(s):
                    found += _of_lines("\n".join(filter(None, map(normalise, s.split("\n")))))
    return found


def match(found: list[Sentence]) -> list[str]:
    """Licences of a run of identifiers, sorted, each once; ``unknown`` for a rest that has a sign."""
    left: list[Sentence | None] = list(found)
    out: set[str] = set()
    for licence, wanted in RULES:
        at = 0
        while at < len(left):
            took, k = [], at
            for name in wanted:
                if k < len(left) and left[k] is not None and left[k].name == name.rstrip("?"):
                    took.append(k)
                    k += 1
                elif not name.endswith("?"):
                    took = []
                    break
            if took:
                detail = left[took[0]].detail
                for d in [(e,) for e in _EITHER.split(detail[0])] if licence == "SPDX{0}" else [detail]:
                    out.add(licence.format("".join(f"-{e}" for e in d)))
                for j in took:
                    left[j] = None
                at = k
            else:
                at += 1
    if any(s is not None and s.name not in ("Copyright", "Not") for s in left):
        out.add("unknown")
    return sorted(out)


def _arrays(rows: Iterable[list[str]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.string()))


RESULT = [StructField("sentences", ArrayType(StringType())), StructField("licenses", ArrayType(StringType()))]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the licence statements of every whole text.

    Adds ``sentences``, the identifiers of known sentences in order, and ``licenses``, what the
    rules make of them, sorted and each once. ``unknown`` stands for identifiers that no rule
    takes; a copyright line alone, or that a licence does not hold, for nothing. Null and empty texts have neither. Rows are scanned
    one by one, so repeated rows stay; older columns of these names are replaced.
    """
    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            found = [sentences(t) for t in column.to_pylist()]
            return [_arrays([[str(s) for s in f] for f in found]), _arrays([match(f) for f in found])]
        return work

    return with_results(docs, [text], others(docs, [f.name for f in RESULT]), RESULT, make)
