"""Licence scan by sentence rules.

A text is cut at ``!``, ``?``, ``.`` before white space and at lines without a word, and the rest into
pieces at line ends and ``;``. A sentence is some consecutive pieces, as notices are wrapped anywhere:
the first ones that are a known sentence, and those that follow it until one that begins another one
(``WINDOW`` pieces at most). A sentence is normalised (lower case, words of letters, digits and dots, no comment marks, no
copyright holder's name or year) and looked up among known licence sentences, each a pattern with an
identifier. The identifiers of a text, in order, are matched against rules: a rule names a licence
and the ordered identifiers that make it up, with whatever else between them. Rules are tried in
their order, and one that matches uses its identifiers up, so that a short rule does not report a
part of a longer licence. A text with licence sentences but no whole rule has the licence ``UNMATCHED``.

Results: a null text has no sentence; rows with equal ids each get a row. Whole texts are read; a text
without any of ``_KEYS`` has no licence sentence (each has one), and is not cut into sentences.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, null_text, pieces

#: Known licence sentences, normalised, as patterns with their identifiers. ``{0}`` is a version.
SENTENCES = (
    ("SPDX", r"spdx license identifier (.+)"),
    ("COPYRIGHT", r"copyright( c)?\b.*"),
    ("ALLRIGHTS", r"all rights reserved"),
    ("APACHE_UNDER", r".*licensed under the apache license,? version ([0-9.]+?)( the license)?"),
    ("APACHE_COMPLY", r"you may not use this file except in compliance with the license"),
    ("APACHE_COPY", r"you may obtain a copy of the license at.*"),
    ("APACHE_ASIS", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*"),
    ("MIT_UNDER", r".*(released|licensed|distributed|available) under (the terms of )?the mit license.*"),
    ("MIT_GRANT", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software.*"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("MIT_ASIS", r"the software is provided as is,? without warranty of any kind.*"),
    ("BSD_UNDER", r".*(released|licensed|distributed|available) under (the terms of )?the (2|3|two|three)? ?(clause )?bsd license.*"),
    ("BSD_GRANT", r"redistribution and use in source and binary forms.*are permitted.*"),
    ("BSD_SOURCE", r"(1 ?)?redistributions of source code must retain the above copyright notice.*"),
    ("BSD_BINARY", r"(2 ?)?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSD_NAME", r"(3 ?)?neither the name of .* may be used to endorse or promote products.*"),
    ("BSD_ASIS", r"this software is provided by the .* as is and any express or implied warranties.*"),
    ("LGPL_UNDER", r".*licensed under the gnu (lesser|library) general public license.*?( version ([0-9.]+))?( or later)?"),
    ("AGPL_UNDER", r".*licensed under the gnu affero general public license.*?( version ([0-9.]+))?( or later)?"),
    ("GPL_UNDER", r".*licensed under the gnu general public license,? version ([0-9.]+)( or later)?"),
    ("GPL_FREE", r".*is free software you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("GPL_NOWARRANTY", r".*is distributed in the hope that it will be useful,? but without any warranty.*"),
    ("GPL_RECEIVED", r"you should have received a copy of the gnu general public license.*"),
    ("MPL_UNDER", r".*subject to the terms of the mozilla public license,? v(ersion)? ?([0-9.]+).*"),
    ("CC_BY_NC_ND", r".*licensed under (the )?(cc by nc nd|creative commons attribution noncommercial noderivatives).*?([0-9.]+)?.*"),
    ("CC_BY_NC_SA", r".*licensed under (the )?(cc by nc sa|creative commons attribution noncommercial sharealike).*?([0-9.]+)?.*"),
    ("CC_BY_NC", r".*licensed under (the )?(cc by nc|creative commons attribution noncommercial) ?([0-9.]+)?.*"),
    ("CC_BY_SA", r".*licensed under (the )?(cc by sa|creative commons attribution sharealike) ?([0-9.]+)?.*"),
    ("CC_BY_ND", r".*licensed under (the )?(cc by nd|creative commons attribution noderivatives) ?([0-9.]+)?.*"),
    ("CC_BY", r".*licensed under (the )?(cc by|creative commons attribution) ?([0-9.]+)?.*"),
    ("CC0", r".*(cc0|dedicated to the public domain|released into the public domain).*"),
    ("OTHER_LICENSE", r".*\blicen[sc]ed? (under|agreement|terms)\b.*"),
)

#: Licences and the ordered sentence identifiers that make them up, longer ones first.
RULES = (
    ("Apache-{0}", ("APACHE_UNDER", "APACHE_COMPLY", "APACHE_COPY", "APACHE_ASIS")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_ASIS")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME", "BSD_ASIS")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ASIS")),
    ("GPL", ("GPL_FREE", "GPL_NOWARRANTY", "GPL_RECEIVED")),
    ("GPL", ("GPL_FREE", "GPL_NOWARRANTY")),
    ("Apache-{0}", ("APACHE_UNDER",)),
    ("MIT", ("MIT_UNDER",)),
    ("BSD", ("BSD_UNDER",)),
    ("LGPL-{0}", ("LGPL_UNDER",)),
    ("AGPL-{0}", ("AGPL_UNDER",)),
    ("GPL-{0}", ("GPL_UNDER",)),
    ("MPL-{0}", ("MPL_UNDER",)),
    ("CC-BY-NC-ND-{0}", ("CC_BY_NC_ND",)),
    ("CC-BY-NC-SA-{0}", ("CC_BY_NC_SA",)),
    ("CC-BY-NC-{0}", ("CC_BY_NC",)),
    ("CC-BY-SA-{0}", ("CC_BY_SA",)),
    ("CC-BY-ND-{0}", ("CC_BY_ND",)),
    ("CC-BY-{0}", ("CC_BY",)),
    ("CC0-1.0", ("CC0",)),
    ("{0}", ("SPDX",)),
)
#: Sentences that alone say nothing about a licence.
WEAK = ("COPYRIGHT", "ALLRIGHTS")

#: Sentences that are one line; others are wrapped over pieces, so many at most.
ONE_LINE, WINDOW = ("SPDX", "COPYRIGHT"), 10

_KNOWN = tuple((name, re.compile(pattern)) for name, pattern in SENTENCES)
_END = re.compile(r"[!?]+|\.(?=\s|$)|\n(?:[^\w\n]*\n)+")
_PIECE = re.compile(r"[^\n;]+")
_MARK = re.compile(r"[^a-z0-9., ]+")
_KEYS = re.compile(r"licen|copyright|permission|warrant|redistribut|public\W+domain|spdx|as\W+is|rights\W+reserved|free\W+software|in\W+compliance|reproduce|endorse|mozilla|cc0")


def normalise(sentence: str) -> str:
    return " ".join(_MARK.sub(" ", sentence.lower()).split()).replace(" ,", ",").strip(" .,")


def normalise_piece(piece: str) -> str:
    """A part of a sentence: a comma at its end belongs to it."""
    return " ".join(_MARK.sub(" ", piece.lower()).split()).replace(" ,", ",").strip(" .")


def version(match: re.Match) -> str:
    """The last group of the match that is a version, or its first group for SPDX."""
    found = [g.strip(" .") for g in match.groups() if g and re.fullmatch(r"[0-9]+(\.[0-9]+)*", g.strip(" ."))]
    return found[-1] if found else ""


def known(said: str, pieces_: int) -> tuple[int, re.Match] | None:
    """The first known sentence that some pieces make up, by its place and its match."""
    for k, (name, pattern) in enumerate(_KNOWN):
        if (pieces_ == 1 or name not in ONE_LINE) and (m := pattern.fullmatch(said)):
            return k, m
    return None


def _of_part(said: list[str]) -> list[tuple[int, int, int, re.Match]]:
    """(first piece, last piece, place of the known sentence, match) of the sentences of normalised pieces."""
    def joined(i, j):
        return known(normalise(" ".join(said[i : j + 1])), j - i + 1)

    @functools.cache
    def first(i):
        """The sentence that begins at piece i or the soonest after it, by its end; a general one gives way to a longer special one."""
        general = None
        if not _KEYS.search(" ".join(said[i : i + WINDOW])):
            return None
        for j in range(i, min(i + WINDOW, len(said))):
            if found := joined(i, j):
                at = i
                while at < j and (closer := joined(at + 1, j)) and closer[0] == found[0]:
                    at, found = at + 1, closer
                if found[0] < len(_KNOWN) - 1:
                    if general and at > general[1]:
                        break
                    return at, j, *found
                general = general or (at, j, *found)
        return general

    out, i = [], 0
    while i < len(said):
        if not (sentence := first(i)):
            i += 1
            continue
        at, j, k, m = sentence
        if _KNOWN[k][0] not in ONE_LINE:
            while j + 1 < min(at + WINDOW, len(said)) and not ((after := first(j + 1)) and after[0] == j + 1) and (more := joined(at, j + 1)) and more[0] == k:
                j, m = j + 1, more[1]
        out.append((at, j, k, m))
        i = j + 1
    return out


def sentences(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, identifier, version) of the licence sentences of a text, in order."""
    found, start = [], 0
    ends = [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for end, after in ends:
        if _KEYS.search(text[start:end].lower()):
            spans = [(m.start(), m.end()) for m in _PIECE.finditer(text, start, end)]
            said = [(span, x) for span in spans if (x := normalise_piece(text[span[0] : span[1]]))]
            for i, j, k, m in _of_part([x for _, x in said]):
                name = _KNOWN[k][0]
                found.append((said[i][0][0], said[j][0][1], name, m[1].upper().replace(" ", "-") if name == "SPDX" else version(m)))
        start = after
    return found


def licences(found: list[tuple[int, int, str, str]]) -> list[str]:
    """The licences that the identifiers make up, in the order of their first sentences."""
    left = dict(enumerate(found))
    out = []
    for name, wanted in RULES:
        while True:
            used, at = [], iter(sorted(left))
            for identifier in wanted:
                k = next((k for k in at if left[k][2] == identifier), None)
                if k is None:
                    break
                used.append(k)
            if len(used) < len(wanted):
                break
            out.append((used[0], name.format(left[used[0]][3]).rstrip("-")))
            for k in used:
                del left[k]
    if not out and any(x[2] not in WEAK for x in found):
        out = [(0, "UNMATCHED")]
    return list(dict.fromkeys(name for _, name in sorted(out)))


_SENTENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("id", pa.string())])


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (array), n_sentences and sentences (start, end, id) of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                names, spans = [], []
                for text in part.column("text").to_pylist():
                    found = sentences(text) if _KEYS.search(text.lower()) else []
                    names.append(licences(found))
                    spans.append([{"start": a, "end": b, "id": i} for a, b, i, _ in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, pa.list_(_SENTENCE))], names=["doc_id", "licences", "n_sentences", "sentences"])

    docs = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "doc_id long, licences array<string>, n_sentences long, sentences array<struct<start long, end long, id string>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(documents(spark, sf_dir))
    spans = F.transform("sentences", lambda x: F.concat_ws(":", x["id"], x["start"], x["end"]))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_sentences", F.array_join(spans, ",").alias("spans"))
