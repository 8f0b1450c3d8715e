"""Licence scan: digests of canonical texts, joined to the digests of known licences."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronotext.llm.common import inline

# Public licence texts and the notices by which works name their licence.
_SHORT = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)

_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. """
_NO_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BODIES = {
    "MIT": _SHORT[4][1],
    "0BSD": _SHORT[5][1],
    "ISC": _SHORT[5][1].replace("granted.", "granted, provided that the above copyright notice and this permission notice appear in all copies.", 1),
    "BSD-2-Clause": _CONDITIONS + _AS_IS,
    "BSD-3-Clause": _CONDITIONS + _NO_NAMES + _AS_IS,
}
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
}
_FILES = {
    "Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
}


def _forms(text: str) -> list[str]:
    """A text with and without its title, and each without what follows its terms."""
    whole = [text, re.split(r"\n[ \t]*\n", text.strip(), maxsplit=1)[-1]]
    terms = [re.sub(r"(END OF TERMS AND CONDITIONS).*", end, t, flags=re.DOTALL) for t in whole for end in (r"\1", "")]
    return list(dict.fromkeys(whole + terms))


def _known():
    for name, body in _BODIES.items():
        yield from ((name, text) for text in (body, *(f"{title}\n\n{body}" for title in _TITLES[name])))
    for name, file in _FILES.items():
        text = (Path(__file__).parent / "known_licenses" / f"{file}.txt").read_text(encoding="utf-8")
        yield from ((name, form) for form in _forms(text))


KNOWN = (*_SHORT[:4], *_known())

# Fixed values: (words without which the pattern finds nothing, pattern, replacement) for spellings that mean the
# same, on canonical words. The last four are the holder's name, and marks or numbers of items, in licences of BSD kind.
SPELLINGS = (
    ("licenc", r"\b(sub)?licenc(e|ed|ee|es|ing|or)\b", "{1}licens{2}"),
    ("organisation", r"\borganisation(s?)\b", "organization{1}"),
    ("non commercial", r"\bnon commercial\b", "noncommercial"),
    ("", r"\bv(er)? ?([0-9])", "version {2}"),
    ("gnu gpl", r"\bgnu gpl\b", "gnu general public license"),
    ("redistributions", r"\b[123] (redistributions (?:of|in))\b", "{1}"),
    (
        "neither the name",
        r"\b(?:3 )?neither the names? of (?:[^ ]+ ){1,12}?nor the names? of (?:its|their) contributors\b",
        "neither the name of the copyright holder nor the names of its contributors",
    ),
    ("contributors as is", r"\bprovided by (?:[^ ]+ ){1,6}?and contributors as is\b", "provided by the copyright holders and contributors as is"),
    ("contributors be liable", r"\bshall (?:[^ ]+ ){1,6}?or contributors be liable\b", "shall the copyright holder or contributors be liable"),
)
# What can open a copyright statement, in lower case. A sign is put before each, so that the pattern of
# the statement sees where the next one opens and never reads a line over and over.
MARKS = ("copyright", "(c)", "©")
SIGN = "\x01"
MARK = r"(copyright|\(c\)|©)"
# A copyright statement: mark, holder, year or a place left for it, and on to the end of the sentence or line; a year
# may be missing after "copyright (c)" or "©". Initials, and words such as "and" after "inc.", do not end it, and of
# abbreviations and further marks at most 20 precede the year. The group is what follows the sentence and stays. No
# look-around, so that SQL engines can use it.
COPYRIGHT_LINE = (
    r"\x01(?:(?:copyright|\(c\)|©)"
    r"(?:[^\n.\x01]*(?:(?:[^\p{L}\p{N}\n.][a-z](?:\.[a-z])*|inc|corp|ltd|llc|co|dr|jr)\.|\x01)){0,20}?[^\n.\x01]*?(?:[0-9]{4}|[<\[{](?:year|yyyy))"
    r"|copyright[ \t]*\x01(?:\(c\)|©)|©)"
    r"(?:(?:[^\n]*?[\p{L}\p{N})\]>\"][\p{L}\p{N})\]>\"])??\.([ \t]+(?:[^aeoh&<(\n \t]|a[^nl\n]|an[^d\n]|al[^l\n]|all[^ \n]|all [^r\n]|e[^t\n]|o[^r\n]|h[^t\n]))"
    r"|[^\n]*(?:[^\p{L}\p{N}]*all rights reserved\.?)?)"
)


def _where(text: Column, needles: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for texts that hold one of the needles; the others are not searched by pattern."""
    holds = lambda value: reduce(or_, [value.contains(F.lit(needle)) for needle in needles])
    return F.transform(F.array(text), lambda value: F.when(holds(value), change(value)).otherwise(value))[0]


def canonical(text: Column) -> Column:
    """Lower case, no copyright statements, letters and digits only, one spelling for equal words."""
    signed = lambda value: F.regexp_replace(value, MARK, SIGN + "$1")
    text = _where(F.lower(text), MARKS, lambda value: F.regexp_replace(signed(value), COPYRIGHT_LINE, "$1"))
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for needle, pattern, to in SPELLINGS:
        to = to.replace("{", "$").replace("}", "")
        text = _where(text, (needle,), lambda value, pattern=pattern, to=to: F.regexp_replace(value, pattern, to))
    return text


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license), one row per digest: the smallest name if two licences share a text."""
    rows = inline(spark, ["license", "body"], known)
    return rows.select(digest(F.col("body")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices) for every row of ``docs`` (doc_id, text).

    ``license`` is the known licence that the whole text is, else null. ``notices`` are the
    licences that single lines of it are as a whole: names in order, comma-joined, empty without one.
    ``known`` (digest, license) is a list of published licences: the caller vouches that it is
    short (thousands of rows), so it is broadcast; ``docs`` are not shuffled by a digest, and a
    licence that a third of the lines hold is no hot key. The lines of a text are matched and
    reduced in its own task.

    A null text has a null digest and no notices, an empty one the digest of no words. Repeated rows
    give one row each; rows with a null id stay. Other columns are not read.
    """
    # The digest of the whole text is made before its lines become rows, so once.
    rows = docs.select("doc_id", "text", digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "doc_id", "digest", F.explode_outer(F.split("text", "\n")).alias("body"))
    lines = lines.select("row", "doc_id", "digest", digest(F.col("body")).alias("line_digest"))
    named = F.broadcast(known.select(F.col("digest").alias("line_digest"), F.col("license").alias("notice")))
    notices = lines.join(named, "line_digest", "left").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices")
    )
    return notices.join(F.broadcast(known.select("digest", "license")), "digest", "left").select("doc_id", "digest", "license", "notices")
