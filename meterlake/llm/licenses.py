"""Licence scan by canonical digest lookup.

A text's case, punctuation, line breaks, copyright statements and equivalent spellings are normalised; the
digest of what is left, of the entire text and of each of its lines, is joined with the digests of
known licences. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known licence texts and notices, by SPDX identifier.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("ISC", "ISC License\n" + _ISC_TERMS + "\n" + _ISC_TAIL),
    ("ISC", _ISC_TERMS + "\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Full texts, a file for each SPDX identifier.
TEXTS = Path(__file__).parent / "license_texts"
_END_OF_TERMS = "END OF TERMS AND CONDITIONS"
#: Spellings that count as the same word, as licence matching guidelines have them.
SPELLINGS: list[tuple[str, str]] = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"),
    ("program", "programme"), ("recognised", "recognized"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
]
#: A line that begins as a copyright statement, as the SQL has it.
COPYRIGHT = r"^(?:copyright|all rights reserved|c )(?: |$)"
#: Texts that may hold a copyright statement.
_MARKED = r"(?i)copyright|\(c\)|©|all\s+rights\s+reserved|^\W*c\s+\d{4}"
#: Signs before a statement. Taken for good, as no statement begins with one: an engine that gives groups back remembers
#: each, sign by sign, on its stack.
_LEAD = r"(?:[^\p{L}\p{N}©(\n\r\x85\u2028\u2029]|\((?!c\)))*+"
_YEAR = r"(?:\d{4}|[<\[{(]\s*+(?:year|yyyy)[^\n<\[{(>\]})]*+[>\]})])"
#: How what may stand behind a statement on its line begins.
_BEHIND = (r"(?:permission (?:is hereby|to use)|redistribution and use|licen[cs]ed (?:under|to)|(?:is )?(?:released|distributed|made available|available) under|"
           r"this (?:software|program|library|work|file|source|project|code|document|is)\b|the software is|everyone is permitted|all rights reserved|"
           r"(?:the )?mit licen[cs]e|apache licen[cs]e|gnu (?:lesser |affero |library )?general public|spdx-licen[cs]e)")
#: Words behind a bare 'copyright' that make it part of a sentence.
_PROSE = r"(?:holders?|owners?|notices?|laws?|licen[cs]es?|statements?|disclaimers?|interests?|permissions?|protection|infringements?|treat(?:y|ies)|acts?|and|or|in|is|to|of|for|on|as|at|are|was|may|has|can|does)\b"
#: '(c)' is a sign, not the third item of a list, before a year or a few words that are all there is.
_SIGNED = rf"(?=[\s,:]*{_YEAR}|(?:[^\S\n]+\S+){{1,4}}?[^\S\n]*(?:$|\s{_BEHIND}))"
_HOLDER = rf"[^\n]*?(?:$|(?<!\b(?:inc|ltd|corp|co|jr|sr|dr|st|al|bros|llc|gmbh|\p{{L}}))[.;!?][\"')\]]*(?=\s+\p{{L}}|\s*$)|(?=[\s,;.(]{_BEHIND}))"
#: Statements of the holder at a line's beginning, up to the sentence end, and 'all rights reserved'.
STATEMENTS = (
    rf"(?im)^(?:{_LEAD}(?:(?:(?:©|\(c\))[^\S\n]*copyright\b|copyright\b[\s:]*(?:©|\(c\))|©|\(c\){_SIGNED}|c(?=\s+\d{{4}})|copyright\b(?=[\s:,]*{_YEAR})|copyright\b(?=\s*$)|"
    rf"copyright\b(?=\s+by\s|\s+the\s+\p{{L}}+\s*(?:$|authors|contributors|project|team|developers))|copyright\b(?=[^\S\n]+(?-i:\p{{Lu}}))(?!\s+{_PROSE})){_HOLDER}|"
    rf"{_LEAD}all rights reserved\b[^\p{{L}}\p{{N}}\n]*))++"
)
_DATED = rf"\bcopyright\b[\s:]*(?:©|\(c\))?\s*{_YEAR}"
#: A dated statement inside a line, if a licence goes on behind it; else the first group has the rest of the line, so that
#: each line is gone through once, however many statements are in it.
INSIDE = rf"(?im){_DATED}[^\n]*?(?:(?=\s{_BEHIND})|\s+all rights reserved\b[.\s]*)(?:all rights reserved\b[.\s]*)?|({_DATED}[^\n]*)"


def _bare(line: Column) -> Column:
    """Lower case, words only, single spaces, and one at each end."""
    low = F.regexp_replace(F.lower(line), "©|\\(c\\)", " copyright ")
    return F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _one_spelling(words: Column) -> Column:
    # With doubled spaces neighbours share none, so the same word twice is replaced twice.
    odd, same = F.lit(False), F.replace(words, F.lit(" "), F.lit("  "))
    for word, plain in SPELLINGS:
        odd = odd | F.contains(words, F.lit(f" {word} "))
        same = F.replace(same, F.lit(f" {word} ".replace(" ", "  ")[1:-1]), F.lit(f" {plain} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.when(odd, F.regexp_replace(same, " +", " ")).otherwise(words))


def _digest(words: Column) -> Column:
    return F.when(words != "", F.sha2(words.cast("binary"), 256))


def _stated(text: Column) -> Column:
    """The text without its copyright statements."""
    return F.when(F.regexp_like(text, F.lit(_MARKED)), F.regexp_replace(F.regexp_replace(text, STATEMENTS, " "), INSIDE, "$1 ")).otherwise(text)


def _canonical(parts: Column) -> Column:
    """Canonical forms of the texts of an array. Each step is a transform of its own, so no step is
    computed again for every use of its result."""
    return F.transform(F.transform(parts, lambda x: F.regexp_replace(_bare(x), " +", " ")), _one_spelling)


def _whole(text: Column) -> Column:
    """The canonical form of an entire text, wherever its lines break."""
    return F.get(_canonical(F.transform(F.array(text), _stated)), 0)


def _lines(text: Column) -> Column:
    """Canonical lines that have words, in order, without their copyright statements."""
    return F.filter(_canonical(F.split(_stated(text), "\n")), lambda x: x != "")


def full_texts() -> list[tuple[str, str]]:
    """The shipped texts, and those with an appendix on how to apply them without it too."""
    found = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, rest = text.partition(_END_OF_TERMS)
        found += [(path.stem, text)] + ([(path.stem, terms + end), (path.stem, terms)] if rest.strip() else [])
    return found


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license`` of the known texts: as many rows as they are, whatever the corpus."""
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN + full_texts()])
    rows = spark.range(1).select(F.inline(listed))
    return rows.select(_digest(_whole(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, canonical_sha256`` (null if no words are left),
    ``license`` that the entire text is (or null), ``notices`` (sorted licences that some entire line
    is) and ``n_notices`` (lines that are one). A null text is empty; repeated rows give repeated
    rows; other columns are ignored."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    known = F.broadcast(known_digests(docs.sparkSession))  # as many rows as there are known texts
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    whole = rows.select("doc_id", "key", "row", _whole(F.col("text")).alias("whole")).select("doc_id", "key", "row", _digest(F.col("whole")).alias("digest")).join(known, "digest", "left")
    lines = rows.select("key", "row", F.posexplode(_lines(F.col("text"))).alias("at", "line")).select("key", "row", "at", _digest(F.col("line")).alias("digest")).join(known, "digest")
    # Repeated rows are known by the same key: each line of theirs counts once.
    once = lines.groupBy("key", "row", "at").agg(F.first("license").alias("license"))
    found = once.groupBy("key", "row").agg(F.sort_array(F.collect_set("license")).alias("notices"), F.count("*").alias("n_notices"))
    return whole.join(found, ["key", "row"], "left").select(
        "doc_id", F.col("digest").alias("canonical_sha256"), "license",
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
