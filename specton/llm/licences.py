"""Licence scanning by sentence rules.

A text is cut into sentences, each is normalised to lower-case words and looked up among known licence sentences, and
the sequence of the identifiers found is matched against ordered rules: a rule holds if its identifiers occur in that
order. Sentences end at a full stop and the like, at blank lines and at list marks, so lines may be wrapped anywhere and
begin with comment marks. Any run of whole lines within a sentence counts as one too, however many lines it has, which finds
headings and lines without a full stop. One pattern of all known sentences finds them, whose words may be apart by a space or
a line's end; of several that begin at a place the longest counts. References (a verb, ``under`` and a licence's name, or
a licence tag) are a template of their own. Everything is one projection of built-in functions, without a shuffle.

Defined results: a null or empty text has no identifiers and no licences; repeated rows are scanned each; a sentence
found twice is listed twice; what is inside a longer sentence that was found isn't listed again; ``All rights reserved``
only counts where no other licence is found; an empty table gives no rows. The caller's columns are kept; added ones of
the same name replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.llm.common import unused

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-url": "http www apache org licenses license 2 0",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl-2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache-2-title": "apache license version 2 0 january 2004",
    "apache-2-terms": "terms and conditions for use reproduction and distribution",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-copies": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl-2-1-modify": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-3-modify": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2-title": "mozilla public license version 2 0",
    "mpl-2-definitions": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "bsl-1-title": "boost software license version 1 0 august 17th 2003",
    "bsl-1-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "artistic-2-title": "the artistic license 2 0",
    "reserved": "all rights reserved",
}

#: Names by which licences are referred to, normalised, after "under", an optional "the terms of" and an optional "the".
NAMES = {
    "mit license": "MIT", "mit licence": "MIT", "mit": "MIT", "expat license": "MIT", "isc license": "ISC", "zlib license": "Zlib", "boost software license version 1 0": "BSL-1.0", "boost software license 1 0": "BSL-1.0",
    "apache license version 2 0": "Apache-2.0", "apache license version 2 0 the license": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "apache 2 0": "Apache-2.0", "asl 2 0": "Apache-2.0",
    "gnu general public license version 3": "GPL-3.0", "gnu general public license version 3 0": "GPL-3.0", "gnu general public license v3": "GPL-3.0", "gnu general public license v3 0": "GPL-3.0", "gnu gpl version 3": "GPL-3.0", "gnu gpl v3": "GPL-3.0", "gpl version 3": "GPL-3.0", "gpl v3": "GPL-3.0", "gplv3": "GPL-3.0", "gpl 3 0": "GPL-3.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license v2": "GPL-2.0", "gnu gpl version 2": "GPL-2.0", "gnu gpl v2": "GPL-2.0", "gpl version 2": "GPL-2.0", "gpl v2": "GPL-2.0", "gplv2": "GPL-2.0", "gpl 2 0": "GPL-2.0",
    "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license v3": "LGPL-3.0", "lgpl v3": "LGPL-3.0", "lgplv3": "LGPL-3.0", "lgpl 3 0": "LGPL-3.0", "gnu lesser general public license version 2 1": "LGPL-2.1", "gnu lesser general public license v2 1": "LGPL-2.1", "lgpl v2 1": "LGPL-2.1", "lgpl 2 1": "LGPL-2.1",
    "gnu affero general public license version 3": "AGPL-3.0", "gnu affero general public license v3": "AGPL-3.0", "agpl v3": "AGPL-3.0", "agplv3": "AGPL-3.0", "agpl 3 0": "AGPL-3.0", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0", "mpl v2": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 2 clause": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "bsd 3 clause": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "eclipse public license version 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0", "epl 2 0": "EPL-2.0",
    "cc by 4 0": "CC-BY-4.0", "cc by 4 0 license": "CC-BY-4.0", "creative commons attribution 4 0 international license": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by sa 4 0 license": "CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0", "cc by nd 4 0": "CC-BY-ND-4.0", "cc by nc sa 4 0": "CC-BY-NC-SA-4.0", "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "cc0 1 0": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0", "cc0": "CC0-1.0", "unlicense": "Unlicense", "artistic license 2 0": "Artistic-2.0",
}
#: Tags of licences, as they stand after a licence tag, normalised.
TAGS = {
    "mit": "MIT", "isc": "ISC", "zlib": "Zlib", "bsl 1 0": "BSL-1.0", "apache 2 0": "Apache-2.0", "gpl 3 0": "GPL-3.0", "gpl 3 0 only": "GPL-3.0", "gpl 3 0 or later": "GPL-3.0", "gpl 2 0": "GPL-2.0", "gpl 2 0 only": "GPL-2.0", "gpl 2 0 or later": "GPL-2.0", "lgpl 3 0": "LGPL-3.0", "lgpl 3 0 only": "LGPL-3.0", "lgpl 3 0 or later": "LGPL-3.0",
    "lgpl 2 1": "LGPL-2.1", "lgpl 2 1 only": "LGPL-2.1", "lgpl 2 1 or later": "LGPL-2.1", "agpl 3 0": "AGPL-3.0", "agpl 3 0 only": "AGPL-3.0", "agpl 3 0 or later": "AGPL-3.0", "mpl 2 0": "MPL-2.0", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "epl 2 0": "EPL-2.0",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc by nd 4 0": "CC-BY-ND-4.0", "cc by nc sa 4 0": "CC-BY-NC-SA-4.0", "cc by nc nd 4 0": "CC-BY-NC-ND-4.0", "cc0 1 0": "CC0-1.0", "unlicense": "Unlicense", "artistic 2 0": "Artistic-2.0",
}
#: What a reference may begin with, and its verbs.
SUBJECT = "(?:(?:this|the|all|our) (?:[a-z]+ ){1,3}(?:is|are) |it is )?"
VERB = "(?:released|licensed|distributed|available|published|provided|offered|shared|made available)"

#: Ordered rules, each a licence, its kind and the identifiers that have to occur in this order.
RULES = [
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", "permissive", ["mit-title", "mit-grant"]),
    ("MIT", "permissive", ["mit-title-2", "mit-grant"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("Apache-2.0", "permissive", ["apache-2-use", "apache-2-copy"]),
    ("Apache-2.0", "permissive", ["apache-2-use", "apache-2-url"]),
    ("GPL-3.0", "copyleft", ["gpl-3-modify", "gpl-hope"]),
    ("GPL-2.0", "copyleft", ["gpl-2-modify", "gpl-hope"]),
    ("MPL-2.0", "weak copyleft", ["mpl-2-ref"]),
    ("BSD-3-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Unlicense", "public domain", ["unlicense", "unlicense-grant"]),
    ("Apache-2.0", "permissive", ["apache-2-title", "apache-2-terms"]),
    ("GPL-3.0", "copyleft", ["gpl-3-title", "gpl-copies"]),
    ("GPL-2.0", "copyleft", ["gpl-2-title", "gpl-copies"]),
    ("LGPL-3.0", "weak copyleft", ["lgpl-3-title", "gpl-copies"]),
    ("AGPL-3.0", "copyleft", ["agpl-3-title", "gpl-copies"]),
    ("LGPL-2.1", "weak copyleft", ["lgpl-2-1-modify"]),
    ("AGPL-3.0", "copyleft", ["agpl-3-modify"]),
    ("MPL-2.0", "weak copyleft", ["mpl-2-title", "mpl-2-definitions"]),
    ("BSL-1.0", "permissive", ["bsl-1-title"]),
    ("BSL-1.0", "permissive", ["bsl-1-grant"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-grant"]),
    ("Artistic-2.0", "weak copyleft", ["artistic-2-title", "gpl-copies"]),
    ("Proprietary", "restricted", ["reserved"]),
]
#: Kinds of the licences that a reference alone names.
KINDS = {
    "MIT": "permissive", "ISC": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "Apache-2.0": "permissive", "GPL-3.0": "copyleft", "GPL-2.0": "copyleft", "LGPL-3.0": "weak copyleft", "LGPL-2.1": "weak copyleft", "AGPL-3.0": "copyleft", "MPL-2.0": "weak copyleft", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "EPL-2.0": "weak copyleft",
    "CC-BY-4.0": "permissive", "CC-BY-SA-4.0": "copyleft", "CC-BY-NC-4.0": "restricted", "CC-BY-ND-4.0": "restricted", "CC-BY-NC-SA-4.0": "restricted", "CC-BY-NC-ND-4.0": "restricted", "CC0-1.0": "public domain", "Unlicense": "public domain", "Artistic-2.0": "weak copyleft",
}
RULES += [(name, kind, [f"ref-{name}"]) for name, kind in KINDS.items()]

#: Rules of the first licence give way to those of the second where both hold.
NARROWER = [("BSD-2-Clause", "BSD-3-Clause")]

#: Only counts if nothing else is found.
LAST = "Proprietary"
#: Every known sentence has a word that holds one of these, so only texts that do are taken apart.
CUES = ["licen", "redistribut", "permission", "copyright", "software", "program", "free", "cc0", "copy", "reserved", "mpl", "under", "spdx", "terms"]
#: What a known sentence's words, and the words of a reference, are looked up by.
_KNOWN = {s: i for i, s in SENTENCES.items()} | {f"under {name}": f"ref-{of}" for name, of in NAMES.items()} | {f"spdx license identifier {tag}": f"ref-{of}" for tag, of in TAGS.items()}
#: What turns a lower-case text to sentences, bars between them, whose lines are words with single spaces.
STEPS = [
    ("\r\n?", "\n"), ("spdx-license-identifier:", "spdx license identifier "), ("(^|\n)[ \t*#/;>-]*\\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})\\)[ \t]+", "\n\n"), ("[^a-z0-9\n.!?;:]+", " "), (" *\n *", "\n"), ("\n\n+", "|"),
    ("[.!?;:]+[ \n]+", "|"), ("[.!?;:]+", " "), (" +", " "), (" ?\n ?", "\n"), ("[ \n]*\\|[ \n|]*", "|"),
]


def _alternatives() -> str:
    """The pattern of all sentences and references between two marks, longer ones first; words are apart by a space or two line ends."""
    longest = lambda names: "(?:" + "|".join(sorted(names, key=lambda x: (-len(x), x))) + ")"
    under = f"{SUBJECT}{VERB} under (?:the terms of )?(?:the )?{longest(NAMES)}"
    tag = f"spdx license identifier {longest(TAGS)}"
    every = [*sorted(SENTENCES.values(), key=lambda x: (-len(x), x)), under, tag]
    return "[|\n](" + "|".join(every).replace(" ", "(?: |\n\n)") + ")[|\n]"


#: What a found sentence is turned to before it is looked up: line ends to spaces, and all before a reference's name away.
FOUND = [("\n\n", " "), (f"^{SUBJECT}{VERB} under (the terms of )?(the )?", "under ")]


def _sequence(text: Column) -> Column:
    words = F.lower(text)
    cue = F.lit(False)
    for c in CUES:
        cue = cue | words.contains(c)
    for pattern, to in STEPS:
        words = F.regexp_replace(words, pattern, to)
    # Marks and line ends are doubled, so that sentences side by side have one each.
    doubled = F.concat(F.lit("|"), F.replace(F.replace(F.trim(words), F.lit("|"), F.lit("||")), F.lit("\n"), F.lit("\n\n")), F.lit("|"))
    known = F.create_map(*[F.lit(x) for s, i in _KNOWN.items() for x in (s, i)])

    def identifier(found: Column) -> Column:
        for pattern, to in FOUND:
            found = F.regexp_replace(found, pattern, to)
        return known[found]

    found = F.regexp_extract_all(doubled, F.lit(_alternatives()), F.lit(1))
    return F.when(F.coalesce(cue, F.lit(False)), F.array_compact(F.transform(found, identifier))).otherwise(F.array().cast("array<string>"))


def _pattern(ids: list[str]) -> str:
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with sentence_ids (in order), licences and kinds (sorted, comma-separated)."""
    ids, rules, found, kept = (unused(docs, c) for c in ("ids", "rules", "found", "kept"))
    mark = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    held = F.array_compact(F.array(*[F.when(mark.like(_pattern(own)), F.lit(n)) for n, (_, _, own) in enumerate(RULES)]))
    names = F.array_sort(F.array_distinct(F.transform(rules, lambda n: F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), n + 1))))
    keep = F.when(F.size(found) > 1, F.array_remove(found, LAST)).otherwise(F.col(found))
    for less, more in NARROWER:
        keep = F.when(F.array_contains(found, more), F.array_remove(keep, less)).otherwise(keep)
    kinds = F.array_sort(F.array_distinct(F.transform(kept, lambda n: F.element_at(F.create_map(*[F.lit(x) for name, kind in sorted({(r[0], r[1]) for r in RULES}) for x in (name, kind)]), n))))
    columns = [c for c in docs.columns if c not in ("sentence_ids", "licences", "kinds")]
    step = docs.select(*columns, _sequence(F.col(text).cast("string")).alias(ids))
    step = step.withColumn(rules, held).withColumn(found, names).withColumn(kept, keep)
    return step.select(*columns, F.array_join(ids, ",").alias("sentence_ids"), F.array_join(kept, ",").alias("licences"), F.array_join(kinds, ",").alias("kinds"))


def sql(source: str = "documents") -> str:
    """The same scan for DuckDB: doc_id, sentence_ids, licences, kinds."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(s)}: {q(i)}" for s, i in _KNOWN.items()) + "}"
    kind = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in sorted({(r[0], r[1]) for r in RULES})) + "}"
    held = ", ".join(f"CASE WHEN mark LIKE {q(_pattern(ids))} THEN {q(name)} END" for name, _, ids in RULES)
    keep = f"CASE WHEN len(names) > 1 THEN list_filter(names, lambda x: x <> {q(LAST)}) ELSE names END"
    for less, more in NARROWER:
        keep = f"CASE WHEN list_contains(names, {q(more)}) THEN list_filter({keep}, lambda x: x <> {q(less)}) ELSE {keep} END"
    words = "lower(coalesce(text, ''))"
    for pattern, to in STEPS:
        words = f"regexp_replace({words}, {q(pattern)}, {q(to)}, 'g')"
    found = "x"
    for pattern, to in FOUND:
        found = f"regexp_replace({found}, {q(pattern)}, {q(to)}, 'g')"
    return f"""
WITH sentences AS (
  SELECT doc_id, regexp_extract_all('|' || replace(replace(trim({words}), '|', '||'), chr(10), chr(10) || chr(10)) || '|', {q(_alternatives())}, 1) AS s FROM {source}
), ids AS (
  SELECT doc_id, list_filter(list_transform(s, lambda x: {known}[{found}]), lambda y: y IS NOT NULL) AS ids FROM sentences
), marks AS (
  SELECT doc_id, ids, '|' || array_to_string(ids, '||') || '|' AS mark FROM ids
), found AS (
  SELECT doc_id, ids, list_sort(list_distinct(list_filter([{held}], lambda x: x IS NOT NULL))) AS names FROM marks
), kept AS (
  SELECT doc_id, ids, {keep} AS kept FROM found
)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(kept, ',') AS licences,
       array_to_string(list_sort(list_distinct(list_transform(kept, lambda n: {kind}[n]))), ',') AS kinds
FROM kept
"""
