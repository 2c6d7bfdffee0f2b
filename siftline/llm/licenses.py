"""Licence scans: known sentences, then ordered rules over their identifiers."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, let

# Normalised sentences of published licences, by identifier.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-regents": "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "free-program": "this program is free software",
    "gpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
}
# Ordered rules, licence and identifiers in a row.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-keep", "as-is", "mit-liability"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-university", "bsd-regents"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-regents"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-limits"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["free-program", "gpl3-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["free-program", "gpl2-redistribute", "gpl-hope", "gpl-details"]),
    ("MPL-2.0", ["mpl-terms", "mpl-copy"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost"]),
    ("Zlib", ["zlib-as-is", "zlib-liability"]),
    ("CC0-1.0", ["cc0"]),
]
# Names under which statements of use know a licence.
NAMED = {
    "MIT": ["mit license"], "ISC": ["isc license"], "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license"], "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license"],
    "Apache-2.0": ["apache license 2 0", "apache license version 2 0", "apache 2 0 license"], "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"],
    "GPL-2.0": ["gnu general public license v2 0", "gnu general public license version 2", "gnu gpl v2"], "GPL-3.0": ["gnu general public license v3 0", "gnu general public license version 3", "gnu gpl v3"],
    "Unlicense": ["unlicense"], "BSL-1.0": ["boost software license 1 0"], "Zlib": ["zlib license"], "CC0-1.0": ["cc0 1 0 universal public domain dedication"],
}
# What the letters of a Creative Commons licence and its versions are called in its deed.
TERMS_OF_CC = {"BY": "attribution", "SA": "sharealike", "ND": "noderivatives", "NC": "noncommercial"}
PORT_OF_CC = {"1.0": "generic", "2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}
# What a statement of use may start and end with, besides the licence: "This project is distributed under the X - see the LICENSE file for details".
SUBJECT = "^(this (project|software|program|code|library|package|repository|work|content|site|page|article|file|document) is )?((made )?available|licensed|released|distributed|provided) under (the terms of )?(the|a|an) "
OUTLOOK = "( international license)? (see|refer to) (the )?(accompanying )?(license|copying)( md| txt| rst)?( file)?( for (the )?(more |full )?(details|information|license text|license))?$"

for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        name = f"cc-{kind}-{version}".lower()
        SENTENCES[name] = f"licensed under cc {kind} {version}".lower().replace("-", " ").replace(".", " ")
        RULES.append((f"CC-{kind}-{version}", [name]))
        terms = " ".join(TERMS_OF_CC[x] for x in kind.split("-"))
        terms = terms if version == "4.0" else terms.replace("noderivatives", "noderivs")
        NAMED[f"CC-{kind}-{version}"] = [f"creative commons {terms} {version.replace('.', ' ')} {PORT_OF_CC[version]} license", f"creative commons {terms} {version.replace('.', ' ')} license"]

# Notices of the same frame as GPL's, as (identifier, licence, what is licensed, name, version).
FRAMED = [
    ("lgpl21", "LGPL-2.1-or-later", "library", "GNU Lesser General Public License", "2.1"),
    ("lgpl3", "LGPL-3.0-or-later", "library", "GNU Lesser General Public License", "3"),
    ("agpl3", "AGPL-3.0-or-later", "program", "GNU Affero General Public License", "3"),
]
#: Where sentences end: closing marks before white space, a colon at the end of a line, or an empty line.
END = r"[.!?;]+\s+|:[ \t\r]*\n|\n[ \t\r]*\n"
#: Where a part that isn't known is cut further: a line without letters and digits, as in comments.
MARKS = r"\n[^\p{L}\p{N}\n]*\n"

#: What numbers an item of a list.
ITEM = "^([0-9]{1,2}|[a-z]) "

TERMS = "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
LATER = "version {} of the License, or (at your option) any later version"
# Published wordings that SENTENCES lacks, or that END cuts; the cut ones count where all their pieces follow each other.
WORDINGS = [
    *((name, f"you can {TERMS}; either {LATER.format(n)}") for name, n in (("gpl3-redistribute", 3), ("gpl2-redistribute", 2))),
    *((name, f"This program is free software: you can {TERMS}; either {LATER.format(n)}") for name, n in (("gpl-free", 3), ("gpl2-free", 2))),
    *((f"{i}-redistribute", f"you can {TERMS.replace('GNU General Public License', name)}; either {LATER.format(n)}") for i, _, _, name, n in FRAMED),
    *((f"{i}-free", f"This {what} is free software: you can {TERMS.replace('GNU General Public License', name)}; either {LATER.format(n)}") for i, _, what, name, n in FRAMED),
    ("library-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("apache-copy", "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"),
    ("mpl-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
]
# Sequences that give a licence of RULES too, in its place.
OTHER_RULES = [
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
]


def pieces(wording: str) -> list[str]:
    """The normalised parts into which END cuts a wording."""
    return [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in re.split(END, wording)]


# the same in one sentence, and the rules of the framed notices
for i, licence, what, name, n in FRAMED:
    whole = {w: " ".join(pieces(t)) for w, t in WORDINGS}
    SENTENCES.update({f"{i}-redistribute": whole[f"{i}-redistribute"], f"{i}-free": whole[f"{i}-free"], f"{i[:4]}-details": f"see the {name.lower()} for more details", "free-library": "this library is free software", "library-hope": whole["library-hope"]})
    hope = "gpl-hope" if what == "program" else "library-hope"
    RULES.append((licence, [f"free-{what}", f"{i}-redistribute", hope, f"{i[:4]}-details"]))
    OTHER_RULES.append((licence, [f"{i}-free", hope, f"{i[:4]}-details"]))


# a statement of use, without its subject, verb and outlook, and the identifier line of a file
for licence, names in NAMED.items():
    for n in names:
        SENTENCES[f"use-{licence.lower()}-{names.index(n)}"] = f"under {n}"
        RULES.append((licence, [f"use-{licence.lower()}-{names.index(n)}"]))
for licence in dict.fromkeys(x for x, _ in RULES):
    for i, suffix in enumerate(["", " only"] if licence in ("GPL-2.0", "GPL-3.0") else [""]):
        SENTENCES[f"spdx-{licence.lower()}-{i}"] = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", licence.lower()) + suffix
        RULES.append((licence, [f"spdx-{licence.lower()}-{i}"]))
RULES.sort(key=lambda r, first={x: i for i, x in reversed(list(enumerate(x for x, _ in RULES)))}: first[r[0]])


def normalised(s: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def lookups(sentences: dict | None = None, rules: list | None = None):
    """(code of each known text, pieces of the wordings that END cuts, rules in order); a piece's code is its text behind a plus sign."""
    wordings = [(i, pieces(w)) for i, w in WORDINGS] if sentences is None else []
    if rules is None:
        rules = [x for k, (licence, seq) in enumerate(RULES) for x in ((licence, seq), *((a, b) for a, b in OTHER_RULES if a == licence and licence not in (r for r, _ in RULES[:k])))]
    cuts = [(i, ["+" + x for x in w]) for i, w in wordings if len(w) > 1]
    codes = {x[1:]: x for _, w in cuts for x in w} | {w[0]: i for i, w in wordings if len(w) == 1} | {s: i for i, s in (sentences or SENTENCES).items()}
    return codes, cuts, rules


def scan(docs: DataFrame, text: str = "text", sentences: dict | None = None, rules: list | None = None) -> DataFrame:
    """Add sentence_ids and licences (arrays of strings) to ``docs``, replacing columns so named.

    A text is cut into sentences (see END) and each is normalised; a sentence
    that is known as a whole, list numbers and letters aside, or as a statement
    of use, which SUBJECT starts and OUTLOOK may end, gives its identifier, else
    it is cut at lines without letters and digits, and of what isn't known as a
    whole each line is looked up.  A sentence of WORDINGS that END cuts is known
    where its pieces follow each other.  Unknown sentences drop out, and a rule
    holds where its identifiers follow each other in what is left.  licences
    has each licence of a rule that holds once, in the order of the rules.
    Null and empty texts give empty arrays.  All of it happens inside a row:
    nothing is shuffled, and repeated rows are scanned alike.  ``sentences``
    and ``rules`` of one's own come without WORDINGS and OTHER_RULES.
    """
    codes, cuts, rules = lookups(sentences, rules)
    known = F.map_from_arrays(F.array(*map(F.lit, codes)), F.array(*map(F.lit, codes.values())))

    def lookup(s):
        use = lambda n: F.when(F.rlike(n, F.lit(SUBJECT)), F.try_element_at(known, F.regexp_replace(F.regexp_replace(n, SUBJECT, "under "), OUTLOOK, "")))
        item = lambda n: F.when(F.rlike(n, F.lit(ITEM)), F.try_element_at(known, F.regexp_replace(n, ITEM, "")))
        return let(normalised(s), lambda n: F.when(n != "", F.coalesce(F.try_element_at(known, n), item(n), use(n), F.lit("?"))))

    def units(s, deeper):
        """Codes of a text that is known as a whole, else of what it is cut into; ? is unknown, null blank."""
        return let(lookup(s), lambda x: F.when((x == "?") & F.contains(s, F.lit("\n")), deeper(s)).otherwise(F.array(x)))

    def each_line(s):
        return F.transform(F.split(s, "\n"), lookup)

    def each_passage(s):
        return F.flatten(F.transform(F.split(s, MARKS), lambda x: units(x, each_line)))

    def joined(us):
        """Identifiers, with that of a cut sentence at its first piece."""

        def one(u, i):
            whole = [F.when(reduce(lambda a, b: a & b, (F.get(us, i + n).eqNullSafe(F.lit(x)) for n, x in enumerate(w))), F.lit(id)) for id, w in cuts]
            return F.when(F.startswith(u, F.lit("+")), F.coalesce(*whole, F.lit(None).cast("string"))).when(u != "?", u)

        return F.array_compact(F.transform(us, one))

    kept = [c for c in docs.columns if c.lower() not in ("sentence_ids", "licences")]
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), END), lambda s: units(s, each_passage))
    x = docs.select(*(col(c) for c in kept), let(F.array_compact(F.flatten(parts)), joined).alias("sentence_ids"))
    row = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    held = F.array(*(F.when(F.contains(row, F.lit("|" + "|".join(seq) + "|")), F.lit(licence)) for licence, seq in rules))
    return x.withColumn("licences", F.when(F.size("sentence_ids") > 0, F.array_distinct(F.array_compact(held))).otherwise(F.array().cast("array<string>")))


def scan_sql(table: str = "documents") -> str:
    """The same for DuckDB, from the same tables: doc_id, n_sentences, licences joined by commas, of ``table`` (doc_id, text)."""
    quote = lambda s: "'" + s + "'"
    codes, cuts, rules = lookups()
    known = f"MAP {{{', '.join(f'{quote(s)}: {quote(i)}' for s, i in codes.items())}}}"
    held = ", ".join(f"CASE WHEN contains(ids, '|{'|'.join(seq)}|') THEN {quote(licence)} END" for licence, seq in rules)
    whole = " ".join(f"WHEN list_slice(us, i, i + {len(w) - 1}) = [{', '.join(map(quote, w))}] THEN {quote(i)}" for i, w in cuts)
    space = lambda p: p.replace(r"\s", r"[ \t\r\n\f\v]")
    norm = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"

    def coded(rows, place):
        """``rows`` (doc_id, part, places) with the code of each part: null if blank, ? if unknown."""
        look = lambda n: f"map_extract(t.known, {n})[1]"
        use = f"CASE WHEN regexp_matches(n, '{SUBJECT}') THEN {look(f"regexp_replace(regexp_replace(n, '{SUBJECT}', 'under '), '{OUTLOOK}', '')")} END"
        item = f"CASE WHEN regexp_matches(n, '{ITEM}') THEN {look(f"regexp_replace(n, '{ITEM}', '')")} END"
        return f"SELECT doc_id, part, {place}, CASE WHEN n <> '' THEN coalesce({look('n')}, {item}, {use}, '?') END AS code FROM (SELECT *, {norm('part')} AS n FROM ({rows})) x, t"

    cut = lambda rows, pattern, place: f"SELECT doc_id, {place}, unnest(x) AS part, generate_subscripts(x, 1) AS k FROM (SELECT *, string_split_regex(part, '{pattern}') AS x FROM {rows})"
    return f"""
WITH t AS (SELECT {known} AS known), d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS part FROM {table}),
a AS ({coded(f"SELECT row AS doc_id, part, k AS o1 FROM ({cut('d', space(END), 'row')})", 'o1')}),
b AS ({coded(f"SELECT doc_id, part, o1, k AS o2 FROM ({cut("(SELECT * FROM a WHERE code = '?' AND contains(part, chr(10)))", MARKS, 'o1')})", 'o1, o2')}),
c AS ({coded(f"SELECT doc_id, part, o1, o2, k AS o3 FROM ({cut("(SELECT * FROM b WHERE code = '?' AND contains(part, chr(10)))", chr(92) + 'n', 'o1, o2')})", 'o1, o2, o3')}),
u AS (SELECT doc_id, o1, 0 AS o2, 0 AS o3, code FROM a WHERE NOT (code = '?' AND contains(part, chr(10))) UNION ALL SELECT doc_id, o1, o2, 0, code FROM b WHERE NOT (code = '?' AND contains(part, chr(10))) UNION ALL SELECT doc_id, o1, o2, o3, code FROM c),
l AS (SELECT doc_id, list(code ORDER BY o1, o2, o3) AS us FROM u WHERE code IS NOT NULL GROUP BY doc_id),
j AS (SELECT doc_id, list_filter(list_transform(us, lambda code, i: CASE WHEN starts_with(code, '+') THEN CASE {whole} END WHEN code <> '?' THEN code END), lambda code: code IS NOT NULL) AS ids FROM l),
r AS (SELECT doc_id, len(ids) AS n, '|' || array_to_string(ids, '|') || '|' AS ids FROM j)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences, coalesce((SELECT string_agg(x, ',' ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest([{held}]) AS x, generate_subscripts([{held}], 1) AS k) WHERE x IS NOT NULL GROUP BY x)), '') AS licences
FROM d LEFT JOIN r ON r.doc_id = d.row
"""
