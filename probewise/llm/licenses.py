"""License scan by sentence rules.

A text is cut into sentences, each brought to a plain form and looked up among
known licence sentences. The identifiers that are found, in the order of the
text, are matched against ordered rules: a licence is recognised where the
identifiers of one of its rules follow each other. Longer rules come first and
take their identifiers away, so a notice isn't also what its beginning would be
alone. Everything runs as Spark expressions, without a shuffle.

Whole notices and identifier lines are cut like texts, and their pieces are
identifiers and rules too.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import UPPER, query, read

# fixed values: licence sentences by identifier, in their plain form
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-ref-3": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-ref": "licensed under the apache license version 2.0",
    "apache-ref-2": "licensed under the apache license version 2.0 the license",
    "apache-file": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "cc-by-nc-4-ref": "licensed under cc by nc 4.0",
    "cc-by-4-ref": "licensed under cc by 4.0",
    "cc-by-sa-4-ref": "licensed under cc by sa 4.0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
}

# fixed values: licences and the sentences that make them, in order
RULES = (
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-ref-2",)),
    ("Apache-2.0", ("apache-file", "apache-copy", "apache-basis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl3-ref-2",)),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-hope")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-ref-3",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
)

#: A sentence ends at a sign that a space or the end follows, or at an empty line.
END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n[\x20\x09\x0D]*\n"
#: Every known sentence has one of these words.
HINT = r"(?i)licen[sc]e|permi|warrant|redistribut|copyright|endorse|mpl was|unencumbered"
#: The mark before a licence identifier, without its sign at the end no sentence ends there.
TAG, TAG_PLAIN = r"(?i)spdx-license-identifier:[\x20\t]*", "SPDX-License-Identifier "


def plain(sentence: Column) -> Column:
    """Lower case, runs of other characters than letters, digits and inner points as one space."""
    low = F.translate(sentence, UPPER, UPPER.lower())
    spaced = F.regexp_replace(low, r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\.+(?= |$)|(?<= )\.+", ""))


# fixed values: notices as they are printed, from the sentence with which a licence is recognised
APACHE = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    %s://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This %s is free software%s you can redistribute it and/or modify
it under the terms of the GNU %s as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

This %s is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GPL_ONLY = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License version %s as
published by the Free Software Foundation."""
UNLICENSE = "This is free and unencumbered software released into the public domain."
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at %s://mozilla.org/MPL/2.0/."""
# fixed values: the licences whose notices share a wording, with their names and versions
FAMILIES = (
    ("GPL-2.0", "gpl2", "General Public License", "2"),
    ("GPL-3.0", "gpl", "General Public License", "3"),
    ("LGPL-2.1", "lgpl2", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "lgpl", "Lesser General Public License", "3"),
    ("AGPL-3.0", "agpl", "Affero General Public License", "3"),
)
NOTICES = (
    ("Apache-2.0", "apache", APACHE % "http"),
    ("Apache-2.0", "apache", APACHE % "https"),
    *(
        (f"{licence}-or-later", name, GPL % (what, first, words, second, version, what))
        for licence, name, words, version in FAMILIES
        for what in ("program", "library")
        for first, second in ((":", ","), (";", ";"), (";", ","))
    ),
    *((f"GPL-{version}.0-only", f"gpl{version}-only", GPL_ONLY % (sign, version)) for version in "23" for sign in ":;"),
    ("MPL-2.0", "mpl", MPL % "https"),
    ("MPL-2.0", "mpl", MPL % "http"),
    ("Unlicense", "unlicense", UNLICENSE),
)
# fixed values: licence identifiers that a tagged line may name
TAGGED = """
AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0
EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib
""".split()


def pieces(notice: str) -> list[str]:
    """The hinted sentences of a notice, cut and brought to their plain form as in ``identifiers``."""
    spaced = [re.sub(r"[^a-z0-9.]+", " ", s.lower()) for s in re.split(END, notice) if re.search(HINT, s)]
    return [re.sub(r"\.+(?= |$)|(?<= )\.+", "", s).strip() for s in spaced]


def with_notices(sentences: dict[str, str], rules, notices=NOTICES, tagged=TAGGED) -> tuple[dict[str, str], tuple]:
    """The sentences and rules with those of the notices, as they stand alone and in comments without empty lines, and of tagged lines."""
    names = {s: name for name, s in sentences.items()}
    found = list(rules)
    for licence, name, notice in notices:
        for form in (notice, re.sub(r"(?m)^", "# ", notice)):
            parts = pieces(form)
            for s in parts:
                if s not in names:
                    names[s] = f"{name}-notice-{1 + sum(n.startswith(f'{name}-notice') for n in names.values())}"
            found.append((licence, tuple(names[s] for s in parts)))
    for licence in tagged:
        names[pieces(TAG_PLAIN + licence)[0]] = f"tag-{licence.lower()}"
        found.append((licence, (f"tag-{licence.lower()}",)))
    return {name: s for s, name in names.items()}, tuple(dict.fromkeys(found))


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order.

    A sentence may run over several lines; where it isn't known as a whole, its
    lines are looked up, as a licence line often follows one without an end.
    """
    by_text = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, name) for name, s in sentences.items())])

    def known(part: Column) -> Column:
        return F.element_at(by_text, plain(part))

    def of(sentence: Column) -> Column:
        lines = F.filter(F.transform(F.split(sentence, r"\n"), known), lambda x: x.isNotNull())
        return F.when(known(sentence).isNotNull(), F.array(known(sentence))).otherwise(lines)

    # only sentences with a hint can be known, and most texts have none
    hinted = F.filter(F.split(F.regexp_replace(text, TAG, TAG_PLAIN), END), lambda s: s.rlike(HINT))
    return F.when(text.rlike(HINT), F.flatten(F.transform(hinted, of))).otherwise(F.array().cast("array<string>"))


def longest_first(rules) -> list[tuple[str, str]]:
    """The rules as ``(licence, its identifiers in one string)``, with the most identifiers first, then as listed."""
    return [(name, "".join(f" {x} " for x in rule)) for name, rule in sorted(rules, key=lambda r: -len(r[1]))]


def licenses_of(ids: Column, rules) -> Column:
    """The licences whose rules the identifiers meet, sorted.

    A rule's identifiers must follow each other. Rules are tried from the
    longest to the shortest, and what one has met is no part of a later one.
    """
    line = F.array_join(F.transform(ids, lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule).alias("rule")) for name, rule in longest_first(rules)])
    nothing = F.array().cast("array<string>")

    def step(state: Column, x: Column) -> Column:
        met = F.contains(state["line"], x["rule"])
        return F.struct(
            F.when(met, F.replace(state["line"], x["rule"], F.lit("#"))).otherwise(state["line"]).alias("line"),
            F.when(met, F.array_append(state["found"], x["name"])).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(listed, F.struct(line.alias("line"), nothing.alias("found")), step, lambda s: F.array_sort(F.array_distinct(s["found"])))
    return F.when(F.size(ids) > 0, found).otherwise(nothing)


#: What texts are scanned for.
ALL_SENTENCES, ALL_RULES = with_notices(SENTENCES, RULES)


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=ALL_RULES) -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licenses`` (arrays; both empty where nothing is known).

    Null and empty texts have neither. Repeated sentences are listed each time,
    a licence once. The two columns replace columns of these names.
    """
    found = docs.withColumn("sentence_ids", identifiers(F.coalesce(F.col(text), F.lit("")), sentences or ALL_SENTENCES))
    return found.withColumn("licenses", licenses_of(F.col("sentence_ids"), rules))


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    names = ", ".join(f"'{n}'" for n in ALL_SENTENCES)
    texts = ", ".join(f"'{s}'" for s in ALL_SENTENCES.values())
    rules = longest_first(ALL_RULES)
    tried = ", ".join(f"contains(l{i}, '{r}') AS c{i}, replace(l{i}, '{r}', '#') AS l{i + 1}" for i, (_, r) in enumerate(rules))
    met = ", ".join(f"CASE WHEN c{i} THEN '{n}' END" for i, (n, _) in enumerate(rules))
    end = END.replace("$", r"\z")

    def known(x: str) -> str:
        low = f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
        spaced = f"regexp_replace({low}, '[^a-z0-9.]+', ' ', 'g')"
        return f"""map_extract(m, trim(regexp_replace(regexp_replace(regexp_replace({spaced}, '\\.+ ', ' ', 'g'), '\\.+$', ''), ' \\.+', ' ', 'g'), ' '))"""

    return rf"""
    WITH k AS (SELECT map([{texts}], [{names}]) AS m),
    s AS (SELECT doc_id, m, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '{TAG}', '{TAG_PLAIN}', 'g'), '{end}'),
                                        lambda x: regexp_matches(x, '{HINT}')) AS parts FROM documents, k),
    i AS (SELECT doc_id, flatten(list_transform(parts, lambda x: CASE WHEN len({known('x')}) > 0 THEN {known('x')}
          ELSE flatten(list_transform(string_split(x, chr(10)), lambda y: {known('y')})) END)) AS ids FROM s),
    l AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: ' ' || x || ' '), '') AS l0 FROM i),
    t AS (SELECT doc_id, ids, {tried} FROM l)
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
           coalesce(array_to_string(list_sort(list_distinct(list_filter([{met}], lambda x: x IS NOT NULL))), ','), '') AS licenses
    FROM t
    """


@query("op8_license_scan", oracle())
def op8_license_scan(spark, sf_dir):
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )
