"""Licence scans by sentence rules.

A text is normalised (comment signs at the beginning of lines dropped, A-Z lower-cased, everything but
letters, digits and full stops inside words to single blanks) and known licence sentences are found in
it. A sentence begins and ends at a full stop, ! ? ; or : before white space, at a blank line, or at the
end of a line; line ends within it don't matter, so a licence may be wrapped anywhere. The identifiers
found, in reading order, are matched against rules in their order: a rule holds where its identifiers
follow each other, and then the later rules of the same licence that are part of it add nothing, be it
that their identifiers are in it or that its text always comes with theirs.

Only DataFrame functions. Null and empty texts have no sentence and no licence; very long texts are read
whole, in time linear in their length; repeated rows give repeated results. ``scan_licenses`` keeps all
further columns; those named like its own are replaced. The query ignores them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, by identifier: fixed values from the licences' own texts.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2.0",
    "apache-short-the": "licensed under the apache license 2.0",
    "apache-released": "released under the apache license version 2.0",
    "apache-grant": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-title": "apache license version 2.0 january 2004",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-licensed": "licensed under the isc license",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd2-licensed": "licensed under the bsd 2 clause license",
    "bsd3-licensed": "licensed under the bsd 3 clause license",
    "gpl2-short": "this work is licensed under the gnu general public license version 2",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "lgpl-free": "this library is free software",
    "gpl2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "lgpl21-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "distributed under the boost software license version 1.0",
    "cc-by-nc-short": "licensed under cc by nc 4.0",
    "cc-by-sa-short": "licensed under cc by sa 4.0",
    "cc-by-short": "licensed under cc by 4.0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
}
# Licences that a tag may name: fixed values, identifiers of the SPDX list.
TAGGED = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def normal(text: str) -> str:
    """A known sentence as it appears in a normalised text."""
    return re.sub("[^a-z0-9.]+", " ", text.lower()).strip()


SENTENCES |= {f"tag-{t}": normal(f"SPDX-License-Identifier: {t}").split(" ", 3)[-1] for t in TAGGED}
TAG = "spdx license identifier"
# Rules in order, the longer ones of a licence first: name, licence, sentence identifiers. Fixed values.
RULES = (
    ("apache-header", "Apache-2.0", ("apache-grant", "apache-comply", "apache-obtain", "apache-as-is")),
    ("apache-title", "Apache-2.0", ("apache-title",)),
    ("apache-notice", "Apache-2.0", ("apache-short",)),
    ("apache-notice-2.0", "Apache-2.0", ("apache-short-the",)),
    ("apache-released", "Apache-2.0", ("apache-released",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("mit-title", "MIT", ("mit-title",)),
    ("mit-title-short", "MIT", ("mit-title-short",)),
    ("mit-notice", "MIT", ("mit-short",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is")),
    ("isc-licensed", "ISC", ("isc-licensed",)),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd-2-licensed", "BSD-2-Clause", ("bsd2-licensed",)),
    ("bsd-3-licensed", "BSD-3-Clause", ("bsd3-licensed",)),
    ("agpl-3-header", "AGPL-3.0-or-later", ("gpl-free", "agpl3-later", "gpl-hope")),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl-free", "lgpl3-later", "lgpl-hope")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later", "lgpl-hope")),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-hope")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl-hope")),
    ("gpl-3-only-header", "GPL-3.0-only", ("gpl-free", "gpl3-only", "gpl-hope")),
    ("gpl-2-only-header", "GPL-2.0-only", ("gpl-free", "gpl2-only", "gpl-hope")),
    ("gpl-3-notice", "GPL-3.0-only", ("gpl3-short",)),
    ("gpl-2-notice", "GPL-2.0-only", ("gpl2-short",)),
    ("mpl-2-header", "MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("mpl-2-header-http", "MPL-2.0", ("mpl2-subject", "mpl2-copy-http")),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("boost-notice", "BSL-1.0", ("boost-grant",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("cc-by-notice", "CC-BY-4.0", ("cc-by-short",)),
    ("cc-by-text", "CC-BY-4.0", ("cc-by-long",)),
    *((f"spdx-{t}", t, (f"tag-{t}",)) for t in TAGGED),
)
# What a longer rule says already: rules of the same licence that add nothing beside it. Fixed values.
COVERED = {"apache-header": ("apache-title", "apache-notice"), "mit-text": ("mit-title", "mit-title-short"), "bsd-3-text": ("bsd-2-text",)}
#: Every known sentence has one of these words; other texts need not be normalised.
HINT = "(?i)licen|permission|copyright|free software|warrant|compliance|redistribution|public domain|misrepresented|mpl "
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentence boundaries, and line ends that may be one.
HARD, SOFT = "\x01", "\x02"


def _known() -> str:
    """A pattern of one known sentence from a boundary to a boundary, with line ends anywhere between its words; longer sentences first."""
    forms = [re.escape(s).replace("\\ ", " ").replace(" ", f"[ {SOFT}]") for s in SENTENCES.values() if s]
    tags = "|".join(sorted((re.escape(SENTENCES[f"tag-{t}"]).replace("\\ ", " ") for t in TAGGED), key=lambda s: (-len(s), s)))
    plain = [f for k, f in zip(SENTENCES, forms) if not k.startswith("tag-")]
    body = "|".join(sorted(plain, key=lambda s: (-len(s), s)))
    return f"(?<=[{HARD}{SOFT}])(?:(?:{body})|{TAG}{HARD}(?:{tags}))(?=[{HARD}{SOFT}])"


def marked(text: Column) -> Column:
    """The normalised text with boundaries marked, one at either end."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*(?://+|/?\*+/?|#+|;+|--+|%+|<!--)[ \t]*", "")
    t = F.regexp_replace(t, r"\bv\.[ \t\r\n]+([0-9])", "v.\x03$1")
    t = F.regexp_replace(t, r"[.!?;:]+([ \t\r\n\f]+|$)|\n[ \t\r\f]*\n", HARD)
    t = F.regexp_replace(F.translate(t, CAPITALS + "\n", SMALL + SOFT), f"[^a-z0-9.{HARD}{SOFT}]+", " ")
    t = F.regexp_replace(F.concat(F.lit(HARD), t, F.lit(HARD)), f"[ {SOFT}]*{HARD}[ {HARD}{SOFT}]*", HARD)
    return F.regexp_replace(t, f" ?{SOFT}[ {SOFT}]*", SOFT)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (array of identifiers in order), rules (array, in their order) and licenses (sorted array)."""
    own = ("sentence_ids", "rules", "licenses")
    t, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    found = F.regexp_extract_all(marked(t), F.lit(_known()), F.lit(0))
    names = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in ((f"{TAG} {s}" if k.startswith("tag-") else s), k)])
    df = docs.withColumn("__lic_found", F.when(t.rlike(HINT), found).otherwise(none))
    df = df.withColumn("__lic_ids", F.transform("__lic_found", lambda s: F.element_at(names, F.translate(s, HARD + SOFT, "  "))))
    df = df.withColumn("__lic_line", F.concat(F.lit(","), F.array_join("__lic_ids", ","), F.lit(",")))
    holds = {rule: F.contains("__lic_line", F.lit("," + ",".join(seq) + ",")) for rule, _, seq in RULES}
    by = {}
    for longer, shorter in COVERED.items():
        for r in shorter:
            by.setdefault(r, []).append(longer)
    hits = []
    for rule, lic, _ in RULES:
        one = holds[rule]
        for longer in by.get(rule, ()):
            one = one & ~holds[longer]
        hits.append(F.when(one, F.struct(F.lit(rule).alias("rule"), F.lit(lic).alias("license"))))
    df = df.withColumn("__lic_hits", F.when(F.size("__lic_ids") > 0, F.filter(F.array(*hits), lambda h: h.isNotNull())).otherwise(F.array().cast("array<struct<rule:string,license:string>>")))
    return df.select(
        *[c for c in docs.columns if c not in own],
        F.col("__lic_ids").alias("sentence_ids"),
        F.transform("__lic_hits", lambda h: h["rule"]).alias("rules"),
        F.array_sort(F.array_distinct(F.transform("__lic_hits", lambda h: h["license"]))).alias("licenses"),
    )


def license_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, rules and licenses (comma-joined) of every document."""
    found = scan_licenses(docs.select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licenses")])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """The same in DuckDB SQL, by joins: runs of up to 30 lines between two hard boundaries are looked up whole."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(s)})" for k, s in SENTENCES.items() if not k.startswith("tag-"))
    tags = ", ".join(f"('tag-{t}', {_quoted(SENTENCES[f'tag-{t}'])})" for t in TAGGED)
    rules = ", ".join(f"({k}, {_quoted(r)}, {_quoted(lic)}, {_quoted(',' + ','.join(seq) + ',')})" for k, (r, lic, seq) in enumerate(RULES))
    covered = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, bs in COVERED.items() for b in bs)
    steps = "coalesce(text, '')"
    for pattern, to in ((r"(?m)^[ \t]*(?://+|/?\*+/?|#+|;+|--+|%+|<!--)[ \t]*", "''"), (r"\bv\.[ \t\r\n]+([0-9])", r"'v.' || chr(3) || '\1'"), (r"[.!?;:]+([ \t\r\n\f]+|$)|\n[ \t\r\f]*\n", "chr(1)")):
        steps = f"regexp_replace({steps}, {_quoted(pattern)}, {to}, 'g')"
    return f"""
    WITH known(name, s) AS (VALUES {known}), tags(name, s) AS (VALUES {tags}), rules(o, rule, license, seq) AS (VALUES {rules}), covered(longer, rule) AS (VALUES {covered}),
    d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    c AS (SELECT r, string_split({steps}, chr(1)) AS parts FROM d WHERE regexp_matches(coalesce(text, ''), {_quoted(HINT)})),
    p AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM c),
    q AS (SELECT r, k, list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(regexp_replace(translate(x, '{CAPITALS}', '{SMALL}'), '[^a-z0-9.]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM p),
    q2 AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS k, lines FROM q WHERE len(lines) > 0),
    s AS (SELECT r, k, lines, unnest(range(1, len(lines) + 1)) AS i FROM q2),
    e AS (SELECT r, k, i, unnest(range(i, least(i + 30, len(lines) + 1))) AS j, lines FROM s),
    f AS (SELECT r, k, i, j, name FROM e JOIN known ON array_to_string(lines[i:j], ' ') = known.s
          UNION ALL SELECT a.r, a.k, len(a.lines), len(a.lines), name FROM q2 a JOIN q2 b ON a.r = b.r AND b.k = a.k + 1 JOIN tags ON b.lines[1] = tags.s WHERE a.lines[len(a.lines)] = '{TAG}'),
    g AS (SELECT r, k, i, name FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.r = f.r AND o.k = f.k AND o.i <= f.i AND o.j >= f.j AND (o.i < f.i OR o.j > f.j))),
    w AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY k, i) AS ids FROM g GROUP BY r),
    h AS (SELECT r, o, rule, license FROM w JOIN rules ON contains(',' || ids || ',', seq)),
    h2 AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM covered JOIN h l ON l.rule = longer WHERE covered.rule = h.rule AND l.r = h.r)),
    z AS (SELECT r, string_agg(rule, ',' ORDER BY o) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM h2 GROUP BY r)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
    FROM d LEFT JOIN w USING (r) LEFT JOIN z USING (r)"""
