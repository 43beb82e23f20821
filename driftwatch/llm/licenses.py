"""License scans by sentence rules, with built-in functions only.

A text is cut into sentences at line ends and after ``.``, ``!``, ``?`` or ``;``
followed by white space. A known sentence may also be wrapped over the lines of a paragraph, with or without
comment signs before each: it begins and ends where a line or a sentence does. A sentence is normalised to lower-case words of a-z and
0-9 with single spaces; one that holds an abbreviation or a semicolon is known as a whole. A known sentence may have a part of up to ``VARIES`` words for
the name of a holder or a program. What follows ``SPDX-License-Identifier:`` is an expression: each name in it is a sentence. Known sentences have an identifier; the identifiers of a
document, in order, form a sequence. A rule is an ordered sequence of identifiers
and matches where they follow each other with at most ``GAP`` ends of sentences or paragraphs, and no other known sentence, between two. A rule that
another one includes doesn't count beside it.

Nulls, empty texts and texts without a known sentence match nothing: empty
lists. Sentences that repeat are listed as often, licenses once, in the order of
``RULES``. Rows are independent; extra columns pass through and output names
replace columns of the same name. An empty table stays empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comment signs at the begin of a line, the end of a sentence, what is no word, and a line end with spaces around.
COMMENT, BREAK, OTHER, END = r"\n[ \t]*[#*;/!%|>-]+[ \t]+", r"([.!?;])(?:[ \t\r\f\x0B]+\n?|\n)", r"[^a-z0-9\n]+", r" ?\n ?"

#: Ends of sentences and paragraphs between two sentences of a rule, at most.
GAP = 8
#: Words of a name inside a sentence, at most, and how such a part is written in ``SENTENCES`` and is seen in their normal form.
VARIES, HOLE, SEEN = 12, "{}", "0hole0"
#: Licenses that a file may name in one line, by their common identifiers.
NAMED = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0"
    " EPL-1.0 EPL-2.0 EUPL-1.2 AGPL-3.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0"
    " OFL-1.1 SSPL-1.0 Unlicense WTFPL Zlib"
).split()
#: Names of the forms of the attribution licenses.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
           "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Identifiers of known license sentences, as their licences and notices have them.
SENTENCES = {
    "cc0": ["To the extent possible under law, the author has dedicated all copyright to the public domain.", "Released under CC0 1.0."],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with {}."],
    "lgpl-2-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gfdl-grant": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;"],
    "apache-2": ["Licensed under the Apache License, Version 2.0."],
    "apache-notice": ['Licensed under the Apache License, Version 2.0 (the "License");', 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");'],
    "apache-may-not": ["you may not use this file except in compliance with the License."],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "apache-unless": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-0-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 
                    "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
                    "Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
                    "Neither the names of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
                    "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl-1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");', "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl-1": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "cddl": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "boost-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "unlicense-free": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "artistic": ["You may distribute under the terms of either the GNU General Public License or the Artistic License, as specified in the README file."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "eupl": ["Licensed under the EUPL, Version 1.2 only (the \"Licence\");"],
    "sspl": ["This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc."],
    "busl": ["Use of this software is governed by the Business Source License included in the LICENSE file."],
    "public-domain": ["This file is in the public domain.", "This code is released into the public domain.", "This work is in the public domain."],
    "apache-title": ["Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gnu-2-date": ["Version 2, June 1991"],
    "gnu-2-1-date": ["Version 2.1, February 1999"],
    "gnu-3-date": ["Version 3, 29 June 2007"],
    "agpl-3-date": ["Version 3, 19 November 2007"],
    "reserved": ["All rights reserved."],
    "confidential": ["This file is proprietary and confidential.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
} | {
    f"cc-{form.lower()}-{version[0]}": [
        *[f"{word} under CC {form} {version}." for word in ("Licensed", "Released")],
        f"This work is licensed under a Creative Commons {name} {version} {place} License.",
    ]
    for form, name in COMMONS.items() for version, place in (("4.0", "International"), ("3.0", "Unported"))
} | {f"named-{name.lower()}": [f"SPDX-License-Identifier: {name}"] for name in NAMED}

#: Ordered sequences of sentence identifiers, the license that each one shows, and the licenses beside which it doesn't count.
RULES = [
    ("0BSD", ["0bsd-grant"], []),
    ("AGPL-3.0", ["agpl-title", "agpl-3-date"], []),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "gpl-implied"], ["AGPL-3.0"]),
    ("Apache-2.0", ["apache-2"], []),
    ("Apache-2.0", ["apache-notice", "apache-may-not"], []),
    ("Apache-2.0", ["apache-title", "apache-terms"], []),
    ("Artistic-or-GPL", ["artistic"], []),
    ("BSD", ["bsd-grant"], ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-3-Clause", "BSD-4-Clause"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], []),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"], []),
    ("BSL-1.0", ["boost"], []),
    ("BSL-1.0", ["boost-grant"], []),
    ("BUSL", ["busl"], []),
    *[(f"CC-{form}-{version}", [f"cc-{form.lower()}-{version[0]}"], []) for form in COMMONS for version in ("4.0", "3.0")],
    ("CC0-1.0", ["cc0"], []),
    ("CDDL", ["cddl"], []),
    ("EPL-1.0", ["epl-1"], []),
    ("EPL-2.0", ["epl-2"], []),
    ("EUPL-1.2", ["eupl"], []),
    ("GFDL-1.3-or-later", ["gfdl-grant"], []),
    ("GPL-2.0-only", ["gpl-2-only"], []),
    ("GPL-2.0", ["gpl-title", "gnu-2-date"], []),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-hope", "gpl-implied"], ["GPL-2.0"]),
    ("GPL-3.0", ["gpl-3"], []),
    ("GPL-3.0", ["gpl-title", "gnu-3-date"], []),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-implied"], ["GPL-3.0"]),
    ("ISC", ["isc-grant"], []),
    ("LGPL-2.1", ["lgpl-title", "gnu-2-1-date"], []),
    ("LGPL-2.1-or-later", ["lgpl-2-free", "lgpl-hope", "gpl-implied"], ["LGPL-2.1"]),
    ("LGPL-2.1-or-later", ["lgpl-2-free", "gpl-hope", "gpl-implied"], ["LGPL-2.1"]),
    ("LGPL-3.0", ["lgpl-title", "gnu-3-date"], []),
    ("LGPL-3.0-or-later", ["lgpl-3-free"], []),
    ("MIT", ["mit"], []),
    ("MIT", ["mit-grant", "mit-notice"], []),
    ("MIT-0", ["mit-0-grant", "mit-warranty"], []),
    ("MPL-1.1", ["mpl-1"], []),
    ("MPL-2.0", ["mpl-2"], []),
    ("OFL-1.1", ["ofl"], []),
    ("Proprietary", ["confidential"], []),
    ("Public-Domain", ["public-domain"], []),
    ("SSPL-1.0", ["sspl"], []),
    ("Unlicense", ["unlicense"], []),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"], []),
    *[(name, [f"named-{name.lower()}"], []) for name in NAMED],
]


def normal(sentence: str) -> str:
    """A known sentence as the scan sees it, with ``SEEN`` for a part that varies."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.replace(HOLE, SEEN).lower()).strip()


def known_sentences() -> dict[str, list[str]]:
    """Identifier and parts, as breaks inside cut it, by normalised sentence."""
    return {normal(s): [name, *(normal(part) for part in re.split(r"(?<=[.!?;])\s", s))] for name, all_ in SENTENCES.items() for s in all_}


def rule_pattern(ids: list[str]) -> str:
    """Where a rule matches in identifiers that commas enclose, with a semicolon for each end of a sentence or paragraph between them."""
    return rf";{{0,{GAP}}}".join(f",{re.escape(i)}," for i in ids)


def _sentence_form(parts: list[str]) -> str:
    """What a known sentence looks like in a marked text: words and line ends, with a name where it varies, in which sentences may seem to end."""
    words = rf"[a-z0-9]+(?:[ \n]\n?[a-z0-9]+){{0,{VARIES - 1}}}?"
    form = "[ \n]\n*".join(part.replace(" ", "[ \n]") for part in parts)
    return form.replace(f"[ \n]{SEEN}[ \n]", rf"[ \n]\n?{words}[ \n]\n?").replace(f"{SEEN}[ \n]", rf"{words}[ \n]\n?").replace(f"[ \n]{SEEN}", rf"[ \n]\n?{words}")


def _ids_of(sentence: Column) -> Column:
    """The identifiers of a found sentence, each enclosed by commas."""
    known = known_sentences()
    lookup = F.create_map(*[F.lit(x) for s, (name, *_) in known.items() if SEEN not in s for x in (s, name)])
    plain = F.regexp_replace(sentence, "[ \n]+", " ")
    varied = [F.when(plain.rlike(f"^{s.replace(SEEN, '[a-z0-9 ]+')}$"), F.lit(name)) for s, (name, *_) in known.items() if SEEN in s]
    one = F.concat(F.lit(","), F.coalesce(F.try_element_at(lookup, plain), *varied, F.lit("")), F.lit(","))
    names = F.create_map(*[F.lit(x) for name in NAMED for x in (normal(name), f",named-{name.lower()},")])
    terms = F.split(F.substring(plain, len(SPDX) + 1, 1 << 20), " (?:or(?! later)|and) ")
    told = F.transform(terms, lambda x: F.coalesce(F.try_element_at(names, F.regexp_replace(x, " with .*$", "")), F.lit("")))
    return F.when(plain.startswith(SPDX), F.array_join(told, "")).otherwise(one)


#: How the line begins in which a file names its licenses, in normal form.
SPDX = "spdx license identifier "


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licenses``, lists joined by commas, and ``n_known`` sentences."""
    known = known_sentences()
    forms = {s: _sentence_form(known[s][1:]) for s in sorted(known, key=len, reverse=True) if not s.startswith(SPDX)}
    any_of = lambda these: rf"(?<![^\n])(?:{'|'.join([*these, SPDX + '[a-z0-9 ]+'])})(?![^\n])"
    every, fixed = any_of(forms.values()), any_of(form for s, form in forms.items() if SEEN not in s)
    # sentences that vary are looked for only where a word is that one of them must have
    words = sorted({max(s.replace(SEEN, "").split(), key=len) for s in forms if SEEN in s})
    whole = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(whole.contains("GPL-"), F.regexp_replace(whole, r"(GPL-[0-9]\.[0-9])\+", "$1-or-later")).otherwise(whole)
    # line ends are single, ends of sentences and paragraphs double
    marked = F.regexp_replace(F.regexp_replace(whole, COMMENT, "\n"), BREAK, "$1\n\n")
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.translate(marked, UPPER, LOWER), OTHER, " "), END, "\n"))
    docs = docs.withColumn("_plain", plain)
    varied = reduce(lambda x, y: x | y, (F.col("_plain").contains(w) for w in words))
    # texts with a known sentence are read once more, for the ends of sentences between them
    read = lambda any_: F.regexp_extract_all("_plain", F.lit(rf"{any_}|\n\n+"), F.lit(0))
    found = F.when(varied, F.when(F.col("_plain").rlike(every), read(every))).when(F.col("_plain").rlike(fixed), read(fixed))
    found = F.coalesce(found, F.array().cast("array<string>"))
    codes = F.transform(found, lambda s: F.when(s.startswith("\n"), F.lit(";")).otherwise(_ids_of(s)))
    out = docs.withColumn("_codes", F.array_join(codes, ""))
    ids = F.filter(F.split("_codes", "[;,]+"), lambda s: s != "")
    named = [(name, F.col("_codes").rlike(rule_pattern(rule)), beside) for name, rule, beside in RULES]
    hits = []
    for name, hit, beside in named:
        for other, its, _ in named:
            hit = hit & ~its if other in beside else hit
        hits.append(F.when(hit, F.lit(name)))
    matched = F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*hits))))
    out = out.withColumns({"sentence_ids": F.array_join(ids, ","), "n_known": F.size(ids).cast("long"), "licenses": F.array_join(matched, ",")})
    return out.drop("_codes", "_plain")
