"""Licence notices that are wrapped over lines."""

import textwrap

import pytest

from driftwatch.llm import licenses

GPL = " ".join(licenses.SENTENCES[x][0] for x in ("gpl-free", "gpl-hope", "gpl-implied"))
MIT = [licenses.SENTENCES[x][0] for x in ("mit-grant", "mit-notice")]


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", ";; "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_notices(frame, sign, end):
    def wrapped(*paragraphs):
        lines = [line for p in paragraphs for line in [*textwrap.wrap(p, 70), ""]]
        return end.join(["code = 1", *(sign + line for line in ["Copyright (c) 2020 Somebody", *lines]), "more()"])

    rows = [(1, wrapped(GPL)), (2, wrapped(*MIT)), (3, wrapped(*[licenses.SENTENCES["apache-notice"][0] + " " + licenses.SENTENCES["apache-may-not"][0]])),
            (4, "Licensed under the MIT\n\nLicense."), (5, "It is not Licensed under\nthe MIT License."), (6, "SPDX-License-Identifier: MIT\nx")]
    got = {r["doc_id"]: (r["licenses"], r["n_known"]) for r in licenses.scan(frame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("GPL-3.0-or-later", 3), 2: ("MIT", 2), 3: ("Apache-2.0", 2), 4: ("", 0), 5: ("", 0), 6: ("MIT", 1)}


def wrapped(paragraphs, sign=" * "):
    return "\n".join(sign + line for p in paragraphs for line in [*textwrap.wrap(p, 70), ""])


def test_versions_and_families_are_told_apart(frame):
    said = lambda *names: [licenses.SENTENCES[n][0] for n in names]
    bsd = said("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")
    rows = {
        "MPL-1.1": [licenses.SENTENCES["mpl-1"][1]],
        "MPL-2.0": [" ".join(said("mpl-2", "mpl-2-copy"))],
        "BSD-3-Clause": [bsd[0], *(f"{i}. {s}" for i, s in enumerate(bsd[1:], 1))],
        "BSD-2-Clause": bsd[:3],
        "BSD": bsd[:1],
        "GPL-2.0-or-later": [" ".join(said("gpl-2-free", "gpl-hope", "gpl-implied"))],
        "GPL-2.0-only": said("gpl-2-only"),
        "LGPL-2.1-or-later": said("lgpl-2-free") + [" ".join(said("lgpl-hope", "gpl-implied"))],
        "AGPL-3.0-or-later": said("agpl-free") + [" ".join(said("gpl-hope", "gpl-implied"))],
        "MIT-0": said("mit-0-grant", "mit-warranty"),
        "ISC": said("isc-grant"), "0BSD": said("0bsd-grant"), "Unlicense": said("unlicense"), "CC-BY-NC-ND-3.0": [licenses.SENTENCES["cc-by-nc-nd-3"][2]],
        "Zlib": said("zlib-as-is", "zlib-liable", "zlib-grant"), "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0"],
    }
    assert len(licenses.SENTENCES) >= 60
    names = [*rows]
    docs = frame([(i, wrapped(rows[n])) for i, n in enumerate(names)], "doc_id long, text string")
    assert {names[r["doc_id"]]: r["licenses"] for r in licenses.scan(docs).collect()} == {n: n for n in names}


BSD = """Copyright 2008, {holder}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
NEITHER = """    * Neither the name of {holder} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
FREE = """{name} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {n} of the License, or
(at your option) any later version.

{name} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def commented(text, sign="// "):
    return "\n".join((sign + line).rstrip() for line in text.split("\n"))


#: Headers as files have them, and the licenses that they show.
HEADERS = [
    (commented(BSD.format(holder="Google Inc.", more=NEITHER.format(holder="Google Inc."))), "BSD-3-Clause"),
    (commented(BSD.format(holder="The Regents", more=NEITHER.format(holder="the University of Somewhere, Berkeley")), " * "), "BSD-3-Clause"),
    (BSD.format(holder="Jane Doe <jane@doe.org>", more=""), "BSD-2-Clause"),
    (commented(BSD.format(holder="NumPy Developers.", more=NEITHER.format(holder="the NumPy Developers")), "# "), "BSD-3-Clause"),
    (BSD.format(holder="A. Uthor", more="* The name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission."), "BSD-3-Clause"),
    (FREE.format(name="Foo", a=":", b=",", n=3, kind=""), "GPL-3.0-or-later"),
    (commented(FREE.format(name="GNU Emacs", a=":", b=",", n=3, kind=""), ";; "), "GPL-3.0-or-later"),
    (commented(FREE.format(name="The Frob Toolkit", a=";", b=";", n=2, kind=""), " * "), "GPL-2.0-or-later"),
    (FREE.format(name="Bar", a=":", b=",", n=3, kind="Affero "), "AGPL-3.0-or-later"),
    (FREE.format(name="libbaz", a=";", b=";", n="2.1", kind="Lesser "), "LGPL-2.1-or-later"),
    (FREE.format(name="libbaz", a=":", b=",", n="3", kind="Lesser "), "LGPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;", "Apache-2.0,MIT"),
    ("// SPDX-License-Identifier: GPL-2.0\n", "GPL-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: (LGPL-2.1-or-later AND BSD-3-Clause)\n", "BSD-3-Clause,LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0\n", "GPL-2.0-only,MPL-2.0"),
    ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", "CC-BY-SA-4.0"),
    ("# SPDX-License-Identifier: LicenseRef-Own", ""),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n"
     "   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0"),
    (commented('Licensed to the Apache Software Foundation (ASF) under one or more\ncontributor license agreements.  The ASF licenses this file to You under the Apache License, Version 2.0\n'
               '(the "License"); you may not use this file except in compliance with\nthe License.  You may obtain a copy of the License at\n', "# "), "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n" + FREE.format(name="This program", a=":", b=",", n=3, kind=""), "GPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "AGPL-3.0"),
    ("The night was long, and nobody spoke of it again. The end.\n\nCopyright 1999 by the author. All rights reserved.\n", ""),
    ("Emacs is free software that anybody may copy. It is distributed in the hope that it will be useful.", ""),
    ("This file is proprietary and confidential.\n", "Proprietary"),
]


def test_headers_of_files(frame):
    docs = frame([(i, text) for i, (text, _) in enumerate(HEADERS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: got[i]["licenses"] for i in got} == {i: want for i, (_, want) in enumerate(HEADERS)}
    assert got[11]["sentence_ids"] == "named-mit,named-apache-2.0" and got[11]["n_known"] == 2


def test_gaps_are_bounded(frame):
    one, two = (licenses.SENTENCES[n][0] for n in ("apache-notice", "apache-may-not"))
    rows = [(n, " ".join([one, *["Something else."] * n, two])) for n in (0, 7, 8, 500)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "Apache-2.0", 7: "Apache-2.0", 8: "", 500: ""}


def test_tables_of_any_kind(frame):
    rows = [(1, None, 5), (2, "", 6), (3, MIT[0] + "\n" + MIT[1], 7), (3, MIT[0] + "\n" + MIT[1], 7)]
    got = licenses.scan(frame(rows, "doc_id long, text string, licenses int"))
    assert got.columns == ["doc_id", "text", "licenses", "sentence_ids", "n_known"]
    assert sorted((r["doc_id"], r["licenses"]) for r in got.collect()) == [(1, ""), (2, ""), (3, "MIT"), (3, "MIT")]
    assert licenses.scan(frame([], "doc_id long, text string")).count() == 0
