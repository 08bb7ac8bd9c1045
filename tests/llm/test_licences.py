"""Licence texts as they stand in files: wrapped, commented, on one line, several in a row."""

import textwrap

import duckdb
import pytest

from codegraph.llm import licences

DOC = "doc_id long, text string"
MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""


def wrapped(text, mark=""):
    parts = [textwrap.wrap(p, 78 - len(mark)) for p in text.split("\n\n")]
    return "\n".join(f"{mark}{x}".rstrip() for i, p in enumerate(parts) for x in ([""] if i else []) + p)


GOOGLE = BSD3.replace("the copyright holder nor", "Google Inc. nor")
ISC = """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."""
NAMED = """Foo Tools is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
CASES = [
    (30, wrapped(GOOGLE, " * "), "BSD-3-Clause"), (31, BSD3.replace("the copyright holder", "the University of X, Y & Z"), "BSD-3-Clause"), (32, BSD2 + "\n\n3. The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"), (33, wrapped(ISC, "// "), "ISC"), (34, ISC.split("\n")[0], "ISC"),
    (35, wrapped(GPL2, "# "), "GPL-2.0-only"), (36, GPL2.replace("License as", "License version 2 as").replace("; version 2 of the License", ""), "GPL-2.0-only"), (37, wrapped(NAMED), "GPL-3.0-or-later"), (38, wrapped(LGPL.replace("This library", "This file")), "LGPL-2.1-or-later"), (39, GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of"), "LGPL-2.1-only"),
    (40, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS BE", "ACME INC. BE"), "MIT"), (41, "Neither the name of the rose nor the names of its readers matter.", None), (42, "Made by Foo Co. Licensed under the ISC License.", "ISC"),
    (1, MIT, "MIT"), (2, wrapped(MIT), "MIT"), (3, "/*\n" + wrapped(MIT, " * ") + "\n */\nint main() {}", "MIT"), (4, MIT.split("\n\n", 2)[2].replace("\n", " "), "MIT"), (5, wrapped(MIT, "# ").replace("\n", "\r\n"), "MIT"),
    (6, wrapped(BSD2), "BSD-2-Clause"), (7, wrapped(BSD3, "// "), "BSD-3-Clause"), (8, BSD2 + "\n\n" + BSD3, "BSD-2-Clause AND BSD-3-Clause"), (9, BSD3 + "\n\n" + wrapped(BSD2), "BSD-3-Clause AND BSD-2-Clause"),
    (10, "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "MIT OR Apache-2.0"), (11, "# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)  AND MIT */", "(GPL-2.0-only WITH Classpath-exception-2.0) AND MIT"), (12, "SPDX-License-Identifier: MIT is the tag", "MIT"),
    (13, wrapped(LGPL), "LGPL-2.1-or-later"), (14, "Text before.\nReleased under the MIT License.\nMore text", "MIT"), (15, "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 3.", "Apache-2.0 AND GPL-3.0"),
    (16, "I have a license to drive and permission to go. It is not the MIT License, or is it?", None), (17, None, None), (18, "", None), (19, "word " * 200000 + "\nSPDX-License-Identifier: MIT\n", "MIT"), (20, "LICENSED UNDER CC BY-NC 4.0!", "CC-BY-NC-4.0"),
    (21, wrapped(APACHE, "# "), "Apache-2.0"), (22, wrapped(MIT) + "\n\n" + wrapped(LGPL) + "\nSPDX-License-Identifier: MIT OR ISC", "MIT AND LGPL-2.1-or-later AND (MIT OR ISC)"), (23, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright", "GPL-3.0"),
    (24, BSD2.replace("1. ", "").split("\n\n")[1] + "\n" + BSD2.split("\n\n")[0], None), (1, "Zlib License", "Zlib"), (None, "Released under the MIT License.", "MIT"),
]


def test_licences(spark):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in CASES], "doc_id long, text string, licence string, tags string")
    got = licences.scan(rows).collect()
    assert sorted(((r.doc_id, r.licence) for r in got), key=str) == sorted(((i, w) for i, _, w in CASES), key=str)
    ids = {r.doc_id: r.sentence_ids for r in got}
    assert ids[2] == ["mit_name", *ids[4]] == ["mit_name", "mit_grant", "mit_notice", "as_is", "mit_liable"]
    assert ids[17] is None and ids[18] == []
    assert licences.scan(spark.createDataFrame([], DOC)).count() == 0


def test_the_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in CASES])
    want = sorted(con.execute(f"SELECT doc_id, sentence_ids, licence FROM ({licences.oracle_sql()})").fetchall(), key=str)
    rows = licences.scan(spark.createDataFrame([(i, t) for i, t, _ in CASES], DOC)).collect()
    assert sorted(((r.doc_id, None if r.sentence_ids is None else " ".join(r.sentence_ids), r.licence) for r in rows), key=str) == want


@pytest.mark.parametrize("name, rule", [(n, r) for n, r in licences.RULES])
def test_every_rule_is_reached(name, rule):
    assert all(i in licences.SENTENCES for i in rule)
    patterns = licences._patterns(licences.SENTENCES, licences.RULES)
    assert len(set(patterns)) == len(patterns)
