"""Licence scans and their SQL on published notices and common statements of use."""


import duckdb
import pytest

from siftline.llm import licenses

from .test_operators import NOTICES

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
{}. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
{}. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED."""
NAMES = """{}. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
STATEMENTS = [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License. To view a copy, visit x.", "CC-BY-SA-3.0"),
    ("This page is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 2.0 Generic License", "CC-BY-NC-ND-2.0"),
    ("licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("SPDX-License-Identifier: MIT OR X", ""),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", ""),
    ("## License\n\nThis project is licensed under the MIT License - see the LICENSE.md file for details", "MIT"),
    ("Distributed under the MIT license.", "MIT"),
    ("Distributed under the MIT License. See LICENSE for more information.", "MIT"),
    ("This software is released under the Apache License 2.0.", "Apache-2.0"),
    ("This library is made available under the terms of the BSD 3-Clause License.", "BSD-3-Clause"),
    ("The code is under the MIT licence, we think", ""),
    ("It is not licensed under the MIT License, but see the file.", ""),
    (BSD.format("1", "2", NAMES.format("3")), "BSD-3-Clause"),
    (BSD.format("(a)", "(b)", ""), "BSD-2-Clause"),
    (BSD.format("a", "b", NAMES.format("c")).replace("a. Red", "a) Red").replace("b. Red", "b) Red").replace("c. Nei", "c) Nei"), "BSD-3-Clause"),
    ("", ""), (" \n\n \n", ""), ("x", ""),
]


def cases():
    marks = ["", "# ", " * ", "// "]
    dressed = ["\n".join((m + line).rstrip() for line in f"Copyright 2020 A. Person\n\n{t}\n\nimport x".split("\n")) for m in marks for _, t in NOTICES]
    two = [a + "\n\n" + b for (_, a), (_, b) in zip(NOTICES, NOTICES[1:])]
    return [t for _, t in NOTICES] + dressed + two + [t for t, _ in STATEMENTS] + [None]


@pytest.mark.parametrize("text,licence", STATEMENTS)
def test_statements_are_as_expected(text, licence):
    assert licence == "" or licence in {x for x, _ in licenses.RULES}


def test_statements(spark):
    got = {r.doc_id: ",".join(r.licences) for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATEMENTS)], "doc_id long, text string")).collect()}
    wrong = [(STATEMENTS[i][0][:80], STATEMENTS[i][1], got[i]) for i in got if got[i] != STATEMENTS[i][1]]
    assert not wrong


def test_sql_is_the_query(spark):
    rows = list(enumerate(cases()))
    want = {r.doc_id: (len(r.sentence_ids), ",".join(r.licences)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE notices (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO notices VALUES (?, ?)", rows)
    got = {i: (n, licences) for i, n, licences in duck.execute(licenses.scan_sql("notices")).fetchall()}
    assert got == want
    assert sum(bool(x) for _, x in want.values()) > 100
