"""Precedence of licence rules, notices of one family, identifier lines, and the SQL over the same texts."""

import pytest

from probewise.llm import licenses
from probewise.llm.catalog import SQL

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
HOPE = """

This %s is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE.  See the GNU %s for more details.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""" + HOPE % ("program", "General Public License")
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""" + HOPE % ("library", "Lesser General Public License")
LGPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""" + HOPE % ("program", "Lesser General Public License")
AGPL = LGPL3.replace("Lesser", "Affero")
KERNEL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
FREE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."

CASES = [
    (BSD, ["BSD-2-Clause"]),
    (BSD + NAME, ["BSD-3-Clause"]),
    (BSD + NAME + "\n" + BSD + NAME, ["BSD-3-Clause"]),
    (BSD + "\n" + BSD + NAME, ["BSD-2-Clause", "BSD-3-Clause"]),
    (NAME + "\n" + BSD, ["BSD-2-Clause"]),
    (GPL2, ["GPL-2.0-or-later"]),
    (GPL2.replace("software;", "software:").replace("Foundation;", "Foundation,"), ["GPL-2.0-or-later"]),
    (LGPL21, ["LGPL-2.1-or-later"]),
    (LGPL3, ["LGPL-3.0-or-later"]),
    (AGPL, ["AGPL-3.0-or-later"]),
    (GPL2 + "\n" + AGPL, ["AGPL-3.0-or-later", "GPL-2.0-or-later"]),
    (KERNEL, ["GPL-2.0-only"]),
    (KERNEL.replace("version 2", "version 4"), []),
    (FREE, ["Unlicense"]),
    ("// SPDX-License-Identifier: MIT\nint main() {}", ["MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier:Apache-2.0\nimport os\n# spdx-license-identifier: BSD-3-Clause", ["Apache-2.0", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: Nothing-1.0\n", []),
    ("The program is licensed, with a warranty of two years; permission is needed.", []),
    (None, []),
    ("", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, text, 7) for i, (text, _) in enumerate(CASES)], "doc_id long, text string, licenses int")


def test_longest_rule_first(docs):
    found = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert [found[i] for i in range(len(CASES))] == [names for _, names in CASES]


def test_every_tagged_identifier(spark):
    rows = [(name, mark % f"SPDX-License-Identifier: {name}") for name in licenses.TAGGED for mark in ("%s", "// %s", "/* %s */", "# %s\ncode")]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect():
        assert r.licenses == [r.name]


def test_sql_covers_what_is_scanned(spark, docs):
    import duckdb
    import pandas as pd

    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame([(i, text) for i, (text, _) in enumerate(CASES)], columns=["doc_id", "text"]))
    expected = {r[0]: r[1:] for r in connection.execute(f"SELECT doc_id, sentence_ids, licenses FROM ({SQL['op8_license_scan']})").fetchall()}
    found = {r.doc_id: (",".join(r.sentence_ids), ",".join(r.licenses)) for r in licenses.scan_licenses(docs).collect()}
    assert found == expected
