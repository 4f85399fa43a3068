"""Short notices and tags of licences, each with what it says, and what says nothing."""

import duckdb

from loomline.llm import licenses

NOTICES = [
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note)", "GPL-2.0"),
    ("SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause", "BSD-3-Clause,GPL-2.0"),
    ("SPDX-License-Identifier: (MIT AND BSD-2-Clause) OR (ISC AND Zlib)\nint main;", "BSD-2-Clause,ISC,MIT,Zlib"),
    ("SPDX-License-Identifier: LGPL-2.1-only AND LGPL-3.0+", "LGPL-2.1-only,LGPL-3.0-or-later"),
    ("SPDX-License-Identifier: CC-BY-SA-3.0", "CC-BY-SA-3.0"),
    ("Distributed under the terms of the MIT License", "MIT"),
    ("Licensed under the MIT License (see LICENSE)", "MIT"),
    ("Licensed under MIT", "MIT"),
    ("Licensed under GPLv3.", "GPL-3.0"),
    ("License: MIT", "MIT"),
    ("# License: Apache-2.0\nimport os", "Apache-2.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("This document is licensed under CC BY-ND 2.5.", "CC-BY-ND-2.5"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ""),
    ("This font is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Released under the terms of the\n * Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("This library is available under the Eclipse Public License v1.0", "EPL-1.0"),
    ("Published under the European Union Public Licence 1.2", "EUPL-1.2"),
    ("This program is made available under the Common Development and Distribution License 1.0", "CDDL-1.0"),
    ("Provided under the LaTeX Project Public License, version 1.3c", "LPPL-1.3c"),
    ("This file is licensed under the Microsoft Public License (Ms-PL)", "MS-PL"),
    ("Licensed under the Python Software Foundation License", "PSF-2.0"),
    ("This documentation is licensed under the GNU Free Documentation License, Version 1.3", "GFDL-1.3"),
    ("This code is not licensed under the MIT License", ""),
    ("Licensed under neither MIT nor GPLv3", ""),
    ("SPDX-License-Identifier: LicenseRef-own WITH MIT", ""),
    ("Licensed under the MIT License of the other kind", ""),
    ("License: see LICENSE", ""),
    ("The licence of the MIT library is unclear", ""),
]


def test_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.recognise(docs).collect()}
    assert [(t, got[i].licences) for i, (t, _) in enumerate(NOTICES)] == NOTICES
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(licenses.sql()).fetchall()) == sorted(tuple(r) for r in got.values())


def test_a_licence_a_name():
    """No two licences share a notice."""
    by_text = {}
    for licence, names in licenses.all_names().items():
        for n in names:
            by_text.setdefault(licenses.normal(f"Licensed under {n}"), set()).add(licence)
    assert all(len(v) == 1 for v in by_text.values()) and len(licenses.all_names()) > 75
