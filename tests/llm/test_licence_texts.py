"""Licence files and headers as they are found in projects."""

import os

from tilewright.llm import license_scan as ls

GPL2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
code
"""
BSD = "Copyright (c) 2011, Some People\nAll rights reserved.\n\n" + ls._BSD.replace("following conditions are met:", "following\nconditions are met:\n\n* ") + "\n* " + ls._BSD_NAMES + "\n\n" + ls._BSD_END
ISC = "ISC License\n\nCopyright (c) 2020 Somebody\n\n" + dict(ls.BODIES)["ISC"].replace(". ", ".\n\n")


def test_real_texts(spark):
    files = [
        ("a/LICENSE", BSD, "BSD-3-Clause"), ("b/x.py", GPL2, "GPL-2.0"), ("b/y.py", GPL2.replace("version 2", "version 3"), "GPL-3.0"), ("c/LICENSE", ISC, "ISC"),
        ("d/x.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("d/y.c", "/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("d/z.c", "# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("e/x.md", "Released under CC BY 4.0.", "CC-BY-4.0"), ("f/LICENSE", "All rights reserved.", "Proprietary"), ("h/x.c", "// Copyright 2020 Somebody. All rights reserved.\n// SPDX-License-Identifier: ISC\n", "ISC"), ("h/y.md", "Released under CC0 1.0 Universal, dedicated to the public domain.", "CC0-1.0"), ("a/z.py", "nothing", "BSD-3-Clause"), ("g/x.c", "// SPDX-License-Identifier: Unheard-1.0", None),
    ]
    for path, want in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")):
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            files.append((f"whole/{path}/COPYING", open(f"/usr/share/common-licenses/{path}").read(), want))
    df = spark.createDataFrame([f[:2] for f in files], "path string, text string")
    got = {r.path: (r.licence, r.score) for r in ls.scan(df, spark.createDataFrame(ls.TEMPLATES, "licence string, text string")).collect()}
    assert {p: got[p] for p, _, w in files if got[p][0] != w} == {}
