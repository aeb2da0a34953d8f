"""Licence lines as documents have them, not made from TEMPLATES."""

import re

from lakesift.llm import license_scan

LINES = {
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
    "Released under the MIT License.": {"MIT-notice"},
    "Licensed under the Apache License, Version 2.0.": {"Apache-2.0"},
    "Photos: CC-BY-SA 3.0, text CC BY 4.0": {"CC-BY-SA-3.0", "CC-BY-4.0"},
    "SPDX-License-Identifier: CC-BY-NC-ND-4.0": {"CC-BY-NC-ND-4.0"},
    "All figures are CC BY-NC-SA.": {"CC-BY-NC-SA"},
    "cc by": {"CC-BY"},
    "Data under CC0, maps under CC0 1.0": {"CC0", "CC0-1.0"},
    "// SPDX-License-Identifier: MIT": {"MIT-id"},
    "# SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0-id"},
    "SPDX-License-Identifier: (Apache-2.0 OR BSD-3-Clause)": {"Apache-2.0-id", "BSD-3-Clause-id"},
    "cc: by mail, nc 17": {"CC-BY"},
    "sent by post": set(),
}


def test_licence_lines(spark):
    rows = [(k, f"Some text before.\n{x}\nAnd after it.") for k, x in enumerate(LINES)]
    got = {k: set() for k, _ in rows}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert [got[k] for k, _ in rows] == list(LINES.values())


def test_each_licence_line_of_the_documents_has_a_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with_line = {r.doc_id for r in docs.collect() if re.search(r"(?im)^.*\b(licensed|released) under .*$", r.text or "")}
    assert with_line and with_line <= {r.doc_id for r in license_scan.scan(docs).collect()}


def test_unversioned_counts_with_its_full_name(spark):
    df = spark.createDataFrame([(1, "cc by x creative commons attribution x cc by 4.0 x cc by nc")], "doc_id long, text string")
    got = {r.license: (r.first_token, r.n_places) for r in license_scan.scan(df).collect()}
    assert got == {"CC-BY": (0, 2), "CC-BY-4.0": (7, 1), "CC-BY-NC": (12, 1)}
