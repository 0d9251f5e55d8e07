"""Licences mentioned in free wording: a list that the mentions in the module were not made from, but for four of its lines
("uses the Apache 2 license", "This module is under the GPL", "code is BSD-licensed", "licensed GPLv2+"), which were known."""

from lumenfold.llm import license_scan

SAID = {
    "MIT": [
        "We ship everything here under an MIT license, so do what you like.",
        "Code: MIT-licensed. Docs: see below.",
        "You may reuse it, it has the MIT licence",
        "The whole thing falls under the terms of the MIT License",
        "license = MIT",
    ],
    "Apache-2.0": [
        "uses the Apache 2 license",
        "Our SDK is available under Apache License 2.0",
        "it's Apache licensed, like most of our tools",
        "Copyright the authors, Apache-2.0",
        "Contributions are accepted under the Apache 2.0 license",
    ],
    "GPL": [
        "This module is under the GPL",
        "licensed GPLv2+",
        "Kernel code, GPL-2.0 only",
        "You can have it under the GPL version 3",
        "published under the GNU GPL",
        "the plugin is GPL licensed",
    ],
    "LGPL": [
        "Linking is fine because we chose the LGPL license",
        "released under LGPLv3",
        "this wrapper is covered by the LGPL",
    ],
    "AGPL": [
        "The server is AGPL-3.0 or later",
        "hosted versions must comply with the AGPL license",
        "licensed under the GNU Affero General Public License",
    ],
    "BSD": [
        "code is BSD-licensed",
        "It carries a BSD-style license",
        "distributed with the 3-clause BSD license",
        "we use the two-clause BSD licence",
    ],
    "MPL-2.0": [
        "Files in this folder are MPL 2.0 licensed",
        "governed by the Mozilla Public License",
    ],
    "ISC": [
        "the package has an ISC license",
    ],
    "EPL": [
        "made available under the Eclipse Public License",
    ],
    "BSL-1.0": [
        "header-only, Boost Software License",
    ],
    "CC-BY-SA": [
        "Text on this page is CC BY-SA 4.0",
        "images are licensed under Creative Commons BY-SA",
    ],
    "CC-BY": [
        "The slides are CC BY 4.0 licensed",
    ],
    "CC-BY-NC": [
        "photos under CC BY-NC 4.0",
    ],
    "CC0": [
        "the data set is released under CC0",
    ],
    "OFL": [
        "The font comes under the SIL Open Font License",
    ],
    "Unlicense": [
        "it is under the Unlicense license",
    ],
    "unknown": [
        "MIT researchers published a new study on batteries.",
        "He drove his Boost scooter under the bridge.",
        "The Apache web server was installed on the old machine.",
        "An eclipse of the sun was seen by many.",
        "You need a driving license to rent a car there.",
        "Mozilla released a new version of the browser.",
        "The general public was invited to the opening.",
        "fishing licence fees went up again",
        "They studied BSD and other systems in the course",
        "The software is compatible with version 3 of the tool.",
        "under the old oak they sat and talked",
        "A boost in sales was covered by the news.",
        "The unix permission bits were changed",
        "Use of the zlib compression library is shown below.",
        "Attribution of the painting is still disputed.",
    ],
}


def test_free_wordings(spark):
    cases = [(family, text) for family, texts in SAID.items() for text in texts]
    rows = [(i, f"Some words stand before it.\n{text}\nAnd some after.") for i, (_, text) in enumerate(cases)]
    out = {r["doc_id"]: r["families"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    named = [i for i, (family, _) in enumerate(cases) if family != "unknown"]
    right = [i for i in named if out[i] == [cases[i][0]]]
    told = [i for i in out if out[i]]
    assert len(right) >= 0.9 * len(named), [cases[i] for i in named if i not in right]
    assert len(right) >= 0.95 * len(told), [(cases[i], out[i]) for i in told if i not in right]


def test_mentions_stand_word_by_word():
    for line, family, found in [("it uses the MIT license", "MIT", True), ("licensed to MIT staff", "MIT", False), ("under the Apache server", "Apache-2.0", False), ("under the Apache 2.0 terms", "Apache-2.0", True), ("GPL-3.0 or later", "GPL", True), ("", "GPL", False)]:
        assert license_scan.mentioned(license_scan._tokens(line), family) == found, line
