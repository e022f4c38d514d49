"""A license is reported only where its own name and version are."""

import pytest

from tidewatch.llm import licenses

CASES = {
    "Released under the BSD License.": [], "The tool was released under the terms of a license.": [], "Licensed under the Apache License, Version 1.1.": [],
    "This work is licensed under the GNU General Public License, version 1.": [], "Licensed under CC BY-NC 3.0.": [], "Licensed under CC BY NC 4.0.": [],
    "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": [],
    "Licensed under CC BY 4.0.": ["CC-BY-4.0/short"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0/line"], "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0/line"],
    "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0/line"], "This work is licensed under the GNU General Public License, version 3.0.": ["GPL-3.0/line"],
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0/line"], "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0/line"],
    "Released under CC0 1.0.": ["CC0-1.0/line"], "We released it all under the MIT License.": ["MIT/line"], "Licensed under Apache License, Version 2.0.": ["Apache-2.0/line"],
}


@pytest.mark.parametrize("text", CASES)
def test_near_misses(text):
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    for t in (text, f"Some words before it. {text} And the license of some words behind it."):
        assert [x[2] for x in scan(t)] == CASES[text]


def test_every_template_is_found_as_itself():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    assert all([(x[2], x[3]) for x in scan(f"a {t} z")] == [(n, 1.0)] for n, t in licenses.TEMPLATES.items())
    assert all(licenses.words_of(k) and f" {' '.join(licenses.words_of(k))} " in f" {' '.join(licenses.words_of(licenses.TEMPLATES[n]))} " for n, ks in licenses.KEYS.items() for k in ks)


MORE = {
    "Released under the MIT License and the Apache License, Version 2.0.": ["MIT/line", "Apache-2.0/line"], "Licensed under the Apache License, Version 2.0, and released under the MIT License.": ["Apache-2.0/line", "MIT/line"],
    "// SPDX-License-Identifier: MIT": ["MIT/spdx"], "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0/spdx"], "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later/spdx"], "MIT License": ["MIT/name"],
    "MIT licensed": ["MIT/licensed"], "Licensed under Apache 2.0": ["Apache-2.0/short"], "GPLv3": ["GPL-3.0/short"], "License: CC BY-SA 4.0": ["CC-BY-SA-4.0/name"], "Apache 2.0 answers on port 80": [], "the license of MIT": [],
    "SPDX-License-Identifier: Nope-1.0": [], "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC": ["MIT/spdx", "ISC/spdx"],
}


@pytest.mark.parametrize("text", MORE)
def test_dual_licenses_tags_and_names(text):
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    for t in (text, f"Some words before it. {text} And some words behind it."):
        assert [x[2] for x in scan(t)] == MORE[text]


def test_ties_and_long_texts():
    scan = licenses.Scanner({"b": "alpha beta", "a": "alpha beta", "c": "gamma"}, 0.8, {}).scan
    assert scan("alpha beta gamma") == [(0, 10, "a", 1.0), (11, 16, "c", 1.0)]
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    long = "word and word " * 100_000 + licenses.TEMPLATES["ISC"] + " more words" * 100_000 + " GPLv3"
    found = scan(long)
    assert [x[2] for x in found] == ["ISC", "GPL-3.0/short"] and long[found[0][0] : found[0][1]] == licenses.TEMPLATES["ISC"].rstrip(".")
