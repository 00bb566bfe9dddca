import pytest

from hearsay.llm import licenses

WEIGHTS = {t: 2.0 for t in licenses.vocabulary()} | {"": 3.0}
MIT_FILE = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


@pytest.mark.parametrize("text, name", [
    ("Licensed under the MIT License.", "MIT"), ("MIT License", "MIT"), (MIT_FILE, "MIT"), (MIT_FILE[40:], "MIT"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("    Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n", "GPL-3.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("<p>Licensed under <a href='x'>CC BY-NC 4.0</a>.</p>", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", None), ("Licensed under CC BY-SA 4.0.", None),
    ("This work is not licensed under the MIT License.", None), ("mit", None), ("SPDX-License-Identifier: ISC", None),
])
def test_usual_notices(text, name):
    assert licenses.Matcher(WEIGHTS).best(text, licenses.THRESHOLD)[0] == name
