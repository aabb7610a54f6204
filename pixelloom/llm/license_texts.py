"""The bundled licence texts besides those of ``license_scan.KNOWN``, in their usual forms.

Long licences are files of ``licenses/``, by SPDX id: with and without title, with and
without the appendix on how to apply them, with https or http addresses and, for the older
GNU licences, with each postal address of the foundation.  Short ones stand here: with each
usual title or none, with and without "All rights reserved.", numbered or not, in the lines
of a width from 60 to 100 or in one.  The widths matter as a line that begins with
"copyright" is left out of the canonical form.  Notices are single sentences.
"""

from __future__ import annotations

import functools
import itertools
import re
import textwrap
from pathlib import Path

WIDTHS = range(60, 101)
RIGHTS = "All rights reserved."
#: Title lines, and where the appendix begins, of the files.
HEADS = {
    "Apache-2.0": (r"\s*Apache License\s+Version 2\.0, January 2004\s+http\S+\s+", r"\n\s*APPENDIX: How to apply"),
    "Artistic-1.0-Perl": (r"\s*The \"Artistic License\"\s+", None),
    "CC0-1.0": (r"\s*Creative Commons Legal Code\s+", None),
    "MPL-1.1": (r"\s*MOZILLA PUBLIC LICENSE\s+Version 1\.1\s+-+\s+", r"\nEXHIBIT A -"),
    "MPL-2.0": (r"\s*Mozilla Public License Version 2\.0\s+=+\s+", r"\nExhibit A - "),
}
GNU = (r"(?i)\s*GNU [A-Za-z ]+LICENSE\s+Version [\d.]+, [\w ]+\n\s*", r"(?i)\n\s*(?:ADDENDUM: |APPENDIX: )?How to (?:apply these terms|use this license)")
ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA +02110-1301,? +USA")
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]

MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "#Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "#Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE {0}S AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {1} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
HOLDERS = BSD_END.format("COPYRIGHT HOLDER", "COPYRIGHT HOLDER")
NEITHER = "#Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: id, titles, paragraphs; # marks an item of a list.
SHORT = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], MIT),
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], [MIT[0], MIT[1].replace("notice shall", "notice (including the next paragraph) shall"), MIT[2]]),
    ("ISC", ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"], [f"{GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", ISC_END]),
    ("ISC", ["ISC License", "The ISC License"], [f"{GRANT}, provided that the above copyright notice and this permission notice appear in all copies.".replace("and/or", "and"), ISC_END]),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause", "BSD 0-Clause License", "BSD Zero Clause License (0BSD)"], [f"{GRANT}.", ISC_END]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"], [*BSD, HOLDERS]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"], [*BSD, NEITHER.format("copyright holder"), HOLDERS]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "BSD License"], [*BSD, NEITHER.format("University"), BSD_END.format("REGENT", "REGENTS")]),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"], [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]),
    ("Zlib", ["zlib License", "The zlib License", "zlib/libpng license"], [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "#The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "#Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "#This notice may not be removed or altered from any source distribution."]),
    ("Unlicense", ["The Unlicense", "Unlicense"], [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "For more information, please refer to <https://unlicense.org>"]),
]

#: Names of licences in notices.
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License, Version 1.0"], "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    **{f"{kind}-{v}.0-only".replace("2.1.0", "2.1"): [f"GNU {name}, version {v}", f"GNU {name} v{v}", f"GNU {name} version {v}.0" if v != "2.1" else f"GNU {name} 2.1"]
       for kind, name, versions in (("GPL", "General Public License", "2 3"), ("LGPL", "Lesser General Public License", "2.1 3"), ("AGPL", "Affero General Public License", "3")) for v in versions.split()},
    **{f"CC-{k.upper()}-4.0": [f"CC {k.upper()} 4.0", f"CC-{k.upper()}-4.0 License", f"Creative Commons {name} 4.0 International License", f"Creative Commons {name} 4.0 License"]
       for k, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))},
}
SAID = ["Licensed under", "Released under", "Distributed under", *[f"This {x} is {y} under" for x in ("work", "project", "software", "file", "document", "code") for y in ("licensed", "released", "distributed")]]
LINES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def short_forms(titles, paragraphs):
    """The text with and without title and reservation, in every layout; only what differs in words."""
    bodies = {}
    for first, rest in (("1. ", "   "), ("  1. ", "     "), ("* ", "  "), ("  * ", "    "), ("1. ", "")) if any(p[0] == "#" for p in paragraphs) else (("", ""),):
        for width in [*WIDTHS, 1 << 20]:
            lines, k = [], 0
            for p in paragraphs:
                k += p[0] == "#"
                lines.append(textwrap.fill(p[1:], width, initial_indent=first.replace("1", str(k)), subsequent_indent=rest) if p[0] == "#" else textwrap.fill(p, width))
            body = "\n\n".join(lines)
            bodies.setdefault(" ".join(re.findall(r"\w+", re.sub(r"(?mi)^[ *]*copyright\b.*$", "", body))), body)
    return [f"{title}\n\n{rights}\n\n{body}" for title, rights, body in itertools.product(["", *titles], ["", RIGHTS], bodies.values())]


def long_forms(license_id, text):
    head, tail = HEADS.get(license_id, GNU)
    out = [text]
    if m := tail and re.search(tail, text):
        out.append(text[: m.start()])
    out += [t[re.match(head, t).end() :] for t in out]
    if ADDRESS.search(text):
        out = [ADDRESS.sub(a, t) for t in out for a in ADDRESSES] + out
    return list(dict.fromkeys(u for t in out for u in (t, t.replace("http://", "https://"), t.replace("https://", "http://"))))


@functools.cache
def texts() -> list[tuple[str, str]]:
    out = [(f.stem, t) for f in sorted(Path(__file__).with_name("licenses").glob("*.txt")) for t in long_forms(f.stem, f.read_text())]
    out += [(i, t) for i, titles, paragraphs in SHORT for t in short_forms(titles, paragraphs)]
    out += [(i, f"{how} {the}{name}.") for i, names in NAMES.items() for name in names for how in SAID for the in ("", "the ", "a " if i.startswith("CC") else "the ")]
    out += [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys([*NAMES, *[i for i, _ in out]])]
    return list(dict.fromkeys(out + LINES))
