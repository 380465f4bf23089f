"""Templates of the licence scan: wordings of notices, opening statements and whole texts, by licence.

Names are SPDX identifiers with the version (``GPL-2.0``, ``GPL-3.0``; "only" and "or later" are not told apart), or a
family's name (``GPL``, ``BSD``, ...) where a notice gives no version. The text files are the licences' own; they are
read on the driver only.
"""

from __future__ import annotations

from functools import cache
from importlib import resources
from typing import NamedTuple


class Wording(NamedTuple):
    """A text of a licence; a match of it has to hold one phrase of every group of ``need`` (alternatives split by ``|``)."""

    text: str
    need: tuple[str, ...] = ()


_V = ("version {0}", "v{0}", "v. {0}", "{0}")


def _versions(names: tuple[str, ...], version: str) -> list[str]:
    """Every name with the version as notices write it, whole versions also without ``.0``."""
    numbers = {version, version.removesuffix(".0")}
    return [f"{n} {v.format(x)}" for n in names for v in _V for x in sorted(numbers)]


def _gnu(kinds: tuple[str, ...], short: str, version: str) -> list[str]:
    full = tuple(f"GNU {k} General Public License".replace("  ", " ") for k in kinds)
    least = version.removesuffix(".0")
    return [
        *_versions((*full, f"GNU {short}", short), version), *[f"{f.removeprefix('GNU ')} version {least}" for f in full],
        *[f"{f} ({short}) {v.format(x)}" for f in full for v in _V for x in sorted({version, least})],
        *[f"version {x} of the {f}" for f in (*full, f"GNU {short}", short) for x in sorted({version, least})],
        *[f"{g}{short}{v}{x}" for g in ("", "GNU ") for v in ("v", "-", "-v") for x in sorted({version, least})],
        *[f"{short}-{version}-{e}" for e in ("only", "or-later")], *[f"{short}{v}{x}+" for v in ("v", "-") for x in sorted({version, least})]]


def _cc(code: str, long: str, version: str) -> list[str]:
    terms = [f"CC {code} {version}", f"CC-{code}-{version}", f"CC {code}-{version}", f"CC-{code} {version}"]
    for l in {long, long.replace("-", " ")}:  # noqa: E741
        terms += [f"Creative Commons {l} {version}", f"Creative Commons {l} {version} International", f"Creative Commons {l} {version} International License",
                  f"Creative Commons {l} {version} License", f"Creative Commons {l} License version {version}", f"Creative Commons {l} {version} Unported License"]
    return terms


#: Names under which one-line notices speak of a licence.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": [*_versions(("Apache License", "Apache Software License", "Apache Public License"), "2.0"), "Apache 2.0", "Apache 2", "Apache-2.0",
                   "Apache 2.0 License", "Apache 2 License", "Apache-2.0 License", "Apache v2", "Apache v2 License", "Apache v2.0 License", "ASL 2.0"],
    "Apache-1.1": [*_versions(("Apache License", "Apache Software License"), "1.1"), "Apache-1.1"],
    "Apache": ["Apache License", "Apache Software License"],
    "MIT": ["MIT License", "MIT/X11 License", "X11/MIT License", "MIT (Expat) License", "Expat License", "MIT open source License"],
    "MIT-0": ["MIT-0", "MIT No Attribution License", "MIT-0 License"],
    "ISC": ["ISC License", "Internet Systems Consortium License"],
    "0BSD": ["0BSD", "0BSD License", "Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "BSD-2-Clause License", "2-Clause BSD License", "two-clause BSD License", "Simplified BSD License",
                     "FreeBSD License", "BSD 2 Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "BSD-3-Clause License", "3-Clause BSD License", "three-clause BSD License", "New BSD License",
                     "Modified BSD License", "Revised BSD License", "BSD 3 Clause License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "BSD-4-Clause", "4-Clause BSD License", "four-clause BSD License", "Original BSD License"],
    "BSD": ["BSD License", "BSD-style License", "BSD style License"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL License", "GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL License", "LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPL License", "AGPL"],
    **{f"GPL-{v}": _gnu(("",), "GPL", v) for v in ("1.0", "2.0", "3.0")},
    "LGPL-2.0": _gnu(("Library", "Lesser"), "LGPL", "2.0"),
    "LGPL-2.1": _gnu(("Lesser", "Library"), "LGPL", "2.1"),
    "LGPL-3.0": _gnu(("Lesser",), "LGPL", "3.0"),
    "AGPL-3.0": [*_gnu(("Affero",), "AGPL", "3.0"), *_versions(("Affero General Public License", "GNU Affero GPL", "Affero GPL"), "3.0")],
    "GFDL": ["GNU Free Documentation License", "GFDL"],
    **{f"GFDL-{v}": [*_versions(("GNU Free Documentation License", "GFDL"), v), f"GFDL-{v}"] for v in ("1.1", "1.2", "1.3")},
    **{f"MPL-{v}": [*_versions(("Mozilla Public License", "Mozilla Public License (MPL)", "MPL"), v), f"MPL-{v}"] for v in ("1.1", "2.0")},
    "MPL": ["Mozilla Public License"],
    **{f"EPL-{v}": [*_versions(("Eclipse Public License", "Eclipse Public License (EPL)", "EPL"), v), f"EPL-{v}", f"Eclipse Public License - v {v}"] for v in ("1.0", "2.0")},
    "EPL": ["Eclipse Public License"],
    **{f"CDDL-{v}": [*_versions(("Common Development and Distribution License", "CDDL"), v), f"CDDL-{v}"] for v in ("1.0", "1.1")},
    **{f"EUPL-{v}": [*_versions(("European Union Public License", "European Union Public Licence", "EUPL"), v), f"EUPL-{v}"] for v in ("1.1", "1.2")},
    "Artistic-1.0": [*_versions(("Artistic License",), "1.0"), "Artistic-1.0"],
    "Artistic-2.0": [*_versions(("Artistic License",), "2.0"), "Artistic-2.0"],
    "BSL-1.0": [*_versions(("Boost Software License",), "1.0"), "BSL-1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0", "Creative Commons Zero v1.0 Universal", "CC0 License",
                "Creative Commons CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal License"],
    **{f"CC-{code}-{v}": _cc(code, long, v) for v in ("3.0", "4.0") for code, long in {
        "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()},
}
#: What stands before a name in a notice, whatever the verb; the last one is for identifiers.
CARRIERS = ("under {}", "under the {}", "under a {}", "terms of the {}", "terms of {}", "governed by the {}", "covered by the {}", "SPDX-License-Identifier: {}")

_NOTICE = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, "
           "either version {2} of the License, or (at your option) any later version.")
_WARRANTY = (" This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
             "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
          "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
          "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
          "THE SOFTWARE.")
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
          "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
          "sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (" THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
              "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
              "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
              "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_12 = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
           "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
           "provided with the distribution.")
_BSD_AD = (" 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software "
           "developed by the organization.")
_BSD_NAME = (" {0}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
             "without specific prior written permission.")
_BSD_AS_IS = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
              "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
              "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
              "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
              "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
              "POSSIBILITY OF SUCH DAMAGE.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
              "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")
_UNLICENSE_REST = (" In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
                   "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
                   "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. ")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
         "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
         "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
         "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
         "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
         "not be removed or altered from any source distribution.")
_BOOST = ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
          "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
          "Software, and to permit third-parties to whom the Software is furnished to do so")
_WTFPL = ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.")
_EPL_1 = ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
          "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html")
_EPL_2 = ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
          "https://www.eclipse.org/legal/epl-2.0/")
_MPL_11 = ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with "
           "the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/")
_CC0 = ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")
_GFDL = ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {0} or any later version "
         "published by the Free Software Foundation")
#: Section 13 of the AGPL; with it and its own name, the text is that of the GPL 3 (which its preamble differs from as well).
_AGPL_13 = ("13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, "
            "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such "
            "interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server "
            "at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding "
            "Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding "
            "any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General "
            "Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is "
            "the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.\n")

#: What a whole text has to hold where another text shares most of it.
_WHOLE_NEED = {
    "GPL-3.0": ("use with the GNU Affero General Public License",), "AGPL-3.0": ("remote network interaction",),
    "LGPL-2.0": ("GNU Library General Public License",), "LGPL-2.1": ("GNU Lesser General Public License",),
    "GFDL-1.3": ("Massive Multiauthor Collaboration",),
}


def _file(name: str) -> str:
    return resources.files(__name__).joinpath(f"{name}.txt").read_text("utf-8", "replace")


def _whole() -> dict[str, str]:
    names = ("Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
    out = {n: _file(n) for n in names} | {"Artistic-1.0-Perl": _file("Artistic-1.0-Perl")}
    gpl = out["GPL-3.0"]
    body, after = gpl.index("TERMS AND CONDITIONS"), gpl.index("14. Revised Versions")
    out["AGPL-3.0"] = gpl[body : gpl.index("13. Use with the GNU Affero")] + _AGPL_13 + gpl[after : gpl.index("END OF TERMS")].replace(
        "GNU General Public", "GNU Affero General Public")
    return out


def _statements() -> list[tuple[str, Wording]]:
    """Opening statements, customary notices and the short licences' whole texts."""
    out = [(n, Wording(t)) for n, t in (
        ("MIT-0", f"{_GRANT}. {_AS_IS}"), ("0BSD", f"{_ISC}.{_ISC_AS_IS}"), ("BSD-2-Clause", _BSD + _BSD_12 + _BSD_AS_IS), ("BSD", _BSD),
        ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _UNLICENSE_REST + _AS_IS.split(" FITNESS")[0]), ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("WTFPL", _WTFPL),
        ("MIT", _GRANT[: _GRANT.index(", including")]), ("CC0-1.0", _CC0))]
    out += [("MIT", Wording(f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
                            f"substantial portions of the Software. {_AS_IS}", ("permission notice shall be included",))),
            ("ISC", Wording(_ISC + _ISC_KEEP, ("provided that the above copyright notice",))),
            ("ISC", Wording(_ISC + _ISC_KEEP + _ISC_AS_IS, ("provided that the above copyright notice",))),
            ("BSD-3-Clause", Wording(_BSD + _BSD_12 + _BSD_NAME.format(3) + _BSD_AS_IS, ("endorse or promote products derived",))),
            ("BSD-4-Clause", Wording(_BSD + _BSD_12 + _BSD_AD + _BSD_NAME.format(4) + _BSD_AS_IS, ("all advertising materials",))),
            ("EPL-1.0", Wording(_EPL_1, ("Eclipse Public License v1.0",))), ("EPL-2.0", Wording(_EPL_2, ("Eclipse Public License 2.0|Eclipse Public License v. 2.0|Eclipse Public License v2.0",))),
            ("MPL-1.1", Wording(_MPL_11, ("version 1.1",))),
            ("MPL-2.0", Wording("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("v. 2.0",)))]
    out += [(f"GFDL-{v}", Wording(_GFDL.format(v), (f"version {v}",))) for v in ("1.1", "1.2", "1.3")]
    for name, kind, version in (("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.0", "Lesser ", "2"),
                                ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
        full = f"{kind}General Public License"
        need = (f"GNU {full}", f"version {version}|version {version}.0")
        for subject in ("program", "library"):
            opening = _NOTICE.format(subject, full, version)
            only = opening.replace("either version", "version").replace(", or (at your option) any later version", "")
            out += [(name, Wording(t, need)) for t in (opening, opening + _WARRANTY.format(subject, full), only, only + _WARRANTY.format(subject, full))]
    for name, kind in (("GPL", ""), ("LGPL", "Lesser "), ("LGPL", "Library "), ("AGPL", "Affero ")):
        full = f"{kind}General Public License"
        out.append((name, Wording(_NOTICE.split(",")[0].format("program", full), (f"GNU {full}",))))
    return out


@cache
def licenses() -> dict[str, list[Wording]]:
    """All wordings by licence."""
    out: dict[str, list[Wording]] = {}
    for name, terms in NAMES.items():
        terms = {t.lower().replace("(", "").replace(")", "").replace("v. ", "v "): t for t in [*terms, *[t.replace("License", "Licence") for t in terms]]}
        out[name] = [Wording(c.format(t), (t,)) for t in terms.values() for c in CARRIERS[:-1]] + [
            Wording(CARRIERS[-1].format(t)) for t in {t.lower(): t for t in (*terms.values(), name) if " " not in t}.values()]
    for name, wording in _statements():
        out.setdefault(name, []).append(wording)
    for name, text in _whole().items():
        out.setdefault(name, []).append(Wording(text, _WHOLE_NEED.get(name, ())))
    return out
