"""Public licence texts, standard headers and short notices, by SPDX id. Long licences are represented by
their opening, their standard header or the notice that their appendix asks for, which whole copies of them contain."""

from __future__ import annotations

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(what: str, version: str) -> str:
    """The header that the GNU licences ask for."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the
GNU {what} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {what} for more details."""


def _creative(kind: str, code: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {code} 4.0.",
        f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
        f"""By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this
Creative Commons {kind} 4.0 International Public License ("Public License").""",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AFL-3.0": ("Licensed under the Academic Free License version 3.0",),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        _gnu("Affero General Public License", "3"),
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "This project is licensed under the BSD 2-Clause License.", _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License.", _BSD_HEAD + _BSD_THIRD, _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:""",
    ),
    "CC-BY-4.0": _creative("Attribution", "BY"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-NC-ND-4.0": _creative("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "CC-BY-NC-SA-4.0": _creative("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-ND-4.0": _creative("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "BY-SA"),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her
rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.""",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""",
        """The accompanying program is provided under the terms of this Eclipse Public License ("Agreement"). Any use, reproduction
or distribution of the program constitutes recipient's acceptance of this Agreement.""",
    ),
    "EUPL-1.2": ("Licensed under the European Union Public Licence, version 1.2.",),
    "GFDL-1.3": (
        """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation
License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
Front-Cover Texts, and no Back-Cover Texts.""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("General Public License", "2"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _gnu("General Public License", "3"),
        """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most
software and other practical works are designed to take away your freedom to share and change the works.""",
    ),
    "ISC": ("Released under the ISC License.", "This project is licensed under the ISC License.", _ISC_GRANT, _ISC_GRANT + _ISC_REST),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("Lesser General Public License", "2.1")),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        _gnu("Lesser General Public License", "3"),
        """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
General Public License, supplemented by the additional permissions listed below.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "Distributed under the MIT software license.",
        _MIT_GRANT,
        _MIT_GRANT + _MIT_REST,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "MS-PL": ("Licensed under the Microsoft Public License (Ms-PL).",),
    "ODbL-1.0": ("This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "PSF-2.0": ("Licensed to the Python Software Foundation under a Contributor Agreement.", "Licensed under the Python Software Foundation License, version 2."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
}
