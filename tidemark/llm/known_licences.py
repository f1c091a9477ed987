"""Published licence texts and one-line notices, by SPDX identifier."""

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_BODY = f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"

KNOWN: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n\n{_MIT_BODY}"),
    ("MIT", _MIT_BODY),
    ("MIT-0", f"{_MIT_GRANT}.\n\n{_MIT_END}"),
    ("ISC", f"ISC License\n\n{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_PERMISSION}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_START}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

# Further whole texts, looked up in their bare form only.
MORE: list[tuple[str, str]] = [
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# Bare digests of long published texts (as in /usr/share/common-licenses): whole, up to the end of the terms with and without that line.
WHOLE: list[tuple[str, str]] = [
    ("Apache-2.0", "8e792364d7efb07e7dda205a266c3971"),
    ("Apache-2.0", "2d58937c77b087b1483871b7790f4ff4"),
    ("Apache-2.0", "819e1346e10fa7cbb89ee462cd5ab553"),
    ("GPL-1.0-only", "12230d287458918d96852f3d10d7a73a"),
    ("GPL-1.0-only", "e7ce708720ddc20903962d5b4c7f1108"),
    ("GPL-1.0-only", "f54f4376046230fa93ceb7d053706d67"),
    ("GPL-2.0-only", "ccbc1516ab8d4fb3a0b587caaf3b4e44"),
    ("GPL-2.0-only", "d92e221ffab577a6abecb1c0d7bae180"),
    ("GPL-2.0-only", "e0b73d2a90e4882ceb9385da5cbec170"),
    ("GPL-3.0-only", "b74a1e60f51fc98d50cb54c3faa23d5e"),
    ("GPL-3.0-only", "a3ce09711adad946cd15a127ad1aefdb"),
    ("GPL-3.0-only", "259e1c97bdde0cf4ef195ff4d90e7777"),
    ("LGPL-2.0-only", "9097adad8e22b8009075bd6d0b3d2c02"),
    ("LGPL-2.0-only", "3931f6d4c25d8929f185633346565947"),
    ("LGPL-2.0-only", "b9be00f4e1e63a1a8b2011d7ee5d0794"),
    ("LGPL-2.1-only", "0e194d699ca13e50ef5f443602eeeb76"),
    ("LGPL-2.1-only", "b3ae58e459c3ea8c26f6d2fbf8b88bc2"),
    ("LGPL-2.1-only", "60b263c5149d023a2a750de08a6b06db"),
    ("LGPL-3.0-only", "0115b60679255b9b23754024cf3f86d4"),
    ("MPL-1.1", "da951d7e493d2c325c187aa7337b4fed"),
    ("MPL-2.0", "2be33150e32e5d3800437177048b2baf"),
    ("CC0-1.0", "608f2c07e88fc56bede2605107031f66"),
    ("GFDL-1.2-only", "077c7d402d83fdecc4edb1a2b4b1f08f"),
    ("GFDL-1.3-only", "8b2cc8a83e58629efb01394b2bc837c5"),
]
