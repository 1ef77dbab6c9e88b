"""Templates of public licences and notices. Their wording is the licences' own.

Notices and headers stand here, whole licences in licenses/ (MIT, whole too, here): Apache 2.0, BSD of 2 and 3 clauses, CC0,
CC BY and BY-SA 4.0, GPL 1 to 3, ISC, LGPL 2 to 3, MPL 1.1 and 2.0, Unlicense. Not covered as whole texts: AGPL and the NC
and ND licences of CC, which may be found as their relatives (GPL 3, CC BY), and all others."""

import pkgutil

WHOLE = "apache-2 bsd-2 bsd-3 cc-by-4 cc-by-sa-4 cc0-1 gpl-1 gpl-2 gpl-3 isc lgpl-2 lgpl-2.1 lgpl-3 mpl-1.1 mpl-2 unlicense".split()
TEMPLATES: dict[str, str] = {
    "notice-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "notice-cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "notice-mit": "Released under the MIT License.",
    "notice-apache-2": "Licensed under the Apache License, Version 2.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
} | {name: pkgutil.get_data(__package__, f"licenses/{name}.txt").decode() for name in WHOLE}
