"""Known licences: whole texts of the files in ``licences/`` in the dresses they are shipped in.

A file is named by its SPDX identifier (what follows ``~`` tells apart two texts of one
licence). Short licences come with and without a title line and 'All rights reserved.',
BSD texts with bullets and with numbers, long ones with and without their appendix, links
with both schemes, GNU texts with the addresses the foundation has had. A GNU text doesn't say
whether later versions hold, so it goes by the ``-only`` identifier.
"""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).with_name("licences")

# Title lines of licences whose text has none of its own; these names are used in notices too.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "Zero-Clause BSD"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License",
                     "BSD 2-Clause \"Simplified\" License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "The BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

# Names in notices of licences whose text has its own title.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    **{f"GPL-{v}.0-only": (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0",
                           f"GNU GPL v{v}", f"GPLv{v}") for v in (1, 2, 3)},
    **{f"LGPL-{v}-only": (f"GNU Lesser General Public License, version {v}", f"GNU Lesser General Public License v{v}")
       for v in ("2.1", "3.0")},
    **{f"GFDL-{v}-only": (f"GNU Free Documentation License, version {v}",) for v in ("1.2", "1.3")},
}

# What stands before a licence's name in a one-line notice.
BEFORE = ("Licensed under", "Released under", "Distributed under", "This work is licensed under",
          "This project is licensed under", "This software is licensed under", "This file is licensed under")

# Where an appendix starts, and addresses in GNU texts.
APPENDIX = re.compile(r"(?im)^[ \t]*(appendix: )?how to apply (these terms|the apache license)")
END = re.compile(r"(?im)^[ \t]*end of terms and conditions\s*$")
ADDRESS = re.compile(r"51 Franklin\s+(Street|St),\s+Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
ADDRESSES = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
             "675 Mass Ave, Cambridge, MA 02139, USA")


def texts() -> list[tuple[str, str]]:
    """(licence id, whole text) of the shipped files."""
    return [(p.name.removesuffix(".txt").split("~")[0], p.read_text()) for p in sorted(FOLDER.glob("*.txt"))]


def dresses(licence: str, text: str) -> list[str]:
    """``text`` as it is found in licence files."""
    out = [text]
    out += [text[:m.start()] for m in (APPENDIX.search(text), END.search(text)) if m]
    out += [ADDRESS.sub(a, t) for t in out if ADDRESS.search(t) for a in ADDRESSES]
    out += [t.replace("https://", "http://") for t in out] + [t.replace("http://", "https://") for t in out]
    if licence.startswith("BSD-"):
        at = iter(range(1, 9))
        plain = re.sub(r"(?m)^ *(\*|\d\.) ", "", text)
        numbered = re.sub(r"(?m)^(?=Redistributions |Neither )", lambda _: f"{next(at)}. ", plain)
        out += [plain, numbered]
    if licence == "ISC":
        out.append(text.replace("and/or distribute", "and distribute"))
    if licence in TITLES:
        fronts = [f"{title}\n{rights}" for title in ("", *TITLES[licence]) for rights in ("", "All rights reserved.\n")]
        out = [front + t for t in out for front in fronts]
    return list(dict.fromkeys(out))


def notices() -> list[tuple[str, str]]:
    """(licence id, line) of the usual one-line notices."""
    ids = dict.fromkeys([*TITLES, *(licence for licence, _ in texts())])
    out = [(licence, f"SPDX-License-Identifier: {licence}") for licence in ids]
    taken = [n for names in TITLES.values() for n in names]
    for licence, names in {**TITLES, **NAMES}.items():
        for name in names:
            if taken.count(name) < 2:  # a name of two licences tells neither
                bare = re.sub(r"^The ", "", name)
                out += [(licence, f"{b} {the}{bare}.") for b in BEFORE for the in ("", "the ")]
    return list(dict.fromkeys(out))


def known(own: tuple) -> list[tuple[str, str]]:
    """Rows of the known licences: ``own`` rows, those of them with a title in their
    dresses, the shipped texts in theirs, and notices."""
    whole = [r for r in own if r[0] in TITLES and len(r[1]) > 200] + texts()
    return list(dict.fromkeys([*own, *((i, d) for i, t in whole for d in dresses(i, t)), *notices()]))
