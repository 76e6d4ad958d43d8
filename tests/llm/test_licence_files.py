import textwrap

from searchlane.llm import licence_texts
from searchlane.llm import op2_license_digest as o2

FRONT = "Copyright (c) 2020, A. Person\n"


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.license_id, r.notices) for r in o2.scan(docs, o2.known_licences(spark)).collect()}


def test_whole_licence_files_with_titles(spark):
    whole = dict(licence_texts.texts())
    mit = max((t for n, t in o2.LICENCES if n == "MIT"), key=len)
    bsd = dict(licence_texts.texts()[::-1])["BSD-3-Clause"]
    cases = [
        ("MIT", f"MIT License\n\n{FRONT}\n" + textwrap.fill(mit, 78)),
        ("MIT", f"The MIT License (MIT)\n\n{FRONT}All rights reserved.\n\n" + textwrap.fill(mit, 60)),
        ("ISC", f"ISC License\n\n{FRONT}\n{whole['ISC']}"),
        ("BSD-2-Clause", f"BSD 2-Clause License\n\n{FRONT}All rights reserved.\n\n{whole['BSD-2-Clause']}"),
        ("BSD-3-Clause", f"{FRONT}All rights reserved.\n\n{bsd}"),
        ("Apache-2.0", whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Person")),
        ("Apache-2.0", whole["Apache-2.0"].split("   APPENDIX")[0]),
        ("MPL-2.0", whole["MPL-2.0"].replace("http://", "https://")), ("GPL-2.0-only", whole["GPL-2.0-only"]),
        ("GPL-3.0-only", whole["GPL-3.0-only"].replace("https://", "http://")),
        ("LGPL-2.1-only", whole["LGPL-2.1-only"]), ("CC0-1.0", whole["CC0-1.0"]),
        (None, f"MIT License\n\n{FRONT}\n" + mit + "\nand more"), (None, "MIT License\n\n" + FRONT),
        (None, whole["Apache-2.0"][:5000]),
    ]
    got = found(spark, [t for _, t in cases])
    assert [got[i][0] for i in range(len(cases))] == [n for n, _ in cases]


def test_wrapping_does_not_matter(spark):
    whole = dict(licence_texts.texts())
    cases = [(n, "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in whole[n].split("\n\n")))
             for n in ("Apache-2.0", "MPL-2.0", "Unlicense", "ISC", "Zlib") for width in (50, 72, 100, 10_000)]
    cases.append(("BSD-2-Clause", FRONT + " ".join(whole["BSD-2-Clause"].split()).replace("COPYRIGHT OWNER", "\nCOPYRIGHT OWNER")))
    got = found(spark, [t for _, t in cases])
    assert [(got[i][0], i) for i in range(len(cases))] == [(n, i) for i, (n, _) in enumerate(cases)]


def test_notices_of_common_licences(spark):
    got = found(spark, ["a\n# SPDX-License-Identifier: BSD-3-Clause\nb", "x\nReleased under the ISC License.",
                        "Licensed under the Mozilla Public License, v. 2.0", "Licensed under the BSD License."])
    assert [got[i][1] for i in range(4)] == ["BSD-3-Clause", "ISC", "MPL-2.0", ""]
