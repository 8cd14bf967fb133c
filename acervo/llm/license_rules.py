"""Signature rules of license notices, for texts cut to words: lower-case, one blank between words.

A family names a license in the forms in which notices write it. Each form gives rules of its own kind:
an SPDX line, a web address, a grant ("licensed under the ..."), a title ("... license") and, where the name
is unmistakable, the bare name. The bodies of notices, which say what is permitted without a name, have rules of
their own. A kind has a priority and a score, and a rule a keyword without which it can't match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: label: (names, SPDX identifiers, addresses, whether a name stands for itself)
FAMILIES: dict[str, tuple[list[str], list[str], list[str], bool]] = {
    "mit": (["mit", "mit x11", "expat"], ["mit"], ["opensource org licenses? mit", "mit license org"], False),
    "mit-0": (["mit no attribution", "mit 0"], ["mit 0"], ["opensource org licenses? mit 0"], False),
    "apache-2": (["apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?", "apache software 2(?: 0)?"], ["apache 2 0"], ["apache org licenses license 2 0"], False),
    "apache-1": (["apache(?: software)?(?: license)? (?:version |v )?1 [01]"], ["apache 1 [01]"], ["apache org licenses license 1 [01]"], False),
    "bsd-2-clause": (["bsd 2 clause", "simplified bsd", "2 clause bsd", "freebsd"], ["bsd 2 clause"], ["opensource org licenses? bsd 2 clause"], False),
    "bsd-3-clause": (["bsd 3 clause", "new bsd", "modified bsd", "3 clause bsd"], ["bsd 3 clause"], ["opensource org licenses? bsd 3 clause"], False),
    "bsd-4-clause": (["bsd 4 clause", "original bsd", "4 clause bsd"], ["bsd 4 clause"], ["spdx org licenses bsd 4 clause"], False),
    "bsd-0-clause": (["zero clause bsd", "bsd 0 clause", "0bsd"], ["0bsd"], ["opensource org licenses? 0bsd"], False),
    "gpl-1": (["gnu general public license,? (?:version |v )1", "gpl ?v? ?1(?: 0)?"], ["gpl 1 0(?: only| or later)?"], ["gnu org licenses (?:old licenses )?gpl 1 0"], True),
    "gpl-2": (["gnu general public license (?:version |v )2", "gnu gpl (?:version |v ?)?2(?: 0)?", "gplv2", "gpl 2(?: 0)?"], ["gpl 2 0(?: only| or later)?"], ["gnu org licenses (?:old licenses )?gpl 2 0"], True),
    "gpl-3": (["gnu general public license (?:version |v )3", "gnu gpl (?:version |v ?)?3(?: 0)?", "gplv3", "gpl 3(?: 0)?"], ["gpl 3 0(?: only| or later)?"], ["gnu org licenses gpl 3 0"], True),
    "gpl": (["gnu general public license", "gnu gpl", "gpl"], ["gpl"], ["gnu org licenses gpl", "gnu org copyleft gpl"], False),
    "lgpl-2": (["gnu library general public license (?:version |v )2", "lgpl 2(?: 0)?"], ["lgpl 2 0(?: only| or later)?"], ["gnu org licenses (?:old licenses )?lgpl 2 0"], True),
    "lgpl-2.1": (["gnu lesser general public license (?:version |v )2 1", "lgplv2 1", "lgpl 2 1"], ["lgpl 2 1(?: only| or later)?"], ["gnu org licenses (?:old licenses )?lgpl 2 1"], True),
    "lgpl-3": (["gnu lesser general public license (?:version |v )3", "lgplv3", "lgpl 3(?: 0)?"], ["lgpl 3 0(?: only| or later)?"], ["gnu org licenses lgpl 3 0"], True),
    "lgpl": (["gnu (?:lesser|library) general public license", "gnu lgpl", "lgpl"], ["lgpl"], ["gnu org licenses lgpl"], False),
    "agpl-3": (["gnu affero general public license(?: version 3)?", "agplv3", "agpl 3(?: 0)?"], ["agpl 3 0(?: only| or later)?"], ["gnu org licenses agpl 3 0"], True),
    "gfdl": (["gnu free documentation license", "gfdl"], ["gfdl 1 [123](?: only| or later)?"], ["gnu org (?:licenses|copyleft) fdl"], True),
    "mpl-1": (["mozilla public license (?:version |v )1 [01]", "mpl 1 [01]"], ["mpl 1 [01]"], ["mozilla org mpl 1 [01]"], True),
    "mpl-2": (["mozilla public license (?:version |v )?2(?: 0)?", "mpl 2 0"], ["mpl 2 0"], ["mozilla org (?:en us )?mpl 2 0"], True),
    "epl-1": (["eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"], ["epl 1 0"], ["eclipse org legal epl v10"], True),
    "epl-2": (["eclipse public license (?:version |v )?2(?: 0)?", "epl 2 0"], ["epl 2 0"], ["eclipse org legal epl 2 0"], True),
    "cddl": (["common development and distribution license", "cddl 1 [01]"], ["cddl 1 [01]"], ["opensource org licenses? cddl1"], True),
    "cpl": (["common public license"], ["cpl 1 0"], ["opensource org licenses? cpl1 0"], True),
    "eupl": (["european union public licence", "eupl"], ["eupl 1 [012]"], ["joinup ec europa eu (?:software page|collection) eupl"], True),
    "isc": (["isc"], ["isc"], ["opensource org licenses? isc"], False),
    "zlib": (["zlib", "zlib libpng"], ["zlib"], ["zlib net zlib license", "opensource org licenses? zlib"], False),
    "libpng": (["libpng"], ["libpng(?: 2 0)?"], ["libpng org pub png src libpng license"], False),
    "boost": (["boost software", "boost"], ["bsl 1 0"], ["boost org license 1 0"], False),
    "bsl": (["business source", "busl 1 1"], ["busl 1 1"], ["mariadb com bsl11"], False),
    "unlicense": (["unlicense"], ["unlicense"], ["unlicense org"], False),
    "wtfpl": (["do what the f\\w+ you want to public license", "wtfpl"], ["wtfpl"], ["wtfpl net"], True),
    "artistic-1": (["artistic license (?:version |v )?1(?: 0)?"], ["artistic 1 0(?: perl| cl8)?"], ["opensource org licenses? artistic license 1 0"], True),
    "artistic-2": (["artistic license (?:version |v )?2(?: 0)?"], ["artistic 2 0"], ["perlfoundation org artistic license 2 0"], True),
    "perl": (["same terms as perl itself"], ["artistic 1 0 perl or gpl 1 0 or later"], ["dev perl org licenses"], True),
    "python": (["python software foundation", "psf"], ["psf 2 0", "python 2 0"], ["python org psf license", "docs python org 3 license"], False),
    "ruby": (["ruby"], ["ruby"], ["ruby lang org en about license"], False),
    "php": (["php (?:version |v )?3 0[1]?"], ["php 3 0[1]?"], ["php net license 3 0"], False),
    "postgresql": (["postgresql"], ["postgresql"], ["postgresql org about licence"], False),
    "openssl": (["openssl"], ["openssl"], ["openssl org source license"], False),
    "curl": (["curl"], ["curl"], ["curl se docs copyright", "curl haxx se docs copyright"], False),
    "x11": (["x11", "x consortium"], ["x11"], ["spdx org licenses x11"], False),
    "ofl": (["sil open font", "open font", "ofl 1 1"], ["ofl 1 1"], ["scripts sil org ofl"], False),
    "oldap": (["openldap public"], ["oldap 2 8"], ["openldap org software release license"], False),
    "ms-pl": (["microsoft public", "ms pl"], ["ms pl"], ["opensource org licenses? ms pl"], False),
    "ms-rl": (["microsoft reciprocal", "ms rl"], ["ms rl"], ["opensource org licenses? ms rl"], False),
    "afl": (["academic free"], ["afl 3 0"], ["opensource org licenses? afl 3 0"], False),
    "osl": (["open software"], ["osl 3 0"], ["opensource org licenses? osl 3 0"], False),
    "cecill": (["cecill", "cecill b", "cecill c"], ["cecill 2 [01]", "cecill [bc]"], ["cecill info licences"], False),
    "ncsa": (["university of illinois ncsa open source", "ncsa open source"], ["ncsa"], ["opensource org licenses? ncsa"], False),
    "odbl": (["open database", "odbl"], ["odbl 1 0"], ["opendatacommons org licenses odbl"], False),
    "odc-by": (["open data commons attribution", "odc by"], ["odc by 1 0"], ["opendatacommons org licenses by"], False),
    "pddl": (["open data commons public domain dedication and", "pddl"], ["pddl 1 0"], ["opendatacommons org licenses pddl"], False),
    "cc0": (["cc0(?: 1 0)?", "cc zero", "creative commons zero"], ["cc0 1 0"], ["creativecommons org publicdomain zero"], True),
    "cc-by": (["cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"], ["cc by [1-4] [05]"], ["creativecommons org licenses by"], True),
    "cc-by-sa": (["cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"], ["cc by sa [1-4] [05]"], ["creativecommons org licenses by sa"], True),
    "cc-by-nd": (["cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?(?: international| unported)?"], ["cc by nd [1-4] [05]"], ["creativecommons org licenses by nd"], True),
    "cc-by-nc": (["cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"], ["cc by nc [1-4] [05]"], ["creativecommons org licenses by nc"], True),
    "cc-by-nc-sa": (["cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"], ["cc by nc sa [1-4] [05]"], ["creativecommons org licenses by nc sa"], True),
    "cc-by-nc-nd": (["cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?(?: international| unported)?"], ["cc by nc nd [1-4] [05]"], ["creativecommons org licenses by nc nd"], True),
    "public-domain": (["released into the public domain", "dedicated to the public domain", "public domain dedication"], ["licenseref public domain"], ["creativecommons org publicdomain mark"], True),
    "all-rights-reserved": (["all rights reserved"], ["licenseref all rights reserved"], ["wikipedia org wiki all rights reserved"], True),
    "proprietary": (["proprietary and confidential", "unauthorized copying of this file"], ["licenseref proprietary"], ["licenseref org proprietary"], True),
}

#: label, keyword and signature of a notice's body.
BODIES = [
    ("mit", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", " permission to use ", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", " permission to use ", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("bsd-2-clause", " redistribution and use ", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", " redistribution and use ", "redistribution and use in source and binary forms with or without modification are permitted .{0,900}?neither the names? of .{0,120}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", " redistribution and use ", "redistribution and use in source and binary forms with or without modification are permitted .{0,900}?all advertising materials mentioning features or use of this software must display"),
    ("bsd", " redistributions of ", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", " redistributions in ", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", " license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", " license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", " free software ", "(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", " free software ", "(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", " free software ", "(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", " free software ", "this (?:library|program|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3", " free software ", "(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", " license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1", " license", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl-1", " license", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", " license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("zlib", " altered source ", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", " hereby granted ", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", " free and unencumbered ", "this is free and unencumbered software released into the public domain"),
    ("ofl", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("postgresql", " permission to use ", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("warranty-disclaimer", " provided as is ", "(?:this )?software is provided as is without warrant(?:y|ies) of any kind"),
    ("warranty-disclaimer", " provided as is ", "this software is provided as is without any express(?:ed)? or implied warrant(?:y|ies)"),
    ("warranty-disclaimer", " or implied warrant", "this software is provided by .{0,120}?as is and any express(?:ed)? or implied warrant(?:y|ies)"),
    ("warranty-disclaimer", " without any warranty ", "in the hope that it will be useful but without any warranty"),
]

#: kind: (priority: the least wins, score)
KINDS = {"spdx": (1, 1.0), "address": (2, 0.95), "body": (3, 0.95), "grant": (4, 0.9), "title": (5, 0.8), "name": (6, 0.6)}
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|covered|shared) under (?:the )?(?:terms of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str


def _start(body: str) -> str:
    """The letters that every match of the pattern begins with."""
    found = re.match(r"[a-z0-9 ]+(?![?])", body)
    return found[0].rstrip() if found else ""


def _rule(kind: str, label: str, number: int, keyword: str, body: str) -> Rule:
    priority, score = KINDS[kind]
    return Rule(f"{label}:{kind}:{number}", label, priority, score, keyword, f"(?<= )(?:{body})(?= )")


def rules() -> list[Rule]:
    """All rules, in order of priority, family and form."""
    found: list[Rule] = []
    for label, (names, identifiers, addresses, alone) in FAMILIES.items():
        for i, body in enumerate(identifiers):
            found.append(_rule("spdx", label, i, "spdx", f"spdx license identifier {body}"))
        for i, body in enumerate(addresses):
            found.append(_rule("address", label, i, f" {body.split()[0]} ", body))
        for i, body in enumerate(names):
            found.append(_rule("grant", label, i, " under ", f"{GRANT}{body}(?: licen[sc]e)?"))
            if not body.endswith("license"):
                found.append(_rule("title", label, i, " licen", f"{body} licen[sc]e"))
            if alone:
                found.append(_rule("name", label, i, f" {_start(body)}", body))
    for i, (label, keyword, body) in enumerate(BODIES):
        found.append(_rule("body", label, i, keyword, body))
    return sorted(found, key=lambda r: r.priority)
