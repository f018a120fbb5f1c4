"""License scan by ordered signature rules, in DataFrame functions only: one projection, no shuffle.

A text without any keyword of the gate is done at once. Otherwise its words are joined by single spaces, and each rule is
tried whose own keyword stands there. Patterns are literals, so that each is compiled once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import texts

_L = "licen[cs]e"
# Signatures by keyword: label, priority (1 decides over 2 over 3), weight, pattern over words. Openings and
# clauses of license texts, notices in files, and SPDX lines.
SIGNATURES: dict[str, tuple[tuple[str, int, float, str], ...]] = {
    # permissive texts
    "granted free of charge": (
        ("mit", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?"),
        ("boost", 1, 0.95, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("icu", 2, 0.7, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
        ("mit", 3, 0.6, r"permission is hereby granted free of charge"),
    ),
    "to deal in the software": (("mit", 1, 0.9, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),),
    "substantial portions": (("mit", 2, 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),),
    "good not evil": (("json", 1, 0.99, r"the software shall be used for good not evil"),),
    "advertising or otherwise": (("x11", 1, 0.9, r"except as contained in this notice the names? of (?:the )?(?:\S+ ){1,8}shall not be used in advertising or otherwise to promote"),),
    "fee is hereby granted": (
        ("isc", 1, 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
        ("0bsd", 1, 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= the software is provided)"),
        ("isc", 2, 0.8, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
        ("hpnd", 2, 0.8, r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)? (?:is hereby granted )?without fee is hereby granted"),
    ),
    "without a written agreement": (("postgresql", 1, 0.95, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),),
    "author disclaims all warranties": (("isc", 2, 0.8, r"the software is provided as is and the author disclaims all warranties with regard to this software"),),
    "express or implied warranty": (
        ("zlib", 1, 0.9, r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
        ("zlib", 3, 0.5, r"provided as is without (?:any )?express or implied warranty"),
    ),
    "plainly marked": (("zlib", 1, 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),),
    "misrepresented": (("zlib", 2, 0.85, r"the origin of this software must not be misrepresented"),),
    "redistribution and use": (
        ("bsd", 1, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
        ("bsd", 3, 0.6, r"redistribution and use in source and binary forms"),
    ),
    "redistributions": (
        ("bsd", 2, 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", 2, 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("apache-1.1", 2, 0.8, r"redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment"),
        ("bsd-source-code", 3, 0.5, r"redistributions of source code must retain"),
    ),
    "endorse or promote": (
        ("bsd-3-clause", 1, 0.9, r"neither the names? of (?:the )?(?:\S+ ){1,12}(?:may|nor the names? of its contributors may) be used to endorse or promote products derived from this software"),
        ("bsd-3-clause", 2, 0.8, r"may not be used to endorse or promote products derived from this software without(?: specific)? prior written permission"),
    ),
    "all advertising materials": (("bsd-4-clause", 1, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),),
    "copyright holders and contributors": (("bsd", 2, 0.8, r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),),
    "regents": (("bsd", 2, 0.85, r"(?:copyright c? ?(?:\d+ )*|this software is provided by )the regents(?: of the university of california)?"),),
    "openssl": (("openssl", 1, 0.95, r"this product includes software developed by the openssl project"), ("openssl", 2, 0.85, rf"openssl {_L}")),
    "apache software foundation": (
        ("apache-1.1", 1, 0.9, r"this product includes software developed by the apache software foundation"),
        ("apache", 2, 0.85, rf"licensed to the apache software foundation asf under one or more contributor {_L} agreements"),
    ),
    "apache org": (("apache", 1, 0.95, r"(?:www )?apache org licenses license 2 0(?: (?:html|txt))?"), ("apache", 2, 0.85, r"(?:www )?apache org licenses")),
    "except in compliance": (
        ("apache", 1, 0.95, rf"licensed under the apache {_L} version 2 0 the {_L} you may not use this file except in compliance with the {_L}"),
        ("apache", 2, 0.7, rf"you may not use this file except in compliance with the {_L}"),
    ),
    "agreed to in writing": (("apache", 2, 0.7, rf"unless required by applicable law or agreed to in writing software distributed under the {_L} is distributed on an as is basis"),),
    "apache": (
        ("apache", 1, 0.95, rf"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? {_L}(?: (?:version )?v?\d+(?: \d+)?)?"),
        ("apache", 2, 0.9, rf"apache(?: software)? {_L} (?:version |v)?\d+(?: \d+)?"), ("apache", 2, 0.8, r"apache (?:v |version )?2(?: 0)?"), ("apache", 3, 0.6, rf"apache(?: software)? {_L}"),
        ("apache-1.1", 1, 0.95, rf"apache(?: software)? {_L} (?:version |v)?1 1"),
    ),
    " mit ": (
        ("mit", 1, 0.95, rf"(?:licensed|released|distributed|published|available|made available) under (?:the )?(?:terms of )?(?:the )?(?:permissive )?mit(?: style)? {_L}"),
        ("mit", 2, 0.9, rf"(?:use of this|this) (?:file|work|software|program|project|source code) is (?:governed by|subject to|covered by|under) (?:the |an )?mit {_L}"),
        ("mit", 2, 0.8, rf"mit {_L}d(?: code| software)?"), ("mit", 2, 0.75, rf"(?:see|read) the mit {_L} for (?:more )?(?:details|permissions)"), ("mit", 3, 0.6, rf"mit(?: x11| x| style)? {_L}"),
        ("mit", 3, 0.5, rf"{_L}(?:d under)?(?: is)? mit"),
    ),
    "expat": (("mit", 2, 0.85, rf"expat(?: mit)? {_L}"),),
    "x11": (("x11", 2, 0.85, rf"(?:mit )?x11(?: style)? {_L}"),),
    "x consortium": (("x11", 2, 0.8, r"x consortium"),),
    "asl 2 0": (("apache", 2, 0.9, r"asl 2 0"),),
    " bsd ": (
        ("bsd-2-clause", 1, 0.95, rf"(?:simplified|freebsd|2 clause|two clause) bsd {_L}|bsd (?:2|two) clause(?: {_L})?"),
        ("bsd-3-clause", 1, 0.95, rf"(?:new|revised|modified|3 clause|three clause) bsd {_L}|bsd (?:3|three) clause(?: {_L})?"),
        ("bsd-4-clause", 1, 0.95, rf"(?:original|old|4 clause|four clause) bsd {_L}|bsd (?:4|four) clause(?: {_L})?"),
        ("0bsd", 1, 0.95, rf"(?:zero clause|0 clause) bsd(?: {_L})?|bsd (?:zero|0) clause(?: {_L})?"),
        ("bsd", 2, 0.85, rf"(?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? {_L}"), ("bsd", 3, 0.6, rf"bsd(?: style)? {_L}"),
    ),
    "freebsd": (("bsd-2-clause", 2, 0.85, rf"freebsd {_L}"),),
    " isc ": (("isc", 2, 0.85, rf"isc {_L}"),),
    "zlib": (("zlib", 2, 0.85, rf"zlib(?: libpng)? {_L}"),),
    "boost": (("boost", 1, 0.95, rf"(?:distributed|released|licensed) under the boost software {_L}(?: version \d+(?: \d+)?)?"), ("boost", 2, 0.85, rf"boost(?: software)? {_L}(?: version)?(?: v?\d+(?: \d+)?)?"), ("boost", 2, 0.85, r"boost org license 1 0 txt")),
    "python software foundation": (("python", 1, 0.95, rf"this {_L} agreement is between the python software foundation psf"), ("python", 2, 0.85, rf"python software foundation {_L}(?: version \d+)?")),
    " psf ": (("python", 2, 0.8, rf"psf {_L}"),),
    "ruby": (("ruby", 2, 0.8, rf"ruby(?: s)? {_L}|same terms as ruby(?: itself)?"),),
    " php ": (("php", 2, 0.85, rf"(?:the )?php {_L}(?: v(?:ersion)? ?\d+(?: \d+)?)?"),),
    "perl": (("artistic", 1, 0.9, r"(?:under the )?same terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?"),),
    "artistic": (("artistic", 1, 0.9, rf"artistic {_L} (?:version )?v?\d+(?: \d+)?"), ("artistic", 2, 0.85, rf"(?:clarified )?artistic {_L}")),
    "conditions under which a package": (("artistic", 1, 0.9, r"the intent of this document is to state the conditions under which a package may be copied"),),
    "vim license": (("vim", 2, 0.85, r"vim license"),),
    "beer ware": (("beerware", 1, 0.95, rf"the beer ware {_L}(?: revision \d+)?"),),
    "buy me a beer": (("beerware", 1, 0.95, r"if we meet some day and you think this stuff is worth it you can buy me a beer"),),
    "you want to": (("wtfpl", 1, 0.95, rf"do what the f\S+ you want to(?: public {_L})?"),),
    "wtfpl": (("wtfpl", 2, 0.9, r"wtfpl(?: (?:version |v)?\d+)?"),),
    "unencumbered": (("unlicense", 1, 0.99, r"this is free and unencumbered software released into the public domain"),),
    "unlicense": (("unlicense", 2, 0.9, r"the unlicen[cs]e|unlicense org"),),
    "public domain": (
        ("public-domain", 1, 0.9, r"(?:is |are |been |hereby )?(?:dedicated|released|placed|put|committed) (?:in)?to the public domain|(?:is|are) in the public domain|placed in the public domain"),
        ("public-domain", 2, 0.85, r"public domain dedication"), ("public-domain", 3, 0.5, r"public domain"),
    ),
    # copyleft texts
    "free software": (
        ("gpl", 1, 0.95, r"this (?:program|file|script|code|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("lgpl", 1, 0.95, r"this (?:library|program|file|package) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
        ("agpl", 1, 0.95, r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
        ("copyleft", 3, 0.5, r"is free software you can redistribute it and or modify it"),
    ),
    "any later version": (
        ("gpl", 2, 0.8, rf"either version \d+(?: \d+)? of the {_L} or at your option any later version"),
        ("gpl", 2, 0.9, rf"(?:gnu )?(?:general public {_L}|gpl) (?:version |v)?\d+(?: \d+)? or (?:at your option )?any later version"),
    ),
    "affero": (("agpl", 1, 0.95, rf"(?:gnu )?affero general public {_L}(?: (?:version |v)?\d+(?: \d+)?)?(?: or (?:any )?later)?"), ("agpl", 2, 0.8, r"affero gpl")),
    "remote network interaction": (("agpl", 1, 0.9, rf"remote network interaction use with the gnu general public {_L}"),),
    "lesser general": (("lgpl", 1, 0.95, rf"(?:gnu )?lesser general public {_L}(?: (?:version |v)?\d+(?: \d+)?)?(?: or (?:any )?later)?"),),
    "library general": (("lgpl", 1, 0.95, rf"(?:gnu )?library general public {_L}(?: (?:version |v)?\d+(?: \d+)?)?(?: or (?:any )?later)?"),),
    "general public": (
        ("gpl", 1, 0.95, rf"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),
        ("gpl", 2, 0.9, rf"(?:gnu )?general public {_L} (?:version |v)?\d+(?: \d+)?(?: or (?:any )?later)?"),
        ("gpl", 2, 0.85, rf"you should have received a copy of the gnu general public {_L}(?: along with this (?:program|library|file|package))?"),
        ("lgpl", 2, 0.85, rf"you should have received a copy of the gnu (?:lesser|library) general public {_L}"), ("agpl", 2, 0.85, rf"you should have received a copy of the gnu affero general public {_L}"),
        ("gpl", 2, 0.75, rf"see the gnu general public {_L} for more details"), ("gpl", 3, 0.6, rf"(?:gnu )?general public {_L}"),
    ),
    "gnu": (("gpl", 2, 0.85, rf"gnu gpl(?: (?:version |v)?\d+(?: \d+)?)?"), ("lgpl", 2, 0.85, r"gnu lgpl(?: (?:version |v)?\d+(?: \d+)?)?"), ("agpl", 2, 0.85, r"gnu agpl(?: (?:version |v)?\d+(?: \d+)?)?"), ("gpl", 2, 0.85, rf"gnu org licenses(?: gpl| old licenses)?")),
    "gpl": (
        ("gpl", 1, 0.95, r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: ?(?:version |v)?\d+(?: \d+)?)?(?: or (?:any )?later| only)?"),
        ("gpl", 2, 0.85, r"gpl ?(?:version |v)?\d+(?: \d+)?(?: or (?:any )?later| only)?"), ("gpl", 2, 0.85, r"gplv\d+(?: \d+)?"), ("gpl", 3, 0.5, r"gpl"), ("gpl", 2, 0.8, r"gpl compatible"),
        ("lgpl", 1, 0.95, r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?: ?(?:version |v)?\d+(?: \d+)?)?(?: or (?:any )?later| only)?"),
        ("lgpl", 2, 0.85, r"lgpl ?(?:version |v)?\d+(?: \d+)?(?: or (?:any )?later| only)?"), ("lgpl", 2, 0.85, r"lgplv\d+(?: \d+)?"), ("lgpl", 3, 0.5, r"lgpl"),
        ("agpl", 2, 0.85, r"agpl ?(?:version |v)?\d+(?: \d+)?(?: or (?:any )?later| only)?"), ("agpl", 2, 0.85, r"agplv\d+(?: \d+)?"), ("agpl", 3, 0.5, r"agpl"),
    ),
    "copyleft": (("copyleft", 3, 0.4, r"copyleft"),),
    "mozilla": (
        ("mpl", 1, 0.99, rf"this source code form is subject to the terms of the mozilla public {_L} v(?:ersion)? ?\d+(?: \d+)?"),
        ("mpl", 1, 0.95, rf"the contents of this file are subject to the mozilla public {_L}(?: version \d+(?: \d+)?)?"),
        ("mpl", 2, 0.85, rf"mozilla public {_L}(?: (?:version |v)?\d+(?: \d+)?)?"), ("mpl", 2, 0.85, r"mozilla org mpl"),
    ),
    "was not distributed with": (("mpl", 2, 0.85, r"if a copy of the mpl was not distributed with this file you can obtain one at"),),
    " mpl ": (("mpl", 2, 0.8, r"mpl (?:version |v)?\d+(?: \d+)?"),),
    "netscape": (("npl", 2, 0.85, rf"netscape public {_L}(?: version \d+(?: \d+)?)?"),),
    "eclipse": (
        ("epl", 1, 0.95, rf"this program and the accompanying materials are made available under the terms of the eclipse public {_L}(?: v?\d+(?: \d+)?)?"),
        ("epl", 2, 0.85, rf"eclipse public {_L}(?: (?:version |v)?\d+(?: \d+)?)?"), ("edl", 2, 0.85, rf"eclipse distribution {_L}(?: v?\d+(?: \d+)?)?"),
    ),
    "common public": (("cpl", 2, 0.85, rf"common public {_L}(?: (?:version |v)?\d+(?: \d+)?)?"), ("cpal", 2, 0.85, rf"common public attribution {_L}(?: version)?(?: \d+(?: \d+)?)?")),
    "common development": (("cddl", 1, 0.95, rf"(?:subject to|under) the terms of the common development and distribution {_L}"), ("cddl", 2, 0.85, rf"common development and distribution {_L}(?: (?:version |v)?\d+(?: \d+)?)?")),
    "cddl": (("cddl", 2, 0.8, r"cddl(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "european union public": (("eupl", 1, 0.95, rf"european union public {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "eupl": (("eupl", 2, 0.85, r"eupl(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "cecill": (("cecill", 2, 0.85, rf"cecill(?: [bc])?(?: free software)?(?: {_L})?(?: agreement)?(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "microsoft": (("ms-pl", 2, 0.85, rf"microsoft public {_L}(?: ms pl)?"), ("ms-rl", 2, 0.85, rf"microsoft reciprocal {_L}(?: ms rl)?"), ("proprietary", 2, 0.7, rf"microsoft software {_L} terms")),
    "open software": (("osl", 2, 0.85, rf"open software {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "academic free": (("afl", 2, 0.85, rf"academic free {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "reciprocal public": (("rpl", 2, 0.85, rf"reciprocal public {_L}(?: \d+(?: \d+)?)?"),),
    "server side public": (("sspl", 1, 0.95, rf"server side public {_L}(?: (?:version |v)?\d+)?"),),
    "business source": (("bsl", 1, 0.95, rf"business source {_L}(?: \d+(?: \d+)?)?"),),
    "elastic license": (("elastic", 2, 0.85, r"elastic license(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "commons clause": (("commons-clause", 1, 0.9, rf"commons clause(?: {_L})?(?: condition)?"),),
    "blueoak": (("blueoak", 2, 0.85, rf"blueoak model {_L}(?: \d+(?: \d+){{0,2}})?"),),
    "blue oak": (("blueoak", 2, 0.85, rf"blue oak model {_L}(?: \d+(?: \d+){{0,2}})?"),),
    "universal permissive": (("upl", 2, 0.85, rf"universal permissive {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "mulan": (("mulan", 2, 0.85, rf"mulan (?:psl|permissive software {_L})(?: v?\d+)?"),),
    "ncsa": (("ncsa", 2, 0.85, rf"(?:university of illinois )?ncsa(?: open source)? {_L}"),),
    "w3c": (("w3c", 2, 0.85, rf"w3c software(?: notice)?(?: and(?: document)?)? {_L}"),),
    "lppl": (("lppl", 2, 0.85, r"lppl(?: (?:version |v)?\d+(?: \d+)?[a-z]?)?"),),
    "latex project public": (("lppl", 1, 0.95, rf"latex project public {_L}(?: version \d+(?: \d+)?[a-z]?)?"),),
    "open font": (("ofl", 1, 0.95, rf"this font software is licensed under the sil open font {_L}(?: version \d+(?: \d+)?)?"), ("ofl", 2, 0.85, rf"(?:sil )?open font {_L}(?: (?:version |v)?\d+(?: \d+)?)?")),
    "reserved font name": (("ofl", 2, 0.7, r"reserved font name"),),
    "font software": (("ofl", 2, 0.75, r"the font software may be modified altered or added to"),),
    # texts and data
    "free documentation": (("fdl", 1, 0.95, rf"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_L}"), ("fdl", 2, 0.85, rf"(?:gnu )?free documentation {_L}(?: (?:version |v)?\d+(?: \d+)?)?")),
    "gfdl": (("fdl", 2, 0.8, r"gfdl(?: \d+(?: \d+)?)?"),),
    "open database": (("odbl", 1, 0.95, rf"(?:open data commons )?open database {_L}(?: odbl)?(?: v?\d+(?: \d+)?)?"),),
    "odbl": (("odbl", 2, 0.8, r"odbl(?: v?\d+(?: \d+)?)?"),),
    "open data commons": (("odc-by", 2, 0.85, rf"open data commons attribution {_L}"), ("pddl", 2, 0.85, rf"open data commons public domain dedication(?: and)?(?: {_L})?")),
    "open government": (("ogl", 2, 0.85, rf"open government {_L}(?: (?:version |v)?\d+(?: \d+)?)?"),),
    "waived all copyright": (("cc0", 1, 0.95, r"to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights"),),
    "cc0": (("cc0", 1, 0.9, rf"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: {_L})?"),),
    "creative commons": (
        ("cc0", 1, 0.95, r"creative commons (?:zero|cc0)(?: (?:v|version )?1 0)?(?: universal)?"),
        ("cc-by-nc-sa", 1, 0.95, rf"creative commons(?: public)?(?: {_L})? attribution non ?commercial share ?alike(?: \d+(?: \d+)?)?"), ("cc-by-nc-nd", 1, 0.95, rf"creative commons attribution non ?commercial no ?deriv(?:ative)?(?:work)?s(?: \d+(?: \d+)?)?"),
        ("cc-by-sa", 1, 0.95, r"creative commons attribution share ?alike(?: \d+(?: \d+)?)?(?: (?:international|unported|generic))?"), ("cc-by-nc", 1, 0.9, r"creative commons attribution non ?commercial(?: \d+(?: \d+)?)?"),
        ("cc-by-nd", 1, 0.95, r"creative commons attribution no ?deriv(?:ative)?s(?: \d+(?: \d+)?)?"), ("cc-by", 2, 0.85, r"creative commons attribution(?: \d+(?: \d+)?)?(?: (?:international|unported|generic))?"),
        ("creative-commons", 2, 0.75, rf"(?:licensed|released|published|available) under (?:a |the )?creative commons {_L}"), ("creative-commons", 3, 0.5, rf"creative commons(?: {_L})?"),
    ),
    "creativecommons": (
        ("cc-by-nc-sa", 1, 0.95, r"creativecommons org licenses by nc sa(?: \d \d)?"), ("cc-by-nc-nd", 1, 0.95, r"creativecommons org licenses by nc nd(?: \d \d)?"), ("cc-by-nc", 1, 0.9, r"creativecommons org licenses by nc(?: \d \d)?"),
        ("cc-by-sa", 1, 0.95, r"creativecommons org licenses by sa(?: \d \d)?"), ("cc-by-nd", 1, 0.95, r"creativecommons org licenses by nd(?: \d \d)?"), ("cc-by", 2, 0.85, r"creativecommons org licenses by(?: \d \d)?"),
        ("cc0", 1, 0.95, r"creativecommons org publicdomain zero(?: \d \d)?"),
    ),
    "cc by": (
        ("cc-by-nc-sa", 1, 0.9, r"cc by nc sa(?: \d \d)?"), ("cc-by-nc-nd", 1, 0.9, r"cc by nc nd(?: \d \d)?"), ("cc-by-nc", 2, 0.85, r"cc by nc(?: \d \d)?"),
        ("cc-by-sa", 1, 0.9, r"cc by sa(?: \d \d)?"), ("cc-by-nd", 1, 0.9, r"cc by nd(?: \d \d)?"), ("cc-by", 2, 0.8, r"cc by(?: \d \d)?"),
    ),
    # reserved rights
    "proprietary": (("proprietary", 1, 0.9, r"(?:this (?:software|file|document) (?:is|contains) )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"), ("proprietary", 2, 0.8, rf"proprietary (?:software )?{_L}|proprietary software")),
    "unauthori": (("proprietary", 1, 0.9, r"unauthori[sz]ed (?:copying|use|reproduction|distribution|redistribution)(?: or (?:copying|use|reproduction|distribution))? of this (?:file|software|document|work)"),),
    "end user": (("proprietary", 2, 0.8, rf"end user {_L}(?: agreement)?"),),
    "commercial license": (("proprietary", 3, 0.5, r"commercial license"),),
    "commercial licence": (("proprietary", 3, 0.5, r"commercial licence"),),
    "all rights reserved": (("all-rights-reserved", 3, 0.4, r"all rights reserved"),),
    "spdx": tuple(
        (label, 1, 0.99, rf"spdx license identifier {spdx}(?: only| or later)?")
        for label, spdx in (
            ("mit", "mit"), ("x11", "x11"), ("apache", r"apache 2 0"), ("gpl", r"gpl \d 0"), ("lgpl", r"lgpl \d \d"), ("agpl", r"agpl \d 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
            ("bsd-4-clause", "bsd 4 clause"), ("0bsd", "0bsd"), ("mpl", r"mpl \d \d"), ("epl", r"epl \d 0"), ("cddl", r"cddl 1 \d"), ("eupl", r"eupl 1 \d"), ("isc", "isc"), ("zlib", "zlib"), ("boost", "bsl 1 0"), ("bsl", "busl 1 1"),
            ("artistic", r"artistic \d 0"), ("python", r"(?:psf 2 0|python 2 0)"), ("ruby", "ruby"), ("php", r"php 3 0\d?"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ofl", "ofl 1 1"), ("odbl", "odbl 1 0"), ("osl", r"osl \d \d"),
            ("afl", r"afl \d \d"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("cecill", r"cecill \S+"), ("fdl", r"gfdl 1 \d"), ("cc0", "cc0 1 0"), ("cc-by-sa", r"cc by sa \d \d"), ("cc-by-nc", r"cc by nc \d \d"), ("cc-by-nd", r"cc by nd \d \d"),
            ("cc-by", r"cc by \d \d"), ("cc-by-nc-sa", r"cc by nc sa \d \d"), ("cc-by-nc-nd", r"cc by nc nd \d \d"), ("sspl", "sspl 1 0"), ("upl", "upl 1 0"), ("ncsa", "ncsa"), ("w3c", "w3c"), ("postgresql", "postgresql"),
            ("blueoak", r"blueoak 1 0 0"), ("mulan", r"mulanpsl \d 0"), ("json", "json"), ("openssl", "openssl"), ("vim", "vim"), ("lppl", r"lppl 1 \S+"),
        )
    ),
}
#: A text without any of these cannot match a rule or a base phrase: each keyword's rules need one of them.
GATE = ("licen", "gpl", "commons", "domain", "warrant", "granted", "redistribut", "gnu", "apache", "copyleft", "reserved", "spdx", "wtfpl", "eupl", "cddl", "cecill", "lppl", "odbl", "gfdl", "cc0", "bsd", "mozilla", "mulan",
        "substantial", "advertising", "endorse", "regents", "openssl", "misrepresent", "plainly", "altered", "perl", "ruby", "consortium", "package", "waived", "proprietary", "confidential", "unauthori")
#: Words that stand one after the other, where one alone says too little: a quick test and a pattern for each.
_PAIRS = (("cc", "cc{gap}by"), ("mpl", "mpl{gap}(?:v|was|[0-9])"), ("asl", "asl{gap}2"), ("want", r"the{gap}f\S+{gap}you{gap}want"), ("beer", "beer{gap}ware|me{gap}a{gap}beer"), ("evil", "not{gap}evil"))
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# every separator by itself: such a class is one table lookup a character
_SEPARATORS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{_SEPARATORS}]++"
GATE_PATTERNS = tuple((test, pattern.format(gap=f"[{_SEPARATORS}]+")) for test, pattern in _PAIRS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DETECTION = "struct<start:int,end:int,priority:int,label:string,weight:double>"


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, weight, keyword, pattern over words with single spaces between them)."""
    return [(label, priority, weight, keyword, pattern) for keyword, found in SIGNATURES.items() for label, priority, weight, pattern in found]


def _numbered(pattern: str) -> str:
    """The pattern over words with their numbers, " 0:first 1:second ", from the space before its first word."""
    return r" \d+:(?:{})(?= )".format(pattern.replace(" ?", "(?:\0)?").replace(" ", "\0").replace("\0", r" \d+:"))


def _detections(found: Column) -> Column:
    """(start, end, priority, label, weight) of each hit, in words: a hit begins with the number of its first word."""

    def one(rule: Column, hit: Column) -> Column:
        start = F.substring_index(F.substr(hit, F.lit(2)), ":", 1).cast("int")
        words = F.length(hit) - F.length(F.replace(hit, F.lit(":")))
        return F.struct(start.alias("start"), (-(start + words)).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"))

    return F.flatten(F.transform(found, lambda rule: F.transform(rule["hits"], lambda hit: one(rule, hit))))


def _found(plain: Column, numbered: Column, table: dict[str, tuple]) -> Column:
    """Rules with hits. Those of a keyword are tried where it stands."""

    def rule(label: str, priority: int, weight: float, pattern: str) -> Column:
        hits = F.regexp_extract_all(numbered, F.lit(_numbered(pattern)), F.lit(0))
        return F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(float(weight)).alias("weight"), hits.alias("hits"))

    tried = [F.when(F.contains(plain, F.lit(keyword)), F.array(*(rule(*r) for r in found))) for keyword, found in table.items()]
    return F.filter(F.flatten(F.filter(F.array(*tried), lambda x: x.isNotNull())), lambda x: F.size(x["hits"]) > 0)


def _suppressed(ordered: Column, worst: int) -> Column:
    """The detections, in order of start and length, without those inside another of the same or a better priority. What
    stays is gathered in parts of 256, so that a text of very many detections takes no quadratic copying."""
    reaches = [f"p{p}" for p in range(1, worst + 1)]
    none = F.array().cast(f"array<{_DETECTION}>")

    def keep(acc: Column, d: Column) -> Column:
        covered = F.lit(-1)
        for p, name in enumerate(reaches, 1):
            covered = F.when(d["priority"] >= p, F.greatest(covered, acc[name])).otherwise(covered)
        reach = [F.when(d["priority"] == p, F.greatest(acc[name], -d["back"])).otherwise(acc[name]).alias(name) for p, name in enumerate(reaches, 1)]
        one = F.array(F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight")))
        return F.struct(*reach, F.when(covered >= -d["back"], acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"), acc["done"].alias("done"))

    def part(acc: Column, k: Column) -> Column:
        start = F.struct(*(acc[name].alias(name) for name in reaches), none.alias("out"), F.concat(acc["done"], F.array(acc["out"])).alias("done"))
        return F.aggregate(F.slice(ordered, k * 256 + 1, F.lit(256)), start, keep)

    start = F.struct(*(F.lit(-1).alias(name) for name in reaches), none.alias("out"), F.array().cast(f"array<array<{_DETECTION}>>").alias("done"))
    parts = F.sequence(F.lit(0), F.expr("(size(ordered) - 1) div 256").cast("int"))
    return F.aggregate(parts, start, part, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["out"]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words: runs of a-z, 0-9 and all characters from U+0080, A-Z lower-cased. Base places are where the words of a base
    phrase stand one after the other. Rules in order of priority: a detection inside another of the same or a better
    priority is suppressed. labels: those of the detections that stay, and base_labels (both distinct, sorted,
    comma-joined; empty if none). score: the largest weight of a detection that stays (base places count 0.5), else 0.
    Null text counts as empty; first_word and last_word are null without a base place. Rows are read one by one: a null
    id is returned as it is, repeated rows give a row each, an empty table gives an empty one.
    """
    low = F.lower("text")  # more than A-Z, which lets no text through less
    gate = F.lit(False)
    for test, pattern in GATE_PATTERNS:
        gate = (F.contains(low, F.lit(test)) & F.rlike(low, F.lit(pattern))) | gate
    for keyword in reversed(GATE):
        gate = F.contains(low, F.lit(keyword)) | gate
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(gate, F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))).alias("words"))
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    numbers = F.transform("words", lambda w, i: F.concat(i.cast("string"), F.lit(":"), w))
    joined = rows.select("doc_id", "n_words", F.when(F.size("words") > 0, spaced("words")).alias("plain"), F.when(F.size("words") > 0, spaced(numbers)).alias("numbered"))
    plain, numbered = F.col("plain"), F.col("numbered")
    base = {phrase: ((label, 9, 0.5, phrase),) for phrase, label in BASE}
    found = joined.select(
        "doc_id", "n_words", F.when(plain.isNotNull(), F.array_sort(_detections(_found(plain, numbered, SIGNATURES)))).alias("ordered"),
        F.when(plain.isNotNull(), _detections(_found(plain, numbered, base))).alias("base"))
    worst = max(priority for _, priority, _, _, _ in rules())
    out = found.select("doc_id", "n_words", F.when(F.size("ordered") > 0, _suppressed(F.col("ordered"), worst)).otherwise(F.array().cast(f"array<{_DETECTION}>")).alias("detections"), "base")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.col("base.label"))), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("detections.label"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        "detections")
