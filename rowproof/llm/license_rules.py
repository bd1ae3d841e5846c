"""Signature rules of the license scan: ordered (label, priority, confidence, keyword, pattern).

Patterns run over text whose words are joined by single spaces, with a space before the first and after the
last one (punctuation is gone, so "GPL-3.0" is "gpl 3 0").  NAMES are hand-written names of licenses; FORMS
reads each as a name, a tag and a reference.  NOTICES are hand-written signatures of the sentences by which
license texts and notices are known though they need not name the license.
"""

from __future__ import annotations

# The base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: (label, keyword that any match must hold at the start of a word, pattern of the name).
NAMES = [
    ("gpl-1.0", "gpl", r"gpl v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl v?3(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "general public", r"gnu general public license v(?:ersion )?1"),
    ("gpl-2.0", "general public", r"gnu general public license (?:v|version )2(?: 0)?"),
    ("gpl-3.0", "general public", r"gnu general public license (?:v|version )3(?: 0)?"),
    ("lgpl-2.0", "lgpl", r"lgpl v?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "general public", r"gnu (?:lesser|library) general public license(?: (?:v|version )\d(?: \d)?)?"),
    ("agpl-3.0", "agpl", r"agpl v?3(?: 0)?(?: only| or later)?"),
    ("agpl", "general public", r"gnu affero general public license(?: (?:v|version )\d)?"),
    ("gfdl", "free documentation", r"gnu free documentation license(?: version \d(?: \d)?)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:v|version )1(?: 1)?"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:license )?(?:v|version )?2(?: 0)?"),
    ("mit-0", "mit 0", r"mit 0"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("mit-x11", "x11", r"(?:mit )?x11 (?:license|style)"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|free bsd)(?: license)?"),
    ("bsd-2-clause", "freebsd", r"freebsd(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("bsd-0-clause", "bsd", r"(?:bsd 0 clause|zero clause bsd)(?: license)?"),
    ("bsd-0-clause", "0bsd", r"0bsd(?: license)?"),
    ("bsd", "bsd", r"bsd (?:style )?license"),
    ("isc", "isc license", r"isc license"),
    ("mpl-1.1", "mpl", r"mpl v?1 [01]"),
    ("mpl-2.0", "mpl", r"mpl v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:v|version )?1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: (?:v|version )?2(?: 0)?)?"),
    ("epl-1.0", "epl", r"epl v?1(?: 0)?"),
    ("epl-2.0", "epl", r"epl v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse (?:public|distribution) license(?: (?:v|version )?\d(?: 0)?)?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl-1.0", "common development", r"common development and distribution license"),
    ("cpl-1.0", "common public", r"common public license(?: (?:v|version )?1 0)?"),
    ("eupl", "eupl", r"eupl(?: v?1 [012])?"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("artistic-1.0", "artistic", r"artistic license(?: (?:v|version )?1(?: 0)?)?"),
    ("artistic-2.0", "artistic", r"artistic license (?:v|version )?2(?: 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license(?: version 2)?"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:v|version )?1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source license(?: 1 1)?"),
    ("unlicense", "unlicense", r"the unlicense|unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v?2)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", r"creative commons zero(?: v?1 0)?"),
    ("cc-by-1.0", "cc by", r"cc by 1 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 [05]"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-pd", "creative commons", r"creative commons public domain mark"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odbl", "open database", r"open database license"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "open data commons", r"open data commons public domain"),
    ("ogl-uk", "open government", r"open government licen[cs]e(?: v?[123](?: 0)?)?"),
    ("etalab", "etalab", r"(?:licence )?etalab(?: 2 0)?"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: (?:v|version )?1 1)?"),
    ("ofl-1.1", "ofl 1", r"ofl 1 [01]"),
    ("psf-2.0", "python", r"python software foundation license(?: version 2)?"),
    ("python-2.0", "python", r"python license(?: 2 0)?"),
    ("ruby", "ruby", r"ruby license"),
    ("php-3.01", "php", r"php license(?: 3 0(?: 1)?)?"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license"),
    ("vim", "vim license", r"vim license"),
    ("zpl-2.1", "zope", r"zope public license(?: 2 [01])?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("afl-3.0", "academic", r"academic free license(?: (?:v|version )?[123](?: [01])?)?"),
    ("osl-3.0", "open software", r"open software license(?: (?:v|version )?[123](?: [01])?)?"),
    ("ecl-2.0", "educational", r"educational community license(?: (?:v|version )?2 0)?"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: v?[12](?: [01])?)?"),
    ("lppl", "latex project", r"latex project public license(?: 1 [0-3][abc]?)?"),
    ("qpl-1.0", "q public", r"q public license(?: 1 0)?"),
    ("sspl-1.0", "server side", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license(?: (?:v|version )?2(?: 0)?)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) license"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    ("openrail", "openrail", r"(?:big ?science |big ?code |creativeml )?openrail(?: [ms])?(?: license)?"),
    ("openrail", "open rail", r"(?:big ?science |big ?code |creativeml )?open rail(?: [ms])?(?: license)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("curl", "curl license", r"curl license"),
    ("ntp", "ntp license", r"ntp license"),
    ("beerware", "beerware", r"beerware(?: license)?"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: 1 0)?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)(?: v?[12])?"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("tous-droits-reserves", "tous droits", r"tous droits réservés"),
    ("alle-rechte", "alle rechte", r"alle rechte vorbehalten"),
    ("todos-los-derechos", "todos los derechos", r"todos los derechos reservados"),
]

#: (label, keyword, pattern) of sentences in license texts and notices.
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-x11", "except as contained", r"except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", "the software shall be used", r"the software shall be used for good not evil"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unicode", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("upl-1.0", "subject to the condition", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: subject to the limitations in the disclaimer below)? provided that the following conditions are met"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("ncsa", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("bsd-3-clause", "neither the name", r"neither the names? of (?:[^ ]+ ){1,10}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", "this software is provided by", r"this software is provided by (?:the )?(?:[^ ]+ ){1,6}as is and any express or implied warranties including but not limited to the implied warranties"),
    ("isc", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-0-clause", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("w3c", "permission to copy modify", r"permission to copy modify and distribute this (?:software|work)(?: and its documentation)? with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("apache-2.0", "licensed under the apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated)"),
    ("apache-2.0", "licensed to the apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-2.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl-3.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("gpl-1.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 1"),
    ("lgpl-2.1", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1"),
    ("lgpl-3.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3"),
    ("lgpl-2.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("agpl-3.0", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3"),
    ("gpl-2.0", "the licenses for most software", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the gnu general public license is", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "the gnu affero general", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3.0", "this version of the gnu lesser", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "if you modify the program", r"if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl", "this program comes with", r"this program comes with absolutely no warranty"),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file", r"the contents of this file are (?:subject to|used with permission under) the mozilla public license(?: version)? 1 1"),
    ("epl", "this program and the accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "the accompanying program", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "the accompanying program", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", "the contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "this is free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "in no event will the authors", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("wtfpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("beerware", "as long as you retain", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", "to the extent possible", r"to the extent possible under law (?:[^ ]+ ){1,10}waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "the person who associated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", "the work as defined below", r"the work as defined below is provided under the terms of this creative commons public license"),
    ("cc-by-sa", "you are free to share", r"you are free to share (?:[^ ]+ ){1,30}under the same license as the original"),
    ("ofl-1.1", "this font software is licensed", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "the fonts including any derivative", r"the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("psf-2.0", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test"),
    ("php-3.01", "products derived from this software may not be called", r"products derived from this software may not be called php"),
    ("openssl", "this product includes software developed by the openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic", r"this product includes cryptographic software written by eric young"),
    ("artistic-1.0", "the intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "this license establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ruby", "you may make and give away", r"you may make and give away verbatim copies of the source form of (?:the|this) software without restriction"),
    ("ms-pl", "this license governs use", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", "this european union public", r"this european union public licence the eupl applies to the work"),
    ("lppl", "this work may be distributed", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cecill", "ce logiciel est régi", r"ce logiciel est régi par la licence cecill"),
    ("mulan", "you can use this software according", r"you can use this software according to the terms and conditions of the mulan psl v[12]"),
    ("odbl", "made available under the open database", r"is made available under the open database license"),
    ("ijg", "this software is based in part", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "portions of this software are copyright", r"portions of this software are copyright (?:[^ ]+ ){1,6}the freetype project"),
    ("sspl-1.0", "if you make the functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "the licensor hereby grants", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the grant of rights", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", "the licensor grants you", r"the licensor grants you a copyright license for the software to do everything you might do with the software"),
    ("openrail", "you agree not to use", r"you agree not to use the model or derivatives of the model"),
    ("non-commercial", "for non commercial use", r"for non commercial use only"),
    ("non-commercial", "for personal use", r"for personal use only"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("all-rights-reserved", "no part of this", r"no part of this (?:publication|book|document|work) may be reproduced"),
]

#: (priority, confidence, pattern around a name); a higher priority wins over what it contains.
FORMS = [
    (1, 0.8, r"{}"),
    (3, 1.0, r"spdx license identifier (?:{})"),
    (2, 0.95, r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{})"),
]


def rules() -> list[tuple[str, int, float, str, str]]:
    """Base phrases first (priority 0), then every name in every form, then the notices (priority 4)."""
    base = [(label, 0, 0.9, phrase, phrase) for phrase, label in BASE]
    return base + [(label, prio, conf, key, form.format(name)) for prio, conf, form in FORMS for label, key, name in NAMES] + [(label, 4, 1.0, key, pattern) for label, key, pattern in NOTICES]
