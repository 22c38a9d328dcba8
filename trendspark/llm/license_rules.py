"""The signature rules of the license scan, in order: the first of two equals wins.

A rule is a regular expression over normalised words (lower case, one blank between words,
punctuation gone: "Version 2.0" is "version 2 0"), a keyword that every match contains as a word
(the prefilter; a form without the keyword of the others is a rule of its own), a label, a priority and a
confidence. NAMES are license names, each with the three phrasings that name a license; NOTICES are over 200
rules written for themselves: sentences and headers of licenses, rarer names, notices of ownership.

Expressions use only groups, alternatives, ``?`` and ``[..]``, never look-arounds, so that any
regular expression engine gives the same matches.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LicenseRule:
    keyword: str
    pattern: str
    label: str
    priority: int  # 3: a grant or an identifier, 2: a name with its version, 1: a bare name or notice
    confidence: float


#: The phrases whose places the base counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, the word that each form contains, the name's forms, the version's forms ("" if the name has none)
NAMES = (
    ("mit", "mit", "(?:the )?mit(?: x11)? licen[sc]e", ""),
    ("mit", "expat", "(?:the )?expat(?: x11)? licen[sc]e", ""),
    ("apache", "apache", "(?:the )?apache (?:software )?licen[sc]e", ""),
    ("apache-1.0", "apache", "(?:the )?apache (?:software )?licen[sc]e", "1 0"),
    ("apache-1.1", "apache", "(?:the )?apache (?:software )?licen[sc]e", "1 1"),
    ("apache-2.0", "apache", "(?:the )?apache (?:software )?licen[sc]e", "2(?: 0)?"),
    ("gpl", "general", "(?:the )?(?:gnu )?general public licen[sc]e", ""),
    ("gpl-1.0", "general", "(?:the )?(?:gnu )?general public licen[sc]e", "1(?: 0)?"),
    ("gpl-2.0", "general", "(?:the )?(?:gnu )?general public licen[sc]e", "2(?: 0)?"),
    ("gpl-3.0", "general", "(?:the )?(?:gnu )?general public licen[sc]e", "3(?: 0)?"),
    ("lgpl", "general", "(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e", ""),
    ("lgpl-2.0", "general", "(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e", "2(?: 0)?"),
    ("lgpl-2.1", "general", "(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e", "2 1"),
    ("lgpl-3.0", "general", "(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e", "3(?: 0)?"),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public licen[sc]e", ""),
    ("agpl-3.0", "affero", "(?:the )?(?:gnu )?affero general public licen[sc]e", "3(?: 0)?"),
    ("gfdl", "documentation", "(?:the )?(?:gnu )?free documentation licen[sc]e", ""),
    ("gfdl-1.2", "documentation", "(?:the )?(?:gnu )?free documentation licen[sc]e", "1 2"),
    ("gfdl-1.3", "documentation", "(?:the )?(?:gnu )?free documentation licen[sc]e", "1 3"),
    ("bsd", "bsd", "(?:the )?(?:new |modified |simplified )?bsd licen[sc]e", ""),
    ("bsd-2-clause", "bsd", "(?:the )?(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[sc]e)?", ""),
    ("bsd-2-clause", "freebsd", "(?:the )?freebsd(?: licen[sc]e)?", ""),
    ("bsd-3-clause", "bsd", "(?:the )?(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd)(?: licen[sc]e)?", ""),
    ("bsd-4-clause", "bsd", "(?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?", ""),
    ("isc", "isc", "(?:the )?isc licen[sc]e", ""),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[sc]e", ""),
    ("mpl", "mozilla", "(?:the )?mozilla public licen[sc]e", ""),
    ("mpl-1.1", "mozilla", "(?:the )?mozilla public licen[sc]e", "1 1"),
    ("mpl-2.0", "mozilla", "(?:the )?mozilla public licen[sc]e", "2(?: 0)?"),
    ("epl", "eclipse", "(?:the )?eclipse public licen[sc]e", ""),
    ("epl-1.0", "eclipse", "(?:the )?eclipse public licen[sc]e", "1(?: 0)?"),
    ("epl-2.0", "eclipse", "(?:the )?eclipse public licen[sc]e", "2(?: 0)?"),
    ("eupl", "european", "(?:the )?european union public licen[sc]e", ""),
    ("eupl-1.2", "european", "(?:the )?european union public licen[sc]e", "1 2"),
    ("cddl", "common", "(?:the )?common development and distribution licen[sc]e", ""),
    ("cpl", "common", "(?:the )?common public licen[sc]e", ""),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic licen[sc]e", ""),
    ("artistic-2.0", "artistic", "(?:the )?(?:perl )?artistic licen[sc]e", "2(?: 0)?"),
    ("bsl", "boost", "(?:the )?boost software licen[sc]e", ""),
    ("bsl-1.0", "boost", "(?:the )?boost software licen[sc]e", "1(?: 0)?"),
    ("psf", "python", "(?:the )?python software foundation licen[sc]e", ""),
    ("php", "php", "(?:the )?php licen[sc]e", ""),
    ("ofl", "font", "(?:the )?(?:sil )?open font licen[sc]e", ""),
    ("ofl-1.1", "font", "(?:the )?(?:sil )?open font licen[sc]e", "1 1"),
    ("odbl", "database", "(?:the )?open (?:data commons )?(?:open )?database licen[sc]e", ""),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl(?: licen[sc]e)?", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("ms-pl", "microsoft", "(?:the )?microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft", "(?:the )?microsoft reciprocal licen[sc]e", ""),
    ("osl", "open", "(?:the )?open software licen[sc]e", ""),
    ("openssl", "openssl", "(?:the )?openssl licen[sc]e", ""),
    ("proprietary", "proprietary", "(?:a |the )?proprietary licen[sc]e", ""),
    ("commercial", "commercial", "(?:a |the )?commercial licen[sc]e", ""),
    ("cc", "creative", "(?:a |the )?creative commons(?: licen[sc]e)?", ""),
    ("cc0", "cc0", "(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?", ""),
    *((f"cc-{k}", "cc", f"(?:the )?cc {k.replace('-', ' ')}(?: licen[sc]e)?", "") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    *((f"cc-{k}-{v[0]}.0", "cc", f"(?:the )?cc {k.replace('-', ' ')}", f"{v[0]} 0") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3", "4")),
    ("cc-by", "attribution", "(?:the |a )?creative commons attribution", ""),
    ("cc-by-sa", "sharealike", "(?:the |a )?creative commons attribution sharealike", ""),
    ("cc-by-nc", "noncommercial", "(?:the |a )?creative commons attribution noncommercial", ""),
    ("cc-by-nc", "commercial", "(?:the |a )?creative commons attribution non commercial", ""),
)

#: phrasing with {name}, priority, confidence
PHRASINGS = (
    ("(?:is |are )?(?:dual )?(?:licensed|released|distributed|available|published|provided|made available) under (?:the terms of )?{name}", 3, 0.95),
    ("under the (?:terms|conditions|terms and conditions) of {name}", 3, 0.9),
    ("{name}", 1, 0.6),
)

#: Identifiers (after "spdx license identifier") and the labels that they stand for.
IDENTIFIERS = ("mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "mpl-2.0", "epl-2.0", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "unlicense", "bsl-1.0", "ofl-1.1")

#: Sentences and notices: keyword, pattern, label, priority, confidence.
NOTICES = (
    ("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 3, 0.95),
    ("permission", "permission to use copy modify and or distribute this software for any purpose", "isc", 3, 0.95),
    ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 3, 0.95),
    ("redistribute", "you (?:can|may) redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "gpl", 3, 0.95),
    ("redistribute", "you (?:can|may) redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", "lgpl", 3, 0.95),
    ("public", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public-domain", 3, 0.9),
    ("public", "(?:is |in )?(?:in )?the public domain", "public-domain", 1, 0.5),
    ("warranty", "without warranty of any kind", "warranty-disclaimer", 1, 0.4),
    ("warranties", "without warranties or conditions of any kind", "apache", 1, 0.6),
    ("reserved", "all rights reserved", "all-rights-reserved", 1, 0.5),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright-notice", 1, 0.3),
    ("permission", "(?:not|no part) (?:be )?(?:reproduced|copied) without (?:the )?(?:prior )?(?:written )?permission", "all-rights-reserved", 2, 0.7),
    ("confidential", "confidential and proprietary", "proprietary", 2, 0.7),
    ("noncommercial", "for noncommercial use only", "non-commercial", 2, 0.7),
    ("commercial", "for non commercial use only", "non-commercial", 2, 0.7),
    ("personal", "for personal use only", "non-commercial", 2, 0.6),
    ("license", "see the license file", "unknown-license-reference", 1, 0.3),
    # sentences of permissive licenses
    ("permission", "the above copyright notice and this permission notice (?:shall|must) be included in all copies", "mit", 3, 0.9),
    ("restriction", "to deal in the software without restriction subject to the above copyright notice", "mit", 2, 0.7),
    ("noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", "mit", 2, 0.7),
    ("provided", "the software is provided as is without warranty of any kind express or implied", "mit", 2, 0.8),
    ("liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "mit", 3, 0.85),
    ("permission", "permission to use copy modify and distribute this software and its documentation for any purpose", "hpnd", 3, 0.9),
    ("permission", "permission to use copy modify distribute and sell this software and its documentation for any purpose", "hpnd", 3, 0.9),
    ("supporting", "both that copyright notice and this permission notice appear in supporting documentation", "hpnd", 3, 0.85),
    ("advertising", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "hpnd", 3, 0.85),
    ("fee", "permission is hereby granted without written agreement and without license or royalty fee", "mit-modern", 3, 0.9),
    ("restriction", "permission is hereby granted to use or copy this program for any purpose without restriction", "boehm-gc", 3, 0.85),
    ("retained", "provided the above notices are retained on all copies and copyright notice is kept", "boehm-gc", 2, 0.7),
    ("source", "redistributions of source code must retain the above copyright notice", "bsd", 3, 0.9),
    ("binary", "redistributions in binary form must reproduce the above copyright notice", "bsd", 3, 0.9),
    ("contributors", "neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd-3-clause", 3, 0.95),
    ("contributors", "neither the name of the (?:author|organization|project|university) nor the names of (?:its|any) contributors may be used without specific prior written permission", "bsd-3-clause", 3, 0.9),
    ("endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", 3, 0.85),
    ("advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "bsd-4-clause", 3, 0.95),
    ("copyright", "this software is provided by the copyright holders and contributors as is", "bsd", 3, 0.8),
    ("regents", "copyright (?:c )?the regents of the university of california all rights reserved", "bsd", 3, 0.85),
    ("regents", "the regents of the university of california", "bsd", 1, 0.5),
    ("misrepresented", "the origin of this software must not be misrepresented", "zlib", 3, 0.9),
    ("altered", "altered source versions must be plainly marked as such", "zlib", 3, 0.9),
    ("warranty", "this software is provided as is without any express or implied warranty", "zlib", 2, 0.75),
    ("liable", "in no event will the authors be held liable for any damages arising from the use of this software", "zlib", 3, 0.85),
    ("granted", "permission is granted to anyone to use this software for any purpose including commercial applications", "zlib", 3, 0.9),
    ("isc", "the software is provided as is and isc disclaims all warranties", "isc", 3, 0.9),
    ("author", "the software is provided as is and the author disclaims all warranties", "isc", 3, 0.9),
    ("obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy", "bsl-1.0", 3, 0.95),
    ("machine", "solely in the form of machine executable object code generated by a source language processor under this license", "bsl-1.0", 3, 0.9),
    ("verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", 3, 0.9),
    ("want", "you just do what the fuck you want to public license", "wtfpl", 3, 0.9),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", 3, 0.95),
    ("jurisdictions", "in jurisdictions that recognize copyright laws", "unlicense", 3, 0.85),
    ("dedicate", "dedicate any and all copyright interest in the software to the public domain", "unlicense", 3, 0.9),
    ("beer", "if we meet some day and you think this stuff is worth it you can buy me a beer under this license", "beerware", 3, 0.9),
    ("beerware", "(?:the )?beerware license", "beerware", 2, 0.8),
    ("beer", "(?:the )?beer ware license", "beerware", 2, 0.8),
    ("good", "the software shall be used for good not evil", "json", 3, 0.9),
    ("json", "(?:the )?json license", "json", 1, 0.6),
    ("curl", "(?:the )?curl license", "curl", 1, 0.6),
    ("libpng", "(?:the )?libpng license", "libpng", 1, 0.6),
    ("ncsa", "(?:the )?(?:university of illinois )?ncsa (?:open source )?license", "ncsa", 2, 0.8),
    ("x11", "(?:the )?x11 license", "x11", 1, 0.6),
    ("ntp", "(?:the )?ntp license", "ntp", 1, 0.6),
    ("postgresql", "(?:the )?postgresql license", "postgresql", 1, 0.6),
    ("ruby", "(?:the )?ruby license", "ruby", 1, 0.6),
    ("vim", "(?:the )?vim license", "vim", 1, 0.6),
    ("w3c", "(?:the )?w3c (?:software )?(?:notice and )?license", "w3c", 2, 0.8),
    ("unicode", "(?:the )?unicode license agreement", "unicode", 2, 0.8),
    ("icu", "(?:the )?icu license", "icu", 1, 0.6),
    ("blessing", "may you do good and not evil in place of a copyright notice here is a blessing", "blessing", 3, 0.9),
    # sentences of the apache licenses
    ("compliance", "you may not use this file except in compliance with the license", "apache-2.0", 3, 0.9),
    ("unless", "unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0", 3, 0.95),
    ("governing", "see the license for the specific language governing permissions and limitations under the license", "apache-2.0", 3, 0.95),
    ("contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2.0", 3, 0.95),
    ("notice", "see the notice file distributed with this work for additional information regarding copyright ownership", "apache-2.0", 3, 0.95),
    ("irrevocable", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2.0", 3, 0.9),
    ("patent", "a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", "apache-2.0", 3, 0.9),
    ("derivative", "to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work", "apache-2.0", 3, 0.85),
    ("foundation", "this product includes software developed by the apache software foundation under license", "apache-1.1", 2, 0.8),
    ("apache", "the names apache and apache software foundation must not be used to endorse or promote products without prior written permission", "apache-1.1", 3, 0.9),
    # sentences of the gnu licenses
    ("either", "as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2.0-or-later", 3, 0.95),
    ("either", "as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0-or-later", 3, 0.95),
    ("foundation", "as published by the free software foundation version 2 of the license", "gpl-2.0", 3, 0.9),
    ("foundation", "as published by the free software foundation version 3 of the license", "gpl-3.0", 3, 0.9),
    ("useful", "in the hope that it will be useful but without any warranty", "gpl", 2, 0.8),
    ("implied", "without even the implied warranty of merchantability or fitness for a particular purpose", "gpl", 2, 0.75),
    ("received", "you should have received a copy of the gnu general public license along with this program", "gpl", 3, 0.9),
    ("received", "you should have received a copy of the gnu lesser general public license along with this library", "lgpl", 3, 0.9),
    ("received", "you should have received a copy of the gnu library general public license along with this library", "lgpl-2.0", 3, 0.9),
    ("received", "you should have received a copy of the gnu affero general public license along with this program", "agpl-3.0", 3, 0.9),
    ("boston", "write to the free software foundation inc 51 franklin street fifth floor boston ma for a copy of the license", "gpl-2.0", 2, 0.8),
    ("redistribute", "this program is free software you can redistribute it and or modify it", "gpl", 2, 0.8),
    ("redistribute", "this library is free software you can redistribute it and or modify it", "lgpl", 2, 0.8),
    ("changing", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gnu", 3, 0.9),
    ("share", "the licenses for most software are designed to take away your freedom to share and change it", "gpl-2.0", 3, 0.9),
    ("copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3.0", 3, 0.95),
    ("affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works", "agpl-3.0", 3, 0.95),
    ("remote", "interacting with it remotely through a computer network remote users must be offered the source under this license", "agpl-3.0", 3, 0.85),
    ("exception", "as a special exception the copyright holders give you permission to link this library", "gpl-linking-exception", 3, 0.85),
    ("classpath", "(?:with )?(?:the )?classpath exception to the license", "gpl-classpath-exception", 3, 0.85),
    ("openssl", "permission to link the code of portions of this program with the openssl library", "gpl-openssl-exception", 3, 0.9),
    ("autoconf", "this configure script is free software with the autoconf exception and unlimited permission to copy", "gpl-autoconf-exception", 3, 0.85),
    ("gcc", "gcc runtime library exception (?:version 3 1 )?to the license", "gcc-runtime-exception", 3, 0.9),
    ("invariant", "permission is granted to copy distribute and or modify this document with no invariant sections", "gfdl", 3, 0.9),
    ("document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 3, 0.95),
    ("cover", "with no invariant sections no front cover texts and no back cover texts a copy of the license is included", "gfdl", 3, 0.95),
    ("copying", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice", "fsf-all-permissive", 3, 0.95),
    # sentences of reciprocal licenses of files and libraries
    ("source", "this source code form is subject to the terms of the mozilla public license", "mpl-2.0", 3, 0.95),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one under the license", "mpl-2.0", 3, 0.9),
    ("incompatible", "this source code form is incompatible with secondary licenses", "mpl-2.0-no-copyleft-exception", 3, 0.95),
    ("contents", "the contents of this file are subject to the mozilla public license", "mpl", 3, 0.9),
    ("contents", "the contents of this file are subject to the netscape public license", "npl", 3, 0.9),
    ("contents", "the contents of this file are subject to the common public attribution license", "cpal-1.0", 3, 0.9),
    ("contents", "the contents of this file are subject to the terms of the common development and distribution license", "cddl", 3, 0.95),
    ("accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 3, 0.95),
    ("accompanying", "this program and the accompanying materials are made available under the terms of the common public license", "cpl", 3, 0.95),
    ("secondary", "this source code may also be made available under the following secondary licenses", "epl-2.0", 3, 0.85),
    ("recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement and license", "epl", 3, 0.8),
    ("ibm", "(?:the )?ibm public license", "ipl", 2, 0.8),
    ("apple", "(?:the )?apple public source license", "apsl", 2, 0.8),
    ("sun", "(?:the )?sun public license", "spl", 2, 0.8),
    ("q", "(?:the )?q public license", "qpl", 2, 0.8),
    ("sleepycat", "(?:the )?sleepycat license", "sleepycat", 2, 0.8),
    ("zope", "(?:the )?zope public license", "zpl", 2, 0.8),
    ("latex", "(?:the )?latex project public license", "lppl", 2, 0.8),
    ("academic", "(?:the )?academic free license", "afl", 2, 0.8),
    ("cecill", "(?:the )?cecill(?: b| c)? (?:free software )?license", "cecill", 2, 0.8),
    ("upl", "(?:the )?universal permissive license upl", "upl-1.0", 2, 0.8),
    ("mulan", "(?:the )?mulan permissive software license", "mulanpsl", 2, 0.8),
    ("nasa", "(?:the )?nasa open source (?:agreement )?license", "nasa", 2, 0.8),
    ("intel", "(?:the )?intel open source license", "intel", 2, 0.8),
    ("reciprocal", "(?:the )?reciprocal public license", "rpl", 2, 0.8),
    ("simple", "(?:the )?simple public license", "simpl", 2, 0.8),
    ("attribution", "(?:the )?attribution assurance license", "aal", 2, 0.8),
    ("fair", "(?:the )?fair license", "fair", 1, 0.5),
    ("nokia", "(?:the )?nokia open source license", "nokia", 2, 0.8),
    ("realnetworks", "(?:the )?realnetworks public source license", "rpsl", 2, 0.8),
    ("sybase", "(?:the )?sybase open watcom public license", "watcom", 2, 0.8),
    ("vovida", "(?:the )?vovida software license", "vsl", 2, 0.8),
    ("wxwindows", "(?:the )?wxwindows library licen[sc]e", "wxwindows", 2, 0.8),
    ("elastic", "(?:the )?elastic license", "elastic", 2, 0.8),
    ("server", "(?:the )?server side public license", "sspl", 2, 0.85),
    ("business", "(?:the )?business source license", "busl", 2, 0.85),
    ("commons", "commons clause license condition", "commons-clause", 3, 0.9),
    ("prosperity", "(?:the )?prosperity public license", "prosperity", 2, 0.8),
    ("polyform", "(?:the )?polyform (?:noncommercial|small business|shield) license", "polyform", 2, 0.8),
    ("hippocratic", "(?:the )?hippocratic license", "hippocratic", 2, 0.8),
    ("cryptographic", "(?:the )?cryptographic autonomy license", "cal", 2, 0.8),
    ("etalab", "(?:the )?etalab open license", "etalab", 2, 0.8),
    ("government", "(?:the )?open government licen[sc]e", "ogl", 2, 0.8),
    ("gaming", "(?:the )?open gaming license", "ogl-gaming", 2, 0.8),
    ("dataset", "this dataset is made available under the open data commons attribution license", "odc-by", 3, 0.9),
    ("pddl", "(?:the )?public domain dedication and license pddl", "pddl", 3, 0.9),
    ("community", "(?:the )?community data license agreement", "cdla", 2, 0.85),
    ("llama", "(?:the )?llama (?:2 |3 )?community license", "llama", 2, 0.85),
    ("openrail", "(?:the )?(?:creativeml |bigscience )?openrail(?: m)? license", "openrail", 2, 0.85),
    # content licenses
    ("attribution", "this work is licensed under a creative commons attribution", "cc-by", 3, 0.9),
    ("sharealike", "this work is licensed under a creative commons attribution sharealike", "cc-by-sa", 3, 0.92),
    ("noderivatives", "(?:creative commons )?attribution noderivatives (?:international )?license", "cc-by-nd", 3, 0.9),
    ("noncommercial", "(?:creative commons )?attribution noncommercial (?:international )?license", "cc-by-nc", 3, 0.9),
    ("noncommercial", "(?:creative commons )?attribution noncommercial sharealike (?:international )?license", "cc-by-nc-sa", 3, 0.92),
    ("noncommercial", "(?:creative commons )?attribution noncommercial noderivatives (?:international )?license", "cc-by-nc-nd", 3, 0.92),
    ("waived", "has waived all copyright and related or neighboring rights", "cc0", 3, 0.9),
    ("extent", "to the extent possible under law the author has dedicated all copyright", "cc0", 3, 0.9),
    ("dedication", "public domain dedication", "public-domain", 2, 0.7),
    ("mark", "public domain mark", "public-domain", 2, 0.7),
    ("free", "free of known copyright restrictions", "public-domain", 2, 0.7),
    ("gutenberg", "this ebook is for the use of anyone anywhere under the terms of the project gutenberg license", "gutenberg", 3, 0.9),
    ("available", "text is available under the creative commons attribution sharealike license", "cc-by-sa", 3, 0.9),
    ("font", "this font software is licensed under the sil open font license", "ofl-1.1", 3, 0.95),
    ("fonts", "the font software may be sold as part of a larger software package fonts remain under this license", "ofl-1.1", 2, 0.75),
    # notices of ownership and refusals
    ("trade", "this software contains trade secrets and copyright material", "proprietary", 2, 0.7),
    ("unauthorized", "unauthorized copying of this file via any medium is strictly prohibited all rights reserved", "proprietary", 3, 0.85),
    ("unauthorized", "any unauthorized use reproduction or distribution without permission is prohibited", "proprietary", 2, 0.7),
    ("reproduced", "no part of this (?:publication|book|document|work) may be reproduced without written permission", "all-rights-reserved", 3, 0.8),
    ("retrieval", "stored in a retrieval system or transmitted in any form without permission", "all-rights-reserved", 2, 0.7),
    ("evaluation", "for evaluation purposes only under license", "evaluation", 2, 0.6),
    ("internal", "for internal use only", "internal", 2, 0.6),
    ("educational", "for educational use only", "non-commercial", 2, 0.6),
    ("research", "for research use only", "non-commercial", 2, 0.6),
    ("academic", "for academic use only", "non-commercial", 2, 0.6),
    ("eula", "end user license agreement eula", "eula", 2, 0.7),
    ("agreement", "software license agreement", "license-agreement", 1, 0.4),
    ("agreement", "by installing copying or otherwise using the software you agree to be bound by the terms of this license agreement", "eula", 3, 0.85),
    ("nontransferable", "a limited nonexclusive nontransferable license", "proprietary", 2, 0.7),
    ("exclusive", "a non exclusive non transferable license to use the software", "proprietary", 2, 0.7),
    ("reverse", "reverse engineer decompile or disassemble the licensed software", "proprietary", 2, 0.7),
    ("government", "us government restricted rights license", "proprietary", 2, 0.6),
    ("patents", "protected by copyright laws and international treaties and patents", "proprietary", 2, 0.5),
    ("trademarks", "all trademarks are the property of their respective owners all rights reserved", "trademark-notice", 2, 0.5),
    ("owners", "copyright of their respective owners", "copyright-notice", 1, 0.3),
    ("holder", "the copyright holder", "copyright-notice", 1, 0.3),
    ("holders", "the copyright holders", "copyright-notice", 1, 0.3),
    ("notice", "copyright notice", "copyright-notice", 1, 0.3),
    ("warranties", "disclaims all warranties", "warranty-disclaimer", 1, 0.4),
    ("warranties", "no warranties express or implied", "warranty-disclaimer", 1, 0.4),
    ("warranty", "provided as is without warranty", "warranty-disclaimer", 1, 0.4),
    ("warranty", "no warranty", "warranty-disclaimer", 1, 0.3),
    ("copying", "see the file copying for copyright details", "unknown-license-reference", 1, 0.3),
    ("license", "see license (?:txt|md)", "unknown-license-reference", 1, 0.3),
    ("license", "license (?:md|txt) for details", "unknown-license-reference", 1, 0.3),
    ("terms", "license terms", "unknown-license-reference", 1, 0.3),
    ("headers", "license headers", "unknown-license-reference", 1, 0.2),
    ("dual", "dual licensed", "dual-license", 1, 0.4),
    ("relicensed", "relicensed with permission", "unknown-license-reference", 1, 0.3),
    ("copyleft", "copyleft license", "copyleft", 1, 0.4),
    ("permissive", "permissive license", "permissive", 1, 0.4),
    ("open", "open source license", "open-source", 1, 0.4),
    ("free", "free software license", "free-software", 1, 0.4),
)

#: A text without one of these has no detection; each base phrase and each pattern contains one of them as (part of) a word.
ANCHORS = ("licens", "licenc", "permission", "redistribut", "public domain", "warrant", "reserved", "copyright", "confidential", "use only", "wtfpl", "cc0", "cc by", "creative commons", "bsd", "regents of", "be misrepresented", "plainly marked", "held liable", "advertising materials", "good not evil")


def rules() -> list[LicenseRule]:
    out = [LicenseRule("spdx", f"spdx licen[sc]e identifier {k.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", k, 3, 1.0) for k in IDENTIFIERS]
    for label, keyword, name, version in NAMES:
        full = f"{name} (?:version |v )?{version}" if version else name
        for phrase, priority, confidence in PHRASINGS:
            out.append(LicenseRule(keyword, phrase.format(name=full), label, max(priority, 2 if version else 1), confidence + 0.05 * bool(version) * (priority < 3)))
    return out + [LicenseRule(*n) for n in NOTICES]
