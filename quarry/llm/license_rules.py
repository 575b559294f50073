"""Signature rules for licence texts, in order of priority.

A rule is a regular expression over normalised words (lower case, one space between
words, marks gone), a keyword that every match contains, a tier and a label.  Tier 0 are
the base phrases, 1 whole grants ("licensed under the ..."), 2 machine tags, 3 notices
and titles, 4 bare mentions.  A detection inside one of a better tier is suppressed.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    pattern: str
    tier: int
    label: str


#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Licences as (label, keyword, names in running text, machine tags).
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit licen[sc]e", r"mit"),
    ("mit", "expat", r"(?:the )?expat licen[sc]e", r"expat"),
    ("mit-0", "mit", r"(?:the )?mit (?:no attribution|0) licen[sc]e", r"mit 0"),
    ("apache-2", "apache", r"(?:the )?apache (?:software )?licen[sc]e(?: version)? 2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"(?:the )?apache (?:software )?licen[sc]e(?: version)? 1 1", r"apache 1 1"),
    ("apache-1", "apache", r"(?:the )?apache (?:software )?licen[sc]e(?: version)? 1 0", r"apache 1 0"),
    ("gpl-1", "general public", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general public", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "public", r"(?:the )?(?:gnu )?library general public licen[sc]e (?:version |v)2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "public", r"(?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v)2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "public", r"(?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v)3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e (?:version |v)3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.2", "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e (?:version |v)1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e (?:version |v)1 3", r"gfdl 1 3(?: only| or later)?"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified|2 clause|two clause) bsd licen[sc]e|(?:the )?freebsd(?: bsd)? licen[sc]e|(?:the )?bsd (?:2|two) clause licen[sc]e", r"bsd 2 clause"),
    ("bsd-2-clause", "2 clause", r"(?:the )?2 clause licen[sc]e", r"bsd 2 clause"),
    ("bsd-2-clause", "two clause", r"(?:the )?two clause licen[sc]e", r"bsd 2 clause"),
    ("bsd-2-clause", "simplified licen", r"(?:the )?simplified licen[sc]e", r"bsd 2 clause freebsd"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e|(?:the )?bsd (?:3|three) clause licen[sc]e", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original|old|4 clause|four clause) bsd licen[sc]e|(?:the )?bsd (?:4|four) clause licen[sc]e", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:the )?(?:zero clause|0 clause|0) ?bsd licen[sc]e", r"0bsd"),
    ("isc", "isc", r"(?:the )?isc licen[sc]e", r"isc"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[sc]e(?: version| v)? 1 1", r"mpl 1 1"),
    ("mpl-2", "mozilla", r"(?:the )?mozilla public licen[sc]e(?: version| v)? 2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "eclipse", r"(?:the )?eclipse public licen[sc]e(?: version| v)? 1(?: 0)?", r"epl 1 0"),
    ("epl-2", "eclipse", r"(?:the )?eclipse public licen[sc]e(?: version| v)? 2(?: 0)?", r"epl 2 0"),
    ("cddl-1", "distribution", r"(?:the )?common development and distribution licen[sc]e(?: version| v)? 1(?: 0)?", r"cddl 1 0"),
    ("cddl-1.1", "distribution", r"(?:the )?common development and distribution licen[sc]e(?: version| v)? 1 1", r"cddl 1 1"),
    ("cpl-1", "common public", r"(?:the )?common public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", r"cpl 1 0"),
    ("eupl-1.1", "european", r"(?:the )?european union public licen[sc]e(?: version| v)? 1 1", r"eupl 1 1"),
    ("eupl-1.2", "european", r"(?:the )?european union public licen[sc]e(?: version| v)? 1 2", r"eupl 1 2"),
    ("osl-3", "open software", r"(?:the )?open software licen[sc]e(?: version| v)?(?: 3)?(?: 0)?", r"osl 3 0"),
    ("afl-3", "academic", r"(?:the )?academic free licen[sc]e(?: version| v)?(?: 3)?(?: 0)?", r"afl 3 0"),
    ("artistic-1", "artistic", r"(?:the )?(?:perl )?artistic licen[sc]e(?: version| v)? 1(?: 0)?", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", "artistic", r"(?:the )?(?:perl )?artistic licen[sc]e(?: version| v)? 2(?: 0)?", r"artistic 2 0"),
    ("boost-1", "boost", r"(?:the )?boost software licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", r"bsl 1 0"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("libpng", "libpng", r"(?:the )?libpng licen[sc]e", r"libpng(?: 2 0)?"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "public", r"(?:the )?do what the fuck you want to public licen[sc]e", r"wtfpl"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal licen[sc]e", r"ms rl"),
    ("psf-2", "python", r"(?:the )?python software foundation licen[sc]e(?: version| v)?(?: 2)?(?: 0)?", r"psf 2 0|python 2 0"),
    ("php-3", "php", r"(?:the )?php licen[sc]e(?: version| v)?(?: 3)?(?: 0| 01)?", r"php 3 0|php 3 01"),
    ("ruby", "ruby", r"(?:the )?ruby licen[sc]e", r"ruby"),
    ("openssl", "openssl", r"(?:the )?openssl licen[sc]e", r"openssl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[sc]e", r"postgresql"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)? licen[sc]e", r"ncsa"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software)?(?: notice and)? licen[sc]e", r"w3c"),
    ("upl-1", "universal", r"(?:the )?universal permissive licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", r"upl 1 0"),
    ("sspl-1", "server side", r"(?:the )?server side public licen[sc]e(?: version| v)?(?: 1)?", r"sspl 1 0"),
    ("busl-1.1", "business", r"(?:the )?business source licen[sc]e(?: version| v)?(?: 1)?(?: 1)?", r"busl 1 1"),
    ("elastic-2", "elastic", r"(?:the )?elastic licen[sc]e(?: version| v)?(?: 2)?(?: 0)?", r"elastic 2 0"),
    ("ofl-1.1", "open font", r"(?:the )?(?:sil )?open font licen[sc]e(?: version| v)?(?: 1)?(?: 1)?", r"ofl 1 1"),
    ("odbl-1", "database", r"(?:the )?(?:odc )?open database licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", r"odbl 1 0"),
    ("odc-by-1", "commons attribution", r"(?:the )?open data commons attribution licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", r"odc by 1 0"),
    ("cc0-1", "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: licen[sc]e| dedication)?", r"cc0 1 0"),
    ("cc-by", "commons attribution", r"(?:the |a )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by [1-4] [05]"),
    ("cc-by-sa", "alike", r"(?:the |a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "deriv", r"(?:the |a )?creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "commercial", r"(?:the |a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "commercial", r"(?:the |a )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "commercial", r"(?:the |a )?creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", r"cc by nc nd [1-4] [05]"),
    ("llama", "llama", r"(?:the )?llama [2-4](?: [1-3])? community licen[sc]e(?: agreement)?", r"llama [2-4](?: [1-3])?"),
    ("openrail", "openrail", r"(?:the )?(?:creativeml )?openrail(?: m)? licen[sc]e", r"openrail(?: m)?"),
    ("openrail", "open rail", r"(?:the )?(?:creativeml )?open rail(?: m)? licen[sc]e", r"open rail(?: m)?"),
    ("mulan-2", "mulan", r"(?:the )?mulan (?:psl|permissive software licen[sc]e)(?: version| v)? ?2", r"mulanpsl 2 0"),
    ("vim", "vim", r"(?:the )?vim licen[sc]e", r"vim"),
    ("x11", "x11", r"(?:the )?x11 licen[sc]e", r"x11"),
)

# Ways to grant a licence and to name it in a notice; NAME stands for the names.
_GRANTS = (
    r"(?:is|are|be)? ?(?:licen[sc]ed|sublicensed|relicensed) under (?:the terms of |the terms and conditions of )?(?:NAME)",
    r"(?:released|distributed|redistributed|published|provided|offered|shipped) under (?:the terms of |the conditions of )?(?:NAME)",
    r"(?:available|free|usable|open source|covered|governed|subject to|permitted) (?:software )?(?:under|by) (?:the terms of |the conditions of )?(?:NAME)",
)
_NOTICES = (
    r"licen[sc]e (?:NAME)",
    r"(?:according to|in compliance with|pursuant to|see|terms of|conditions of|copy of) (?:NAME)",
)

# Rules of their own, not made from a name.
SINGLE = (
    Rule("cc by nc", r"cc by nc", 0, "cc-by-nc"),
    Rule("cc by", r"licen[sc]ed under (?:a |the )?cc by [1-4](?: [05])?", 1, "cc-by"),
    Rule("cc by sa", r"cc by sa(?: [1-4](?: [05])?)?", 3, "cc-by-sa"),
    Rule("cc by nd", r"cc by nd(?: [1-4](?: [05])?)?", 3, "cc-by-nd"),
    Rule("cc by nc sa", r"cc by nc sa(?: [1-4](?: [05])?)?", 0, "cc-by-nc-sa"),
    Rule("cc by nc nd", r"cc by nc nd(?: [1-4](?: [05])?)?", 0, "cc-by-nc-nd"),
    Rule("public domain", r"(?:released|placed|dedicated|put|is) (?:in|in to|into|to) the public domain", 1, "public-domain"),
    Rule("general public", r"(?:gnu )?general public licen[sc]e as published by the free software foundation either version 2", 1, "gpl-2"),
    Rule("general public", r"(?:gnu )?general public licen[sc]e as published by the free software foundation either version 3", 1, "gpl-3"),
    Rule("free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 1, "mit"),
    Rule("binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 1, "bsd"),
    Rule("permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1, "isc"),
    Rule("except in compliance", r"you may not use this file except in compliance with the licen[sc]e", 1, "apache-2"),
    Rule("unencumbered", r"this is free and unencumbered software released into the public domain", 1, "unlicense"),
    Rule("all rights reserved", r"copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){1,6}all rights reserved", 3, "proprietary"),
    Rule("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 3, "proprietary"),
    Rule("general public", r"(?:gnu )?general public licen[sc]e", 4, "gpl"),
    Rule("lesser", r"(?:gnu )?lesser general public licen[sc]e", 4, "lgpl"),
    Rule("affero", r"(?:gnu )?affero general public licen[sc]e", 4, "agpl"),
    Rule("apache", r"apache (?:software )?licen[sc]e", 4, "apache"),
    Rule("bsd", r"bsd(?: style)? licen[sc]e", 4, "bsd"),
    Rule("creative commons", r"creative commons(?: attribution)?", 4, "creative-commons"),
    Rule("mozilla", r"mozilla public licen[sc]e", 4, "mpl"),
    Rule("eclipse", r"eclipse public licen[sc]e", 4, "epl"),
    Rule("artistic", r"artistic licen[sc]e", 4, "artistic"),
    # short names
    Rule("gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?", 3, "gpl-2"),
    Rule("gpl version 2", r"(?:gnu )?gpl version 2(?: 0)?(?: only| or later)?", 3, "gpl-2"),
    Rule("gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?", 3, "gpl-3"),
    Rule("gpl version 3", r"(?:gnu )?gpl version 3(?: 0)?(?: only| or later)?", 3, "gpl-3"),
    Rule("lgpl", r"(?:gnu )?lgpl ?v?2 1(?: only| or later)?", 3, "lgpl-2.1"),
    Rule("lgpl version 2", r"(?:gnu )?lgpl version 2 1(?: only| or later)?", 3, "lgpl-2.1"),
    Rule("lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?", 3, "lgpl-3"),
    Rule("lgpl version 3", r"(?:gnu )?lgpl version 3(?: 0)?(?: only| or later)?", 3, "lgpl-3"),
    Rule("agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?", 3, "agpl-3"),
    Rule("agpl version 3", r"(?:gnu )?agpl version 3(?: 0)?(?: only| or later)?", 3, "agpl-3"),
    Rule("gpl", r"(?:gnu )?gpl", 4, "gpl"),
    Rule("lgpl", r"(?:gnu )?lgpl", 4, "lgpl"),
    Rule("agpl", r"(?:gnu )?agpl", 4, "agpl"),
    Rule("apache 2", r"licen[sc]ed under (?:the )?apache 2(?: 0)?(?: licen[sc]e)?", 1, "apache-2"),
    Rule("apache 2 0", r"apache 2 0(?: licen[sc]ed?)?", 3, "apache-2"),
    Rule("apache 2 licen", r"apache 2 licen[sc]ed?", 3, "apache-2"),
    Rule("mit", r"licen[sc]ed under (?:the )?mit", 1, "mit"),
    Rule("mit licen", r"mit licen[sc]ed", 3, "mit"),
    Rule("bsd", r"licen[sc]ed under (?:the |a )?bsd", 1, "bsd"),
    Rule("bsd licen", r"bsd licen[sc]ed", 3, "bsd"),
    Rule("unlicense", r"unlicense", 4, "unlicense"),
    # sentences of licence texts and notices
    Rule("the software is provided", r"the software is provided as is without warranty of any kind express or implied", 3, "permissive-notice"),
    Rule("above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1, "mit"),
    Rule("retain the above", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1, "bsd"),
    Rule("endorse or promote", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 1, "bsd-3-clause"),
    Rule("advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, "bsd-4-clause"),
    Rule("free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1, "gpl"),
    Rule("free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 1, "lgpl"),
    Rule("verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", 1, "gpl"),
    Rule("mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1, "mpl-2"),
    Rule("eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e(?: v)?(?: 2 0)?", 1, "epl"),
    Rule("misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, "zlib"),
    Rule("boost software", r"distributed under the boost software licen[sc]e version 1 0", 1, "boost-1"),
    Rule("development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1, "cddl"),
    Rule("attribution assurance", r"attribution assurance licen[sc]e", 3, "aal"),
    Rule("waived all copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights", 1, "cc0-1"),
    Rule("no rights reserved", r"no rights reserved", 3, "public-domain"),
    Rule("some rights reserved", r"some rights reserved", 3, "creative-commons"),
    Rule("dual licensed", r"dual licensed under (?:[^ ]+ ){1,8}(?:and|or) (?:the )?(?:mit|apache|gpl|bsd|lgpl|mpl)", 4, "dual"),  # the licences in it are detections too
    Rule("same terms as perl", r"(?:licen[sc]ed )?under the same terms as perl(?: itself)?", 1, "artistic-1"),
    Rule("same terms as ruby", r"(?:licen[sc]ed )?under the same terms as ruby(?: itself)?", 1, "ruby"),
    Rule("beerware", r"beerware licen[sc]e(?: revision 42)?|licen[sc]ed under beerware", 3, "beerware"),
    Rule("for non commercial", r"licen[sc]ed for non commercial (?:use|purposes|research)(?: only)?", 1, "noncommercial"),
    Rule("for research purposes only", r"(?:licen[sc]ed |released |available )for research purposes only", 1, "research-only"),
    Rule("all rights reserved", r"all rights reserved", 4, "proprietary"),
    Rule("commercial licen", r"commercial licen[sc]e (?:is )?required", 3, "commercial"),
    Rule("open government", r"(?:contains public sector information )?licen[sc]ed under the open government licen[sc]e v[123](?: 0)?", 1, "ogl"),
    Rule("open government", r"open government licen[sc]e", 4, "ogl"),
    Rule("responsible ai", r"responsible ai licen[sc]e", 3, "rail"),
    Rule("gemma terms", r"(?:subject to )?(?:the )?gemma terms of use licen[sc]e", 3, "gemma"),
    Rule("bigscience", r"(?:the )?bigscience (?:bloom )?rail(?: 1 0)? licen[sc]e", 1, "bigscience-rail"),
    Rule("data licen", r"community data licen[sc]e agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?", 1, "cdla"),
    Rule("etalab", r"etalab open licen[sc]e(?: 2 0)?", 1, "etalab-2"),
    Rule("peer production", r"peer production licen[sc]e", 3, "ppl"),
    Rule("anti 996", r"anti 996 licen[sc]e", 3, "anti-996"),
    Rule("hippocratic", r"hippocratic licen[sc]e(?: version)?(?: [123] [0-9])?", 3, "hippocratic"),
    Rule("prosperity public", r"prosperity public licen[sc]e(?: [23] 0 0)?", 3, "prosperity"),
    Rule("polyform", r"polyform (?:noncommercial|small business|strict|shield|internal use) licen[sc]e(?: 1 0 0)?", 3, "polyform"),
    Rule("functional source", r"functional source licen[sc]e(?: version)?(?: 1 1)?", 3, "fsl"),
    Rule("blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", 3, "blueoak"),
    Rule("cern open", r"cern open hardware licen[sc]e(?: version)?(?: 2)?", 3, "cern-ohl"),
    Rule("solderpad", r"solderpad hardware licen[sc]e", 3, "solderpad"),
    Rule("educational community", r"educational community licen[sc]e(?: version)?(?: 2 0)?", 3, "ecl"),
    Rule("cecill", r"cecill(?: [bc])? (?:free software )?licen[sc]e", 3, "cecill"),
    Rule("nasa open", r"nasa open source agreement(?: version)?(?: 1 3)? licen[sc]e", 3, "nasa"),
    Rule("intel open", r"intel open source licen[sc]e", 3, "intel"),
    Rule("apple public", r"apple public source licen[sc]e(?: version)?(?: [12] [0-9])?", 3, "apsl"),
    Rule("sun industry", r"sun industry standards source licen[sc]e", 3, "sissl"),
    Rule("qt", r"qt (?:commercial|public) licen[sc]e", 3, "qt"),
)


def rules() -> list[Rule]:
    """All rules, the best first."""
    out = [Rule(phrase, phrase, 0, label) for phrase, label in BASE]
    for label, keyword, names, tags in FAMILIES:
        out += [Rule(keyword, grant.replace("NAME", names), 1, label) for grant in _GRANTS]
        out.append(Rule("spdx", rf"spdx licen[sc]e identifier (?:{tags})", 2, label))
        out += [Rule(keyword, notice.replace("NAME", names), 3, label) for notice in _NOTICES]
        out.append(Rule(keyword, rf"(?:{names})", 3 if re_versioned(label) else 4, label))
    found = {(r.pattern, r.label): r for r in reversed([*out, *SINGLE])}
    return sorted(found.values(), key=lambda r: (r.tier, r.label, r.pattern))


def re_versioned(label: str) -> bool:
    return any(c.isdigit() for c in label)


#: Words of which every rule's match has one; a text with none of them meets no rule.
GATE = ("licen", "gpl", "apache 2", "cc by", "cc0", "public domain", "spdx", "rights reserved", "proprietary", "creative commons", "free of charge", "binary forms", "permission to use", "unencumbered", "mulan psl", "copyright notice", "software is provided", "endorse or promote", "advertising materials", "misrepresented", "waived all copyright", "same terms as", "research purposes only", "beerware")
