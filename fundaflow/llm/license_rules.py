"""The signature rules of the licence scan, written for texts of lower-case words joined by single blanks.

A rule is (label, kind, keywords, pattern): the pattern is tried only where one of the keywords occurs.  Every
pattern is bounded in length and stands between blanks.  NAMES gives three rules a licence (its name, a grant
that names it, its identifier); URLS and TEXTS give one rule a line.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds by falling priority, with the weight of one detection in the score.
KINDS = {"identifier": 0.95, "text": 0.9, "notice": 0.85, "address": 0.8, "name": 0.6, "base": 0.5}

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = r"(?:version |ver |v ?)?"
_LICENSE = r"licen[cs]e"
_LATER = r"(?: (?:or (?:at your option )?(?:any )?later(?: version)?|and later|or newer))?"

# (label, identifier as words, keywords, name)
NAMES = [
    ("apache-1.0", "apache 1 0", ("apache",), rf"apache (?:software )?{_LICENSE} {_V}1 0"),
    ("apache-1.1", "apache 1 1", ("apache",), rf"apache (?:software )?{_LICENSE} {_V}1 1"),
    ("apache-2.0", "apache 2 0", ("apache",), rf"(?:apache (?:software )?{_LICENSE} {_V}2(?: 0)?|apache {_V}2 0(?: {_LICENSE})?|asl {_V}2 0)"),
    ("mit", "mit", ("mit licen", "expat licen", "x11 licen"), rf"(?:mit|expat|mit expat|x11|mit x11) {_LICENSE}"),
    ("mit-0", "mit 0", ("mit no attribution", "mit 0"), rf"(?:mit no attribution(?: {_LICENSE})?|mit 0 {_LICENSE})"),
    ("isc", "isc", ("isc licen", "internet systems consortium"), rf"(?:isc|internet systems consortium) {_LICENSE}"),
    ("bsd-2-clause", "bsd 2 clause", ("bsd", "freebsd"), rf"(?:(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: (?:style )?{_LICENSE})?)"),
    ("bsd-3-clause", "bsd 3 clause", ("bsd",), rf"(?:(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: (?:style )?{_LICENSE})?)"),
    ("bsd-4-clause", "bsd 4 clause", ("bsd",), rf"(?:(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: (?:style )?{_LICENSE})?)"),
    ("bsd", "bsd", ("bsd",), rf"bsd (?:style |type |like )?{_LICENSE}"),
    ("0bsd", "0bsd", ("0bsd", "zero clause bsd", "free public licen"), rf"(?:zero clause bsd(?: {_LICENSE})?|0bsd {_LICENSE}|free public {_LICENSE} 1 0 0)"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", ("gpl", "general public"), rf"(?:gnu (?:general public {_LICENSE}|gpl)|gpl) {_V}1(?: 0)?{_LATER}"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", ("gpl", "general public"), rf"(?:(?:gnu (?:general public {_LICENSE}|gpl)|gpl) {_V}2(?: 0)?|gplv2){_LATER}"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", ("gpl", "general public"), rf"(?:(?:gnu (?:general public {_LICENSE}|gpl)|gpl) {_V}3(?: 0)?|gplv3){_LATER}"),
    ("gpl", "gpl", ("general public", "gnu gpl"), rf"gnu (?:general public {_LICENSE}|gpl)"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", ("lgpl", "library general public"), rf"(?:gnu library general public {_LICENSE} {_V}2(?: 0)?|lgpl {_V}2 0){_LATER}"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", ("lgpl", "lesser general public"), rf"(?:(?:gnu lesser general public {_LICENSE}|gnu lgpl|lgpl) {_V}2 1|lgplv2 1){_LATER}"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", ("lgpl", "lesser general public"), rf"(?:(?:gnu lesser general public {_LICENSE}|gnu lgpl|lgpl) {_V}3(?: 0)?|lgplv3){_LATER}"),
    ("lgpl", "lgpl", ("lgpl", "lesser general public", "library general public"), rf"gnu (?:(?:lesser|library) general public {_LICENSE}|lgpl)"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", ("agpl", "affero"), rf"(?:(?:gnu )?(?:affero general public {_LICENSE}|agpl) {_V}3(?: 0)?|agplv3){_LATER}"),
    ("agpl", "agpl", ("agpl", "affero"), rf"gnu (?:affero general public {_LICENSE}|agpl)"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", ("free documentation", "gfdl"), rf"(?:gnu free documentation {_LICENSE}|gfdl) {_V}1 3{_LATER}"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", ("free documentation", "gfdl"), rf"(?:gnu free documentation {_LICENSE}|gfdl) {_V}1 2{_LATER}"),
    ("gfdl", "gfdl", ("free documentation", "gfdl"), rf"gnu free documentation {_LICENSE}"),
    ("mpl-1.0", "mpl 1 0", ("mozilla public", "mpl"), rf"(?:mozilla public {_LICENSE}|mpl) {_V}1 0"),
    ("mpl-1.1", "mpl 1 1", ("mozilla public", "mpl"), rf"(?:mozilla public {_LICENSE}|mpl) {_V}1 1"),
    ("mpl-2.0", "mpl 2 0", ("mozilla public", "mpl"), rf"(?:mozilla public {_LICENSE}|mpl) {_V}2(?: 0)?"),
    ("mpl", "mpl", ("mozilla public",), rf"mozilla public {_LICENSE}"),
    ("epl-1.0", "epl 1 0", ("eclipse public", "epl"), rf"(?:eclipse public {_LICENSE}|epl) {_V}1(?: 0)?"),
    ("epl-2.0", "epl 2 0", ("eclipse public", "epl"), rf"(?:eclipse public {_LICENSE}|epl) {_V}2(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", ("common development and distribution", "cddl"), rf"(?:common development and distribution {_LICENSE}|cddl) {_V}1 0"),
    ("cddl-1.1", "cddl 1 1", ("common development and distribution", "cddl"), rf"(?:common development and distribution {_LICENSE}|cddl) {_V}1 1"),
    ("cpl-1.0", "cpl 1 0", ("common public", "cpl"), rf"(?:common public {_LICENSE}|cpl) {_V}1 0"),
    ("eupl-1.1", "eupl 1 1", ("european union public", "eupl"), rf"(?:european union public {_LICENSE}|eupl) {_V}1 1"),
    ("eupl-1.2", "eupl 1 2", ("european union public", "eupl"), rf"(?:european union public {_LICENSE}|eupl) {_V}1 2"),
    ("artistic-1.0", "artistic 1 0", ("artistic",), rf"(?:perl )?artistic {_LICENSE} {_V}1(?: 0)?"),
    ("artistic-2.0", "artistic 2 0", ("artistic",), rf"(?:perl )?artistic {_LICENSE} {_V}2(?: 0)?"),
    ("zlib", "zlib", ("zlib",), rf"zlib(?: libpng)? {_LICENSE}"),
    ("libpng", "libpng", ("libpng", "png reference"), rf"(?:libpng|png reference library) {_LICENSE}"),
    ("bsl-1.0", "bsl 1 0", ("boost software",), rf"boost software {_LICENSE}(?: {_V}1(?: 0)?)?"),
    ("busl-1.1", "busl 1 1", ("business source",), rf"business source {_LICENSE}(?: {_V}1 1)?"),
    ("sspl-1.0", "sspl 1 0", ("server side public",), rf"server side public {_LICENSE}(?: {_V}1)?"),
    ("elastic-2.0", "elastic 2 0", ("elastic licen",), rf"elastic {_LICENSE}(?: {_V}2(?: 0)?)?"),
    ("unlicense", "unlicense", ("unlicense",), r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", ("wtfpl", "what the f"), rf"(?:wtfpl|do what the fuck you want to public {_LICENSE})"),
    ("psf-2.0", "(?:psf|python) 2 0", ("python software foundation", "psf"), rf"(?:python software foundation|psf) {_LICENSE}(?: {_V}2)?"),
    ("php-3.01", "php 3 01", ("php licen",), rf"php {_LICENSE}(?: {_V}3 01)?"),
    ("ruby", "ruby", ("ruby licen",), rf"ruby {_LICENSE}"),
    ("vim", "vim", ("vim licen",), rf"vim {_LICENSE}"),
    ("curl", "curl", ("curl licen",), rf"curl {_LICENSE}"),
    ("openssl", "openssl", ("openssl",), rf"openssl(?: and ssleay)? {_LICENSE}"),
    ("postgresql", "postgresql", ("postgresql",), rf"postgresql {_LICENSE}"),
    ("ncsa", "ncsa", ("ncsa",), rf"(?:university of illinois ncsa|ncsa) open source {_LICENSE}"),
    ("ofl-1.1", "ofl 1 1", ("open font", "ofl"), rf"(?:sil )?(?:open font {_LICENSE}|ofl) {_V}1 1"),
    ("ms-pl", "ms pl", ("microsoft public",), rf"microsoft public {_LICENSE}"),
    ("ms-rl", "ms rl", ("microsoft reciprocal",), rf"microsoft reciprocal {_LICENSE}"),
    ("afl-3.0", "afl 3 0", ("academic free",), rf"academic free {_LICENSE}(?: {_V}3 0)?"),
    ("osl-3.0", "osl 3 0", ("open software licen",), rf"open software {_LICENSE}(?: {_V}3 0)?"),
    ("ecl-2.0", "ecl 2 0", ("educational community",), rf"educational community {_LICENSE}(?: {_V}2 0)?"),
    ("upl-1.0", "upl 1 0", ("universal permissive",), rf"universal permissive {_LICENSE}(?: {_V}1 0)?"),
    ("blueoak-1.0.0", "blueoak 1 0 0", ("blue oak",), rf"blue oak model {_LICENSE}(?: {_V}1 0 0)?"),
    ("mulan-psl-2.0", "mulanpsl 2 0", ("mulan",), rf"mulan (?:psl|permissive software {_LICENSE}) {_V}2"),
    ("cecill-2.1", "cecill 2 1", ("cecill",), rf"cecill(?: free software)?(?: {_LICENSE})?(?: {_V}2 1)?"),
    ("odbl-1.0", "odbl 1 0", ("open database", "odbl"), rf"(?:open (?:data commons open )?database {_LICENSE}|odbl)(?: {_V}1 0)?"),
    ("odc-by-1.0", "odc by 1 0", ("open data commons attribution", "odc by"), rf"(?:open data commons attribution {_LICENSE}|odc by)(?: {_V}1 0)?"),
    ("pddl-1.0", "pddl 1 0", ("public domain dedication and licen",), rf"(?:open data commons )?public domain dedication and {_LICENSE}(?: {_V}1 0)?"),
    ("cdla-permissive-2.0", "cdla permissive 2 0", ("community data licen",), rf"community data {_LICENSE} agreement permissive(?: {_V}2 0)?"),
    ("openrail", "openrail", ("rail", "responsible ai licen"), rf"(?:(?:creativeml |bigscience )?(?:open )?rail (?:m |s )?{_LICENSE}|openrail(?: m)?|responsible ai {_LICENSE})"),
    ("cc0-1.0", "cc0 1 0", ("cc0", "creative commons zero"), rf"(?:cc0(?: 1 0)?(?: universal)?|creative commons zero(?: {_V}1 0)?(?: universal)?)(?: {_LICENSE}| public domain dedication)?"),
    ("cc-by-4.0", "cc by 4 0", ("cc by", "creative commons attribution"), rf"(?:cc by|creative commons attribution) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: public)?(?: {_LICENSE})?"),
    ("cc-by-3.0", "cc by 3 0", ("cc by", "creative commons attribution"), rf"(?:cc by|creative commons attribution) (?:{_LICENSE} )?{_V}3(?: 0)?(?: unported)?(?: {_LICENSE})?"),
    ("cc-by-2.5", "cc by 2 5", ("cc by", "creative commons attribution"), rf"(?:cc by|creative commons attribution) (?:{_LICENSE} )?{_V}2 5(?: {_LICENSE})?"),
    ("cc-by-2.0", "cc by 2 0", ("cc by", "creative commons attribution"), rf"(?:cc by|creative commons attribution) (?:{_LICENSE} )?{_V}2 0(?: generic)?(?: {_LICENSE})?"),
    ("cc-by-sa-4.0", "cc by sa 4 0", ("cc by sa", "share alike", "sharealike"), rf"(?:cc by sa|creative commons attribution share ?alike) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-sa-3.0", "cc by sa 3 0", ("cc by sa", "share alike", "sharealike"), rf"(?:cc by sa|creative commons attribution share ?alike) (?:{_LICENSE} )?{_V}3(?: 0)?(?: unported)?(?: {_LICENSE})?"),
    ("cc-by-sa", "cc by sa", ("cc by sa", "share alike", "sharealike"), rf"(?:cc by sa|creative commons attribution share ?alike)(?: {_LICENSE})?"),
    ("cc-by-nc-4.0", "cc by nc 4 0", ("cc by nc", "noncommercial", "non commercial"), rf"(?:cc by nc|creative commons attribution non ?commercial) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-nc-3.0", "cc by nc 3 0", ("cc by nc", "noncommercial", "non commercial"), rf"(?:cc by nc|creative commons attribution non ?commercial) (?:{_LICENSE} )?{_V}3(?: 0)?(?: unported)?(?: {_LICENSE})?"),
    ("cc-by-nc", "cc by nc", ("cc by nc", "noncommercial", "non commercial"), rf"(?:cc by nc|creative commons attribution non ?commercial)(?: {_LICENSE})?"),
    ("cc-by-nd-4.0", "cc by nd 4 0", ("cc by nd", "noderiv", "no deriv"), rf"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-nd", "cc by nd", ("cc by nd", "noderiv", "no deriv"), rf"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: {_LICENSE})?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", ("cc by nc sa", "share alike", "sharealike"), rf"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-nc-sa", "cc by nc sa", ("cc by nc sa", "share alike", "sharealike"), rf"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: {_LICENSE})?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", ("cc by nc nd", "noderiv", "no deriv"), rf"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?) (?:{_LICENSE} )?{_V}4(?: 0)?(?: international)?(?: {_LICENSE})?"),
    ("cc-by-nc-nd", "cc by nc nd", ("cc by nc nd", "noderiv", "no deriv"), rf"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: {_LICENSE})?"),
    ("cc-by", "cc by", ("cc by", "creative commons attribution"), rf"(?:cc by {_LICENSE}|creative commons attribution(?: {_LICENSE})?)"),
]

# (label, keyword, address as words)
URLS = [
    ("apache-2.0", "apache org", r"apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache org", r"apache org licenses license 1 1"),
    ("mit", "opensource org", r"opensource org licenses? mit(?: license php)?"),
    ("bsd-3-clause", "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource org", r"opensource org licenses? bsd 2 clause"),
    ("isc", "opensource org", r"opensource org licenses? isc"),
    ("artistic-2.0", "opensource org", r"opensource org licenses? artistic(?: license)? 2 0"),
    ("gpl-2.0", "gnu org", r"gnu org licenses(?: old licenses)? gpl 2 0(?: txt| html)?"),
    ("gpl-3.0", "gnu org", r"gnu org licenses gpl 3 0(?: txt| html)?"),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl(?: txt| html)?"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses(?: old licenses)? lgpl 2 1(?: txt| html)?"),
    ("lgpl-3.0", "gnu org", r"gnu org licenses lgpl 3 0(?: txt| html)?"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: txt| html)?"),
    ("agpl-3.0", "gnu org", r"gnu org licenses agpl(?: 3 0)?(?: txt| html)?"),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl(?: 1 [0-9])?(?: txt| html)?"),
    ("mpl-1.1", "mozilla org", r"mozilla org mpl (?:1 1|mpl 1 1)(?: txt| html)?"),
    ("mpl-2.0", "mozilla org", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-1.0", "eclipse org", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("bsl-1.0", "boost org", r"boost org license 1 0(?: txt)?"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"wtfpl net"),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl"),
    ("odbl-1.0", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons org", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.5", "creativecommons org", r"creativecommons org licenses by 2 5"),
    ("cc-by-2.0", "creativecommons org", r"creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-3.0", "creativecommons org", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nd-4.0", "creativecommons org", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", r"creativecommons org licenses by nc nd 4 0"),
]

# (label, keyword, sentence of the licence's text)
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "provided as is without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "dealings in the software", r"out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use in source and binary", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "software is provided by the", r"this software is provided by the (?:copyright holders|regents|author) (?:and contributors )?as is and any express or implied warranties"),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license", r"you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "specific language governing permissions", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "grant of copyright license subject to", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "free software you can redistribute it", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "either version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "version 2 as published", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl", "without even the implied warranty", r"but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public license along with this (?:program|file|package|library|software)"),
    ("gpl", "licenses for most software", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "free copyleft license for", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "free software you can redistribute it", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "version 2 1 of the license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl", "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software)"),
    ("agpl-3.0", "affero general public", r"gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "remotely through a computer network", r"all users interacting with it remotely through a computer network"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form is subject to", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "contents of this file are subject to the terms of the common", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software must not", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "held liable for any damages arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the", r"you just do what the fuck you want to"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law (?:[^ ]+ ){1,20}waived all copyright and related or neighboring rights"),
    ("cc-by", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("cc-by-sa", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution share ?alike (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("cc-by-nc", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution non ?commercial (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("cc-by-nd", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution no ?derivatives (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution non ?commercial share ?alike (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution non ?commercial no ?derivatives (?:[0-9] [0-9] )?(?:international |unported |generic )?license"),
    ("ofl-1.1", "font software is licensed under", r"this font software is licensed under the sil open font license version 1 1"),
    ("artistic-1.0", "artistic control over the development", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("php-3.01", "this product includes php", r"this product includes php software freely available from"),
    ("openssl", "openssl project for use in", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", "except as contained in this notice", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("ms-pl", "conditions and limitations a no trademark", r"conditions and limitations a no trademark license this license does not grant you rights"),
    ("busl-1.1", "additional use grant", r"the licensor may make an additional use grant above permitting limited production use"),
    ("public-domain", "public domain", r"(?:(?:is|are|was|been) )?(?:hereby )?(?:placed|released|dedicated|put) (?:into|in|to) the public domain"),
    ("public-domain", "public domain", r"this (?:work|file|software|code|text|book|document) is in the public domain"),
    ("proprietary", "all rights reserved", r"(?:copyright (?:[^ ]+ ){1,10})?all rights reserved"),
    ("proprietary", "without the prior written permission", r"(?:may not|no part of this [^ ]+ may) be reproduced (?:[^ ]+ ){0,20}without the prior written permission"),
    ("proprietary", "confidential and proprietary", r"(?:contains|is) confidential and proprietary information"),
    ("gutenberg", "project gutenberg license", r"under the terms of the project gutenberg license included with this (?:ebook|etext)"),
    ("ogl-uk-3.0", "open government", r"open government licence(?: for public sector information)?(?: v(?:ersion)? ?3(?: 0)?)?"),
]

_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|redistributed)(?: (?:to you|here|freely|only))? (?:under|by|with|on) (?:(?:the|a|an) )?(?:(?:terms|conditions) (?:and conditions )?of (?:(?:the|a|an) )?)?(?:gnu )?"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules in their order, which decides between detections of equal priority and span."""
    out = []

    def add(label: str, kind: str, keywords: tuple[str, ...], pattern: str) -> None:
        out.append(Rule(f"{label}:{kind}:{len(out)}", label, kind, keywords, rf"(?<= )(?:{pattern})(?= )"))

    for label, identifier, _, _ in NAMES:
        add(label, "identifier", ("spdx license identifier",), rf"spdx license identifier {identifier}")
    for label, keyword, pattern in TEXTS:
        add(label, "text", (keyword,), pattern)
    for label, _, keywords, name in NAMES:
        add(label, "notice", keywords, _GRANT + name)
    for label, keyword, pattern in URLS:
        add(label, "address", (keyword,), pattern)
    for label, _, keywords, name in NAMES:
        add(label, "name", keywords, name)
    for phrase, label in BASE.items():
        add(label, "base", (phrase,), phrase)
    return out
