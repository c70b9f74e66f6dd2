"""License signatures: what a license's own notices, headings, addresses and identifiers say.

Each is written as lower-case words with one space between them, as texts are read once all other
characters are gone.  Label, expression, and the words that a text must hold before the expression is
tried; ``a|b`` means any of them.
"""

#: Fixed values.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("granted", "obtaining")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial", "notice")),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("liable", "authors")),
    ("mit-0", "mit no attribution", ("attribution", "mit")),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", ("consortium", "advertising")),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided", ("fee", "granted")),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", ("fee", "granted")),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", ("fee", "documentation")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "permitted")),
    ("bsd", "redistributions of source code must retain the above copyright notice", ("redistributions", "retain")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ("redistributions", "reproduce")),
    ("bsd-3", "neither the names? of the copyright holders? nor the names of its contributors may be used to endorse or promote products", ("endorse", "neither")),
    ("bsd-3", "neither the name of [^ ]+(?: [^ ]+)? nor the names of its contributors may be used to endorse or promote products", ("endorse", "neither")),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", ("advertising", "display")),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", ("bsd", "governed")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache", "compliance")),
    ("apache-2", "you may not use this file except in compliance with the apache license", ("apache", "compliance")),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("applicable", "basis")),
    ("apache-2", "apache org licenses license 2 0", ("apache", "licenses")),
    ("apache-2", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", ("reproduction", "definitions")),
    ("apache-1.1", "this product includes software developed by the apache software foundation", ("apache", "foundation")),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse", ("apache", "endorse")),
    ("gpl-1", "under the terms of the gnu general public license as published by the free software foundation either version 1", ("gnu", "published")),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("gnu", "received")),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ("gnu", "received")),
    ("agpl-3", "you should have received a copy of the gnu affero general public license along with this program", ("affero", "received")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", ("hope", "warranty")),
    ("gpl", "gnu org licenses gpl(?: \\d \\d)? html", ("gnu", "gpl")),
    ("gpl-2", "gnu org licenses old licenses gpl 2 0", ("gnu", "gpl")),
    ("gpl-3", "gnu org licenses gpl 3 0", ("gnu", "gpl")),
    ("lgpl", "gnu org licenses lgpl(?: \\d \\d)? html", ("gnu", "lgpl")),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1", ("gnu", "lgpl")),
    ("agpl-3", "gnu org licenses agpl(?: 3 0)? html", ("gnu", "agpl")),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("documentation", "gnu")),
    ("fdl-1.2", "gnu free documentation license version 1 2", ("documentation", "gnu")),
    ("fdl-1.3", "gnu free documentation license version 1 3", ("documentation", "gnu")),
    ("lgpl-2", "gnu library general public license(?: version 2)?", ("gnu", "library")),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work based on this library", ("linking", "statically")),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", ("mozilla", "contents")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "form")),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl", "obtain")),
    ("mpl-2", "mozilla org mpl 2 0", ("mozilla", "mpl")),
    ("mpl-1.1", "mozilla org mpl mpl 1 1", ("mozilla", "mpl")),
    ("npl-1.1", "the contents of this file are subject to the netscape public license version 1 [01]", ("netscape", "contents")),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ("eclipse", "accompanying")),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse", "accompanying")),
    ("epl-1", "eclipse org legal epl v10", ("eclipse", "legal")),
    ("epl-2", "eclipse org legal epl 2 0", ("eclipse", "legal")),
    ("cpl-1", "common public license(?: version)? ?v?1 0", ("common", "public")),
    ("ipl-1", "ibm public license version 1 0", ("ibm", "public")),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", ("contents", "development")),
    ("cddl-1", "opensolaris org os licensing", ("opensolaris",)),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved", ("eupl",)),
    ("eupl-1.1", "licensed under the eupl version 1 1", ("eupl",)),
    ("osl-3", "licensed under the open software license version 3 0", ("open", "version")),
    ("afl-3", "licensed under the academic free license version 3 0", ("academic",)),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", ("intent", "package")),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms", ("verbatim", "establishes")),
    ("perl", "this (?:library|program|module|package) is free software you can redistribute it and or modify it under the same terms as perl itself", ("perl", "itself")),
    ("ruby", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", ("redistribute", "either")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("organization", "granted")),
    ("bsl-1", "boost org license 1 0 txt", ("boost",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("express", "held")),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("misrepresented", "origin")),
    ("libpng", "the origin of this source code must not be misrepresented", ("misrepresented", "origin")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered", "domain")),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("anyone", "compile")),
    ("unlicense", "unlicense org", ("unlicense",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("verbatim", "changed")),
    ("wtfpl", "0 you just do what the fuck you want to", ("fuck",)),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", ("beer", "stuff")),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("font", "sil")),
    ("ofl-1.1", "scripts sil org ofl", ("ofl", "sil")),
    ("python-2", "psf is making python available to licensee on an as is basis", ("psf", "python")),
    ("python-2", "this license agreement is between the python software foundation", ("python", "agreement")),
    ("cnri-python", "this license agreement is between the corporation for national research initiatives", ("corporation", "initiatives")),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("deed", "dedicated")),
    ("cc0", "to the extent possible under law [^ ]+(?: [^ ]+)? has waived all copyright and related or neighboring rights", ("waived", "neighboring")),
    ("cc0", "creativecommons org publicdomain zero 1 0", ("creativecommons", "zero")),
    ("public-domain-mark", "creativecommons org publicdomain mark 1 0", ("creativecommons", "mark")),
    ("cc-by", "creativecommons org licenses by \\d \\d", ("creativecommons", "by")),
    ("cc-by-sa", "creativecommons org licenses by sa \\d \\d", ("creativecommons", "sa")),
    ("cc-by-nd", "creativecommons org licenses by nd \\d \\d", ("creativecommons", "nd")),
    ("cc-by-nc", "creativecommons org licenses by nc \\d \\d", ("creativecommons", "nc")),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa \\d \\d", ("creativecommons", "nc")),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd \\d \\d", ("creativecommons", "nc")),
    ("cc-by", "this work is licensed under a creative commons attribution \\d \\d international license", ("creative", "commons")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution ?share ?alike \\d \\d(?: international| unported)? license", ("creative", "commons")),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial \\d \\d(?: international| unported)? license", ("creative", "commons")),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution non ?commercial share ?alike \\d \\d(?: international| unported)? license", ("creative", "commons")),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s \\d \\d(?: international| unported)? license", ("creative", "commons")),
    ("odbl-1", "open data ?commons open database license(?: odbl)?(?: v?1 0)?", ("database", "open")),
    ("odc-by-1", "open data commons attribution license", ("commons", "attribution")),
    ("pddl-1", "open data commons public domain dedication and licen[cs]e", ("dedication", "commons")),
    ("ogl-3", "contains public sector information licensed under the open government licence v3 0", ("sector", "government")),
    ("nasa-1.3", "nasa open source agreement version 1 3", ("nasa", "agreement")),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software", ("deal", "associated")),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl",)),
    ("ssleay", "this product includes cryptographic software written by eric young", ("cryptographic", "eric")),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("fee", "appear")),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("written", "agreement")),
    ("vim", "i distributing unmodified copies of vim", ("vim", "unmodified")),
    ("ijg", "this software is based in part on the work of the independent jpeg group", ("jpeg", "independent")),
    ("freetype", "portions of this software are copyright [^ ]+ the freetype project", ("freetype",)),
    ("icu", "unicode inc license agreement data files and software", ("unicode", "agreement")),
    ("w3c", "w3c software notice and license", ("w3c", "notice")),
    ("w3c", "by obtaining using and or copying this work you the licensee agree", ("obtaining", "licensee")),
    ("ms-pl", "microsoft public license ms pl", ("microsoft", "public")),
    ("ms-rl", "microsoft reciprocal license ms rl", ("microsoft", "reciprocal")),
    ("ms-eula", "microsoft software license terms", ("microsoft", "terms")),
    ("sspl-1", "server side public license(?: version)? ?v?1", ("server", "side")),
    ("busl-1.1", "business source license(?: version)? ?1 1", ("business", "source")),
    ("elastic-2", "elastic license(?: version)? ?v?2(?: 0)?", ("elastic",)),
    ("commons-clause", "commons clause license condition v1 0", ("clause", "commons")),
    ("polyform-nc", "polyform noncommercial license 1 0 0", ("polyform",)),
    ("polyform-sb", "polyform small business license 1 0 0", ("polyform",)),
    ("hippocratic", "hippocratic license", ("hippocratic",)),
    ("llama", "llama \\d(?: \\d)? community license agreement", ("llama", "community")),
    ("openrail", "(?:bigscience|creativeml) open ?rail m", ("rail|openrail",)),
    ("gemma", "gemma terms of use", ("gemma", "terms")),
    ("cecill-2.1", "cecill free software license agreement version 2 1", ("cecill",)),
    ("cecill", "this software is governed by the cecill(?: [bc])?", ("cecill", "governed")),
    ("mulan-2", "licensed under mulan psl v2", ("mulan",)),
    ("upl-1", "the universal permissive license upl version 1 0", ("permissive", "upl")),
    ("blueoak-1", "blue oak model license 1 0 0", ("oak", "model")),
    ("ecl-2", "educational community license(?: version)? ?2 0", ("educational", "community")),
    ("qpl-1", "q public license version 1 0", ("q", "public")),
    ("sleepycat", "sleepycat software(?: inc)?", ("sleepycat",)),
    ("php-3", "this source file is subject to version 3 01 of the php license", ("php", "subject")),
    ("zpl-2.1", "zope public license zpl version 2 1", ("zope", "zpl")),
    ("json", "the software shall be used for good not evil", ("evil", "good")),
    ("proprietary", "all rights reserved(?: worldwide)?", ("rights", "reserved")),
    ("proprietary", "proprietary and confidential", ("proprietary", "confidential")),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", ("strictly", "prohibited")),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced(?: stored)?", ("reproduced", "part")),
    ("proprietary", "this software is the confidential and proprietary information of", ("proprietary", "confidential")),
    ("proprietary", "you shall not disclose such confidential information", ("disclose", "confidential")),
    ("non-commercial", "for (?:academic|research|personal|educational)(?: and (?:academic|research|personal|educational))? use only", ("only", "use")),
    ("non-commercial", "(?:may|must|can) not be used for commercial purposes", ("commercial", "purposes")),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", ("commercial|noncommercial", "only")),
    ("no-ai-training", "(?:may|must) not be used (?:to train|for training) (?:machine learning|artificial intelligence|ai|language) (?:models?|systems?)", ("train|training", "not")),
    ("public-domain", "(?:released|dedicated|placed|put) (?:in|into|to) the public domain", ("domain", "public")),
    ("public-domain", "this (?:file|work|code|software) is (?:in the public domain|public domain)", ("domain", "public")),
    ("copyright", "copyright c? ?\\d{4}(?: \\d{4})? [^ ]+", ("copyright",)),
    ("copyright", "copyrighted by [^ ]+", ("copyrighted",)),
    ("see-license-file", "see (?:the )?(?:license|licence|copying)(?: (?:txt|md))?(?: file)? (?:for|in) (?:license |licence )?(?:details|terms|the project root|the root)", ("see",)),
]
