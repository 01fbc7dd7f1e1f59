"""Signatures of licenses, written by hand: label, priority, score, regex over lower-cased words joined by blanks.

Words are runs of digits and letters, so punctuation is a blank here: "2.0" is "2 0", "author(s)" is "author s". Priority 6
is for texts that name what a lower one could take for another license, 5 for sentences of license texts, 4 for notices
and addresses, 3 for grants by name, 2 and 1 for mentions. Score 1.0: the license's own text, notice or address.
"""

#: Sentences that license texts hold.
TEXTS = [
    ("mit", 5, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 5, 1.0, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit", 5, 1.0, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 5, 1.0, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 6, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}?to do so the software is provided as is"),
    ("x11", 5, 1.0, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", 5, 1.0, "except as contained in this notice the names? of the (?:above )?copyright holders? shall not be used in advertising"),
    ("curl", 6, 1.0, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", 5, 1.0, "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("ntp", 5, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", 5, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 5, 1.0, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", 6, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 5, 1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 5, 1.0, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 5, 1.0, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 5, 1.0, "neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd", 5, 1.0, "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties"),
    ("bsd-4-clause", 6, 1.0, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", 6, 1.0, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", 6, 1.0, "each copyright holder and contributor hereby grants you a perpetual worldwide non exclusive no charge royalty free irrevocable patent license"),
    ("bsd-nuclear", 6, 1.0, "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("apache", 5, 1.0, "apache license version 2 0 january 2004"),
    ("apache", 5, 1.0, "you may not use this (?:file|work|software|project) except in compliance with the license"),
    ("apache", 5, 1.0, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", 5, 1.0, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache", 5, 1.0, "if the work includes a notice text file as part of its distribution"),
    ("apache", 5, 1.0, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 5, 1.0, "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", 5, 1.0, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 5, 1.0, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", 5, 1.0, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", 5, 1.0, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", 5, 1.0, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 5, 1.0, "you should have received a copy of the gnu general public license along with this (?:program|software|library|file)"),
    ("gpl-2.0-or-later", 6, 1.0, "gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", 6, 1.0, "gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0", 6, 1.0, "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", 6, 1.0, "gnu general public license version 3 as published by the free software foundation"),
    ("gpl-2.0", 6, 1.0, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 6, 1.0, "gnu general public license version 3 29 june 2007"),
    ("lgpl", 6, 1.0, "gnu lesser general public license as published by the free software foundation"),
    ("lgpl", 6, 1.0, "gnu library general public license as published by the free software foundation"),
    ("lgpl", 6, 1.0, "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 6, 1.0, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", 6, 1.0, "gnu library general public license version 2 june 1991"),
    ("lgpl", 5, 1.0, "a work that uses the library in isolation is not a derivative work of the library"),
    ("agpl", 6, 1.0, "gnu affero general public license as published by the free software foundation"),
    ("agpl", 6, 1.0, "gnu affero general public license version 3 19 november 2007"),
    ("agpl", 6, 1.0, "you should have received a copy of the gnu affero general public license"),
    ("agpl", 6, 1.0, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 6, 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gcc-exception", 6, 1.0, "this exception applies to a given file the runtime library that bears a notice placed by the copyright holder"),
    ("classpath-exception", 6, 1.0, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("mpl-2.0", 6, 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 6, 1.0, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 6, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 6, 1.0, "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", 6, 1.0, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl", 6, 1.0, "the contents of this file are subject to the netscape public license"),
    ("epl-2.0", 6, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0"),
    ("epl-1.0", 6, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("edl", 6, 1.0, "eclipse distribution license v ?1 0"),
    ("cpl-1.0", 6, 1.0, "the accompanying program is provided under the terms of this common public license"),
    ("ibm-pl", 6, 1.0, "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1.0", 6, 1.0, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 6, 1.0, "when distributing covered code include this cddl header in each file"),
    ("artistic-2.0", 6, 1.0, "everyone is permitted to copy and distribute verbatim copies of this license document .{0,60}?the artistic license"),
    ("artistic", 5, 1.0, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 5, 1.0, "you can redistribute it and or modify it under the same terms as perl itself"),
    ("clarified-artistic", 6, 1.0, "the clarified artistic license"),
    ("zlib", 5, 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 5, 1.0, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 5, 1.0, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 5, 1.0, "this notice may not be removed or altered from any source distribution"),
    ("libpng", 6, 1.0, "the contributing authors and group 42 inc disclaim all warranties expressed or implied"),
    ("boost", 6, 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", 6, 1.0, "distributed under the boost software license version 1 0"),
    ("unlicense", 6, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 5, 1.0, "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", 6, 1.0, "do what the fuck you want to public license"),
    ("wtfpl", 6, 1.0, "you just do what the fuck you want to"),
    ("beerware", 6, 1.0, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", 6, 1.0, "the software shall be used for good not evil"),
    ("cc0-1.0", 6, 1.0, "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", 6, 1.0, "the person who associated cc0 with this work has dedicated the work to the public domain"),
    ("cc-by", 4, 1.0, "this work is licensed under (?:the|a) creative commons attribution"),
    ("cc-by-sa", 6, 1.0, "this work is licensed under (?:the|a) creative commons attribution share ?alike"),
    ("cc-by-nd", 6, 1.0, "this work is licensed under (?:the|a) creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", 5, 1.0, "this work is licensed under (?:the|a) creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", 6, 1.0, "this work is licensed under (?:the|a) creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 6, 1.0, "this work is licensed under (?:the|a) creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("odbl-1.0", 6, 1.0, "is made available under the open database license"),
    ("odc-by", 6, 1.0, "is made available under the open data commons attribution license"),
    ("pddl", 6, 1.0, "is made available under the public domain dedication and license"),
    ("ofl-1.1", 6, 1.0, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 6, 1.0, "the font software may be sold as part of a larger software package"),
    ("python", 5, 1.0, "this license agreement is between the python software foundation"),
    ("python", 5, 1.0, "psf is making python available to licensee on an as is basis"),
    ("php", 5, 1.0, "this product includes php software freely available from"),
    ("php", 5, 1.0, "this source file is subject to version (?:2 02|3 0|3 01) of the php license"),
    ("ruby", 5, 1.0, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", 6, 1.0, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 6, 1.0, "this product includes cryptographic software written by eric young"),
    ("postgresql", 6, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", 6, 1.0, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("w3c", 6, 1.0, "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms"),
    ("unicode", 6, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", 6, 1.0, "permission is hereby granted free of charge to any person obtaining a copy .{0,160}?copyright notice s and this permission notice appear in all copies"),
    ("ijg", 6, 1.0, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 6, 1.0, "portions of this software are copyright .{1,60}? the freetype project"),
    ("infozip", 6, 1.0, "altered versions including but not limited to ports to new operating systems .{0,160}?must be plainly marked as such"),
    ("bzip2", 6, 1.0, "this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("sqlite", 6, 1.0, "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("vim", 6, 1.0, "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("sleepycat", 6, 1.0, "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("zope", 6, 1.0, "this software is subject to the provisions of the zope public license"),
    ("ncsa", 6, 1.0, "permission is hereby granted free of charge .{0,120}?to deal with the software without restriction"),
    ("upl-1.0", 6, 1.0, "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("afl", 5, 1.0, "licensed under the academic free license version"),
    ("osl", 5, 1.0, "licensed under the open software license version"),
    ("eupl", 6, 1.0, "licensed under the eupl"),
    ("eupl", 6, 1.0, "european union public licen[cs]e v(?:ersion)? ?1"),
    ("cecill", 6, 1.0, "this software is governed by the cecill(?: [abc])? license under french law"),
    ("lppl", 6, 1.0, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("qpl", 6, 1.0, "licensed under the q public license"),
    ("ms-pl", 6, 1.0, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", 6, 1.0, "microsoft reciprocal license ms rl"),
    ("apsl", 6, 1.0, "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("rpsl", 6, 1.0, "the contents of this file are subject to the current version of the realnetworks public source license"),
    ("sissl", 6, 1.0, "the contents of this file are subject to the sun industry standards source license"),
    ("spl", 6, 1.0, "the contents of this file are subject to the sun public license"),
    ("cpal", 6, 1.0, "the contents of this file are subject to the common public attribution license"),
    ("intel-open", 6, 1.0, "the name of the intel corporation or its contributors may not be used to endorse or promote products"),
    ("sspl-1.0", 6, 1.0, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", 6, 1.0, "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", 6, 1.0, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", 6, 1.0, "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("polyform", 6, 1.0, "polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial) license"),
    ("parity", 6, 1.0, "contribute software you develop operate or analyze with this software"),
    ("bluoak", 6, 1.0, "blue oak model license"),
    ("mulan-psl", 6, 1.0, "you can use this software according to the terms and conditions of the mulan psl"),
    ("openrail", 6, 1.0, "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("llama", 6, 1.0, "llama (?:2|3|3 1|3 2|3 3) community license agreement"),
    ("gemma", 6, 1.0, "gemma is provided under and subject to the gemma terms of use"),
]
#: Notices that name a license by its address.
ADDRESSES = [
    ("apache-2.0", 4, 1.0, "apache org licenses license 2 0"),
    ("apache-1.1", 4, 1.0, "apache org licenses license 1 1"),
    ("mit", 4, 1.0, "opensource org licenses? mit"),
    ("bsd-2-clause", 4, 1.0, "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", 4, 1.0, "opensource org licenses? bsd 3 clause"),
    ("bsd", 4, 1.0, "opensource org licenses? bsd license"),
    ("isc", 4, 1.0, "opensource org licenses? isc"),
    ("zlib", 4, 1.0, "opensource org licenses? zlib"),
    ("artistic-2.0", 4, 1.0, "opensource org licenses? artistic license 2 0"),
    ("ms-pl", 4, 1.0, "opensource org licenses? ms pl"),
    ("ncsa", 4, 1.0, "opensource org licenses? ncsa"),
    ("afl", 4, 1.0, "opensource org licenses? afl 3 0"),
    ("osl", 4, 1.0, "opensource org licenses? osl 3 0"),
    ("cpal", 4, 1.0, "opensource org licenses? cpal"),
    ("gpl-3.0", 4, 1.0, "gnu org licenses gpl 3 0"),
    ("gpl-2.0", 4, 1.0, "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl", 4, 1.0, "gnu org licenses gpl(?: html| txt)?"),
    ("gpl", 4, 1.0, "gnu org copyleft gpl html"),
    ("lgpl-3.0", 4, 1.0, "gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", 4, 1.0, "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl", 4, 1.0, "gnu org licenses lgpl(?: html| txt)?"),
    ("lgpl", 4, 1.0, "gnu org copyleft lesser html"),
    ("agpl-3.0", 4, 1.0, "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", 4, 1.0, "gnu org licenses fdl(?: 1 [123])?"),
    ("mpl-2.0", 4, 1.0, "mozilla org mpl 2 0"),
    ("mpl-1.1", 4, 1.0, "mozilla org mpl mpl 1 1"),
    ("epl-1.0", 4, 1.0, "eclipse org legal epl v ?10"),
    ("epl-2.0", 4, 1.0, "eclipse org legal epl (?:v ?20|2 0)"),
    ("cddl-1.0", 4, 1.0, "(?:sun com|opensolaris org os|java net) (?:cddl|licensing)(?: cddl)? html"),
    ("boost", 4, 1.0, "boost org license 1 0 txt"),
    ("unlicense", 4, 1.0, "unlicense org"),
    ("wtfpl", 4, 1.0, "wtfpl net"),
    ("ofl-1.1", 4, 1.0, "scripts sil org ofl"),
    ("php", 4, 1.0, "php net license 3 0"),
    ("python", 4, 1.0, "docs python org 3 license html"),
    ("w3c", 4, 1.0, "w3 org consortium legal (?:2002|2015) copyright software"),
    ("eupl", 4, 1.0, "joinup ec europa eu .{0,60}?eupl"),
    ("cecill", 4, 1.0, "cecill info licences"),
    ("lppl", 4, 1.0, "latex project org lppl"),
    ("odbl-1.0", 4, 1.0, "opendatacommons org licenses odbl"),
    ("odc-by", 4, 1.0, "opendatacommons org licenses by"),
    ("pddl", 4, 1.0, "opendatacommons org licenses pddl"),
    ("cc0-1.0", 4, 1.0, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 4, 1.0, "creativecommons org (?:publicdomain mark|licenses publicdomain)"),
    ("cc-by", 4, 1.0, "creativecommons org licenses by (?:1|2|3|4) [05]"),
    ("cc-by-sa", 4, 1.0, "creativecommons org licenses by sa (?:1|2|3|4) [05]"),
    ("cc-by-nd", 4, 1.0, "creativecommons org licenses by nd (?:1|2|3|4) [05]"),
    ("cc-by-nc", 4, 1.0, "creativecommons org licenses by nc (?:1|2|3|4) [05]"),
    ("cc-by-nc-sa", 4, 1.0, "creativecommons org licenses by nc sa (?:1|2|3|4) [05]"),
    ("cc-by-nc-nd", 4, 1.0, "creativecommons org licenses by nc nd (?:1|2|3|4) [05]"),
    ("sspl-1.0", 4, 1.0, "mongodb com licensing server side public license"),
    ("elastic-2.0", 4, 1.0, "elastic co licensing elastic license"),
    ("busl-1.1", 4, 1.0, "mariadb com bsl11"),
    ("polyform", 4, 1.0, "polyformproject org licenses"),
    ("mulan-psl", 4, 1.0, "license coscl org cn mulanpsl2?"),
    ("openrail", 4, 1.0, "huggingface co spaces (?:bigscience license|compvis stable diffusion license)"),
    ("llama", 4, 1.0, "(?:ai meta|llama) com (?:llama|resources models and libraries llama downloads).{0,40}?license"),
]
#: Grants, dedications and reservations without a license's own text.
NOTICES = [
    ("mit", 3, 0.9, "(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("apache", 3, 0.9, "(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e"),
    ("gpl", 3, 0.9, "(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[cs]e)"),
    ("lgpl", 4, 0.9, "(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)"),
    ("agpl", 4, 0.9, "(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)"),
    ("bsd", 3, 0.9, "(?:released|distributed|available|provided) under (?:the |a )?(?:terms of the )?bsd(?: style)? licen[cs]e"),
    ("bsd", 3, 0.9, "use of this source code is governed by a bsd style license"),
    ("mit", 3, 0.9, "use of this source code is governed by an mit style license"),
    ("bsd", 3, 0.9, "(?:two|three|2|3) clause bsd licen[cs]e"),
    ("gpl", 3, 0.9, "gplv[23](?: or later)?"),
    ("lgpl", 3, 0.9, "lgplv(?:2 1|2|3)(?: or later)?"),
    ("agpl", 3, 0.9, "agplv3(?: or later)?"),
    ("dual", 4, 0.9, "dual licensed under (?:the )?(?:terms of the )?(?:mit|apache|gpl|bsd|mpl)"),
    ("perl", 4, 0.9, "under the same (?:terms|license) as perl"),
    ("public-domain", 3, 0.9, "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 3, 0.9, "this (?:work|file|code|software|program|document) is (?:hereby )?(?:in|a work of) the public domain"),
    ("public-domain", 3, 0.9, "no copyright is claimed in the united states under title 17"),
    ("public-domain", 3, 0.9, "the authors? (?:hereby )?disclaims? copyright to this source code"),
    ("public-domain", 3, 0.9, "no rights reserved"),
    ("permissive", 2, 0.5, "permission is granted to (?:copy|use|anyone to use) .{0,60}?for any purpose"),
    ("permissive", 2, 0.5, "may be (?:freely )?(?:used|copied|distributed|redistributed) without restriction"),
    ("non-commercial", 3, 0.9, "for (?:non ?commercial|personal|academic|research|educational) use only"),
    ("non-commercial", 3, 0.9, "(?:commercial use|use for commercial purposes) is (?:strictly )?(?:prohibited|forbidden|not permitted|not allowed)"),
    ("evaluation", 3, 0.9, "for (?:internal )?evaluation purposes only"),
    ("no-derivatives", 2, 0.5, "may not be (?:modified|altered|translated) without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", 1, 0.5, "all rights reserved"),
    ("proprietary", 1, 0.5, "alle rechte vorbehalten"),
    ("proprietary", 1, 0.5, "tous droits réservés"),
    ("proprietary", 1, 0.5, "todos los derechos reservados"),
    ("proprietary", 2, 0.9, "proprietary and confidential"),
    ("proprietary", 2, 0.9, "confidential and proprietary"),
    ("proprietary", 3, 1.0, "this software is the (?:proprietary|confidential) (?:information|property) of"),
    ("proprietary", 3, 0.9, "contains (?:proprietary|confidential) (?:and (?:proprietary|confidential) )?information"),
    ("proprietary", 3, 0.9, "contains trade secrets"),
    ("proprietary", 3, 0.9, "unauthori[sz]ed (?:copying|use|reproduction|distribution|disclosure) .{0,80}?is (?:strictly )?prohibited"),
    ("proprietary", 3, 0.9, "(?:do not|may not be) (?:copied?|reproduced?|distributed?|redistributed?) .{0,60}?without (?:the )?(?:express |prior )?(?:written )?permission"),
    ("proprietary", 3, 0.9, "no part of this (?:publication|document|book|work|software) may be reproduced"),
    ("proprietary", 3, 0.9, "licensed material property of"),
    ("eula", 3, 1.0, "end user licen[cs]e agreement"),
    ("eula", 3, 0.9, "by (?:installing|downloading|copying|using) (?:the|this) software you (?:agree|accept|are agreeing)"),
    ("eula", 3, 0.9, "this software is licensed not sold"),
    ("us-government", 3, 0.9, "use duplication or disclosure by the (?:u s )?government is subject to restrictions"),
    ("trademark", 1, 0.5, "trademarks? (?:or registered trademarks? )?(?:are|is) the property of (?:its|their) respective owners?"),
    ("warranty", 1, 0.5, "provided as is without warranty of any kind"),
]
#: Identifiers of the public list of licenses, as words; each may be followed by plus, only, or later, and an exception.
IDENTIFIERS = [
    "0bsd", "afl 2 1", "afl 3 0", "agpl 1 0", "agpl 3 0", "apache 1 0", "apache 1 1", "apache 2 0", "apsl 2 0", "artistic 1 0", "artistic 2 0", "beerware", "blueoak 1 0 0", "bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsl 1 0", "busl 1 1", "bzip2 1 0 6",
    "cc by 3 0", "cc by 4 0", "cc by nc 3 0", "cc by nc 4 0", "cc by nc nd 4 0", "cc by nc sa 4 0", "cc by nd 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc0 1 0", "cddl 1 0", "cddl 1 1", "cecill 2 1", "cecill b", "cecill c", "cpal 1 0", "cpl 1 0", "curl", "ecl 2 0", "elastic 2 0",
    "epl 1 0", "epl 2 0", "eupl 1 1", "eupl 1 2", "ftl", "gfdl 1 2", "gfdl 1 3", "gpl 1 0", "gpl 2 0", "gpl 3 0", "hpnd", "icu", "ijg", "ipl 1 0", "isc", "json", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "libpng", "lppl 1 3c", "mit", "mit 0", "mpl 1 0", "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "mulanpsl 2 0",
    "ncsa", "npl 1 1", "ntp", "odbl 1 0", "odc by 1 0", "ofl 1 1", "openssl", "osl 3 0", "pddl 1 0", "php 3 0", "php 3 01", "postgresql", "psf 2 0", "python 2 0", "qpl 1 0", "ruby", "sissl", "sleepycat", "sspl 1 0", "tcl", "unicode dfs 2016", "unlicense", "upl 1 0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl 2 1",
]
