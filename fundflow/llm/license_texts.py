"""Signatures taken from the license texts themselves.

Each is a phrase that stands in the text, header or notice of one license, as
a regular expression over the normal form (lower-cased words separated by one
space; a hyphen, point or apostrophe separates words).  They are ordered by
kind: grants and headers decide, conditions support, warranty clauses hint.
"""

from __future__ import annotations

#: Label and pattern.  A text that holds one of these grants that license or declares it.
GRANTS = (
    # MIT and relatives
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-modern", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("json", r"the software shall be used for good not evil"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that the above copyright notice appear in all copies"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("mit-0", r"mit no attribution"),
    ("icu", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("unicode", r"unicode (?:inc )?license agreement data files and software"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use"),
    ("w3c", r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("gnu-all-permissive", r"this file is offered as is without any warranty"),
    ("fsful", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    ("fsfullr", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved"),
    ("x11-distribute", r"distribute with modifications sublicense and or sell copies of the software"),
    ("bitstream-vera", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("ofl", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", r"permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell"),
    # BSD and relatives
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable patent license"),
    ("bsd-protection", r"this license is specifically designed to ensure that the program remains free"),
    ("intel", r"licensed under the intel open source license"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", r"this package is an ssl implementation written by eric young"),
    ("php", r"this product includes php software freely available from"),
    ("zend", r"this product includes the zend engine freely available"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee subject to the following restrictions"),
    ("bzip2", r"this program bzip2 the associated library libbzip2 and all documentation"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("libtiff", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", r"use modification and distribution (?:are|is) subject to the boost software license"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("python", r"the psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("python-cnri", r"cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    ("beopen", r"beopen hereby grants licensee a non exclusive royalty free world wide license"),
    ("zpl", r"this software is subject to the provisions of the zope public license"),
    # Apache
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", r"you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("ecl-2.0", r"licensed under the educational community license version 2 0"),
    # GNU
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", r"either version 3 of the license or at your option any later version"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc-exception", r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-autoconf", r"as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts that are the output of autoconf"),
    ("gpl-bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font", r"as a special exception if you create a document which uses this font and embed this font"),
    ("gpl-libtool", r"if you distribute this file as part of a program or library that is built using gnu libtool"),
    ("linux-syscall", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("gpl", r"may be distributed under the terms of the gnu general public license"),
    ("gpl", r"alternatively this software may be distributed under the terms of the gnu general public license gpl"),
    ("dual-bsd-gpl", r"module license dual bsd gpl"),
    ("gpl", r"module license gpl(?: v2)?"),
    # Mozilla, Eclipse and others with file-level terms
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0 the license"),
    ("npl", r"the contents of this file are subject to the netscape public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("edl", r"which is available at http(?:s)? www eclipse org org documents edl v10"),
    ("cpl-1.0", r"this program and the accompanying materials are made available under the terms of the common public license v1 0"),
    ("ipl-1.0", r"accompanying program is provided under the terms of this ibm public license"),
    ("eupl", r"licensed under the eupl version 1 (?:0|1|2)"),
    ("eupl", r"this european union public licence the eupl applies to the work"),
    ("osl", r"licensed under the open software license version"),
    ("afl", r"licensed under the academic free license version"),
    ("cecill", r"this software is governed by the cecill(?: b| c)? license under french law and abiding by the rules of distribution of free software"),
    ("qpl", r"this file may be distributed under the terms of the q public license"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("artistic", r"this package is free software you can redistribute it and or modify it under the (?:terms of the )?artistic license"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-perl", r"this (?:program|library|module) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("rpl", r"unless explicitly acquired and licensed from licensor under another license the contents of this file are subject to the reciprocal public license"),
    ("upl", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("osgi", r"licensed under the osgi specification license"),
    ("oracle-berkeley", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    # Public domain
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
    ("cc0", r"to the extent possible under law (?:the author|the person who associated cc0 with this work|the authors?) (?:has|have) (?:waived|dedicated) all copyright and related"),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("public-domain", r"this (?:file|software|code|work|program) (?:is|has been) (?:hereby )?(?:placed|released|put|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", r"no copyright is claimed and the author hereby places it into the public domain"),
    ("public-domain-us-government", r"pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection and is in the public domain"),
    ("blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("sax-pd", r"i hereby abandon any property rights to sax"),
    # Creative Commons and data
    ("cc-by", r"this work is licensed under (?:the|a) creative commons attribution (?:(?:1|2|2 5|3|4) 0 )?(?:international |unported |generic )?license"),
    ("cc-by-sa", r"this work is licensed under (?:the|a) creative commons attribution share ?alike (?:(?:1|2|2 5|3|4) 0 )?(?:international |unported |generic )?license"),
    ("cc-by-nc", r"this work is licensed under (?:the|a) creative commons attribution non ?commercial (?:(?:1|2|2 5|3|4) 0 )?(?:international |unported |generic )?license"),
    ("cc-by-nd", r"this work is licensed under (?:the|a) creative commons attribution no ?deriv(?:ative)?s (?:(?:1|2|2 5|3|4) 0 )?(?:international |unported |generic )?license"),
    ("cc-by-nc-sa", r"this work is licensed under (?:the|a) creative commons attribution non ?commercial share ?alike (?:(?:1|2|2 5|3|4) 0 )?(?:international |unported |generic )?license"),
    ("cc-by", r"creativecommons org licenses by (?:1|2|3|4) 0"),
    ("cc-by-sa", r"creativecommons org licenses by sa (?:1|2|3|4) 0"),
    ("cc-by-nc", r"creativecommons org licenses by nc (?:1|2|3|4) 0"),
    ("cc-by-nd", r"creativecommons org licenses by nd (?:1|2|3|4) 0"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa (?:1|2|3|4) 0"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd (?:1|2|3|4) 0"),
    ("cc0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution"),
    ("odbl", r"is made available under the open database license"),
    ("odc-by", r"is made available under the open data commons attribution license"),
    ("pddl", r"is made available under the public domain dedication and license"),
    ("cdla-permissive", r"this data is made available under the community data license agreement permissive"),
    ("cdla-sharing", r"this data is made available under the community data license agreement sharing"),
    ("ogl-uk", r"contains public sector information licensed under the open government licence"),
    ("etalab", r"licence ouverte open licence"),
    # Source available
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", r"use of this software is governed by the business source license included in the"),
    ("elastic-2.0", r"licensed under the elastic license 2 0 you may not use this file except in compliance"),
    ("elastic", r"or more contributor license agreements licensed under the elastic license"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", r"any noncommercial purpose is a permitted purpose"),
    ("confluent-community", r"licensed under the confluent community license"),
    ("openrail", r"use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("proprietary", r"this software is the confidential and proprietary information of"),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document|program)(?: via any medium)? is strictly prohibited"),
    ("proprietary", r"this (?:software|source code|document) contains proprietary and confidential information"),
    ("proprietary", r"no part of this (?:publication|document|book|software) may be reproduced (?:stored in a retrieval system or transmitted )?(?:distributed )?(?:in any form|without)"),
    ("proprietary", r"you may not (?:copy modify|reverse engineer decompile) or (?:distribute|disassemble) (?:this|the) software"),
    ("nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights in and to this software"),
    ("microsoft-eula", r"these license terms are an agreement between microsoft corporation or based on where you live one of its affiliates and you"),
)

#: Conditions that stand in few licenses.
CONDITIONS = (
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", r"neither the name of [a-z0-9 ]{1,80}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", r"this notice may not be removed or altered from any source distribution"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-1.1", r"the names apache and apache software foundation must not be used to endorse or promote products derived from this software"),
    ("gpl", r"if any portion of this section is held invalid or unenforceable under any particular circumstance the balance of the section is intended to apply"),
    ("gpl-2.0", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-3.0", r"the source code for a work means the preferred form of the work for making modifications to it"),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl", r"a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it"),
    ("mpl-1.1", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("mpl-2.0", r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", r"each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license to reproduce prepare derivative works of publicly display"),
    ("cddl", r"when distributing covered code include this cddl header in each file"),
    ("bsl-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("ofl", r"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself|no reserved font name may be used by modified versions"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("php", r"the name php must not be used to endorse or promote products derived from this software without prior written permission"),
    ("openssl", r"the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("w3c", r"notice of any changes or modifications through a copyright statement on the new code or document"),
    ("python", r"licensee agrees to include in any such work a brief summary of the changes made to python"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license"),
    ("artistic", r"you may otherwise modify your copy of this package in any way provided that you insert a prominent notice in each changed file"),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("odbl", r"you must keep intact any copyright or database right notices"),
    ("sspl", r"service source code means the corresponding source for the program or the modified version"),
    ("busl", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
)

#: Warranty and liability clauses, typical of a family.
WARRANTIES = (
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("bsd", r"this software is provided by the (?:copyright holders? and contributors|author|regents and contributors) as is and any express or implied warranties"),
    ("bsd", r"in no event shall the (?:copyright (?:owner|holder)s?(?: or contributors)?|author|regents or contributors) be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", r"there is no warranty for the program to the extent permitted by applicable law"),
    ("gpl-2.0", r"because the program is licensed free of charge there is no warranty for the program"),
    ("mpl-2.0", r"covered software is provided under this license on an as is basis without warranty of any kind"),
    ("epl", r"except as expressly set forth in this agreement the program is provided on an as is basis"),
    ("apache-2.0", r"in no event and under no legal theory whether in tort including negligence contract or otherwise unless required by applicable law"),
    ("postgresql", r"the university of california specifically disclaims any warranties"),
    ("python", r"psf is making python available to licensee on an as is basis"),
    ("artistic", r"this package is provided as is and without any express or implied warranties"),
    ("wtfpl", r"this program is free software it comes without any warranty to the extent permitted by applicable law"),
    ("ms-pl", r"the software is licensed as is you bear the risk of using it"),
    ("ofl", r"the font software is provided as is without warranty of any kind"),
    ("cc0", r"affirmer offers the work as is and makes no representations or warranties of any kind concerning the work"),
)

#: Priority and confidence of each kind.
KINDS = ((GRANTS, 5, 0.95), (CONDITIONS, 4, 0.8), (WARRANTIES, 3, 0.5))
