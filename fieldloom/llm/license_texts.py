"""Signatures of licence texts, notices and claims, written by hand: sentences that stand in one kind of text only.

A line is a label and the sentence's words, in the notation of ``license_rules.Rule``. Sections give priority and weight.
"""

from __future__ import annotations

import re

#: Full licence texts: a sentence names its licence.
TEXTS = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | except as contained in this notice the (name|names) of the? (x|above)? (consortium|copyright)? (holders|holder)? shall not be used in advertising or otherwise to promote the sale
x11 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
isc | permission to use copy modify and (distribute|or) distribute? this software for any purpose with or without fee is hereby granted
isc | provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties
isc | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-2 | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3 | neither the name of the (copyright|university|organization|regents|author|authors|company) holder? nor the names of its contributors may be used to endorse or promote products
bsd-3 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | the name of the author may not be used to endorse or promote products derived from this software
bsd-4 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4 | this product includes software developed by the university of california berkeley and its contributors
bsd | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | in no event shall the copyright (owner|holder|holders) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
bsd | this software is provided by the regents and contributors as is and any express or implied warranties
bsd-source | use of this software in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-clear | no express or implied licenses to any party s patent rights are granted by this license
bsd-nuclear | you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
bsd-patent | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
ncsa | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
ncsa | to deal with the software without restriction including without limitation the rights to use copy modify merge
apache-1.1 | the end user documentation included with the redistribution if any must include the following acknowledgment
apache-1.1 | this product includes software developed by the apache software foundation
apache-1.1 | products derived from this software may not be called apache nor may apache appear in their name
apache-2 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | see the license for the specific language governing permissions and limitations under the license
apache-2 | www apache org licenses license 2 0
apache-2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit
apache-2 | you must cause any modified files to carry prominent notices stating that you changed the files
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | this program is distributed in the hope that it will be useful but without any warranty
gpl | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl | you should have received a copy of the gnu general public license along with this program
gpl | either version # of the license or at your option any later version
gpl | this program comes with absolutely no warranty
gpl | this is free software and you are welcome to redistribute it under certain conditions
gpl-2 | the licenses for most software are designed to take away your freedom to share and change it
gpl-2 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-2 | activities other than copying distribution and modification are not covered by this license they are outside its scope
gpl-2 | accompany it with the complete corresponding machine readable source code
gpl-3 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
gpl-3 | no covered work shall be deemed part of an effective technological measure under any applicable law
gpl-3 | you may convey verbatim copies of the program s source code as you receive it in any medium
gpl-3 | a user product is either a consumer product which means any tangible personal property
gpl-3 | each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims
gpl-3 | moreover your license from a particular copyright holder is reinstated permanently
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
lgpl | you should have received a copy of the gnu (lesser|library) general public license along with this (library|program)
lgpl-2 | this license the library general public license applies to some specially designated free software foundation software
lgpl-2.1 | this license the lesser general public license applies to some specially designated software packages
lgpl-2.1 | a work that uses the library with the library to produce a work containing portions of the library
lgpl-3 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl-3 | a combined work is a work produced by combining or linking an application with the library
agpl-3 | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation
agpl-3 | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3 | you should have received a copy of the gnu affero general public license along with this program
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections no front cover texts and no back cover texts
gpl-exception | as a special exception to the gnu general public license if you distribute this file as part of a program
gpl-exception | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
classpath | permission to copy and distribute the resulting executable under terms of your choice
font-exception | if you create a document which uses this font and embed this font or unaltered portions of this font into the document
autoconf | this file is free software the free software foundation gives unlimited permission to copy and or distribute it
autoconf | this configure script is free software the free software foundation gives unlimited permission to copy
bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license
mpl-1.1 | the initial developer of the original code is
mpl-1.1 | alternatively the contents of this file may be used under the terms of either the gnu general public license
mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
cddl | the contents of this file are subject to the terms of the common development and distribution license
cddl | when distributing covered code include this cddl header in each file
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | the accompanying program is provided under the terms of this eclipse public license
epl-2 | this source code may also be made available under the following secondary licenses when the conditions for such availability
edl | this program and the accompanying materials are made available under the terms of the eclipse distribution license
cpl | the accompanying program is provided under the terms of this common public license
ipl | the accompanying program is provided under the terms of this ibm public license
eupl | licensed under the eupl version 1 # or as soon they will be approved by the european commission
eupl | unless required by applicable law or agreed to in writing software distributed under the licence is distributed on an as is basis
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | this (program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself
bsl | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | the png reference library is supplied as is the contributing authors
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
wtfpl | do what the fuck you want to public license terms and conditions for copying distribution and modification
wtfpl | you just do what the fuck you want to
beerware | as long as you retain this notice you can do whatever you want with this stuff if we meet some day
cc0 | to the extent possible under law the person who associated cc0 with this work has waived all copyright
cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-by | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
cc | this work is licensed under (a|the) creative commons
cc | to view a copy of this license visit https? creativecommons org
cc | or send a letter to creative commons po box 1866 mountain view
cc | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons
cc-sampling | you are free to sample mash up or otherwise creatively transform this work
ofl | this font software is licensed under the sil open font license
ofl | the fonts including any derivative works can be bundled embedded redistributed and or sold with any software
ofl | no modified version of the font software may use the reserved font name
odbl | you are free to share to create and to adapt as long as you attribute share alike and keep open
odbl | any use of the database or works produced from the database in the manner specified in the odbl
odc-by | this data is made available under the open data commons attribution license
pddl | this data is made available under the public domain dedication and license
psf | this license agreement is between the python software foundation and the individual or organization licensee
psf | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform
cnri | this license agreement is between the corporation for national research initiatives having an office at
beopen | this license agreement is between beopen com having an office at
php | products derived from this software may not be called php nor may php appear in their name
php | this product includes php software freely available from
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | the names openssl toolkit and openssl project must not be used to endorse or promote products
ssleay | this product includes cryptographic software written by eric young
ssleay | the licence and distribution terms for any publically available version or derivative of this code cannot be changed
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
tk | government use if you are acquiring this software on behalf of the u s government
vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text
ruby | you may make and give away verbatim copies of the source form of the software without restriction
icu | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies of the software
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that
cecill | this agreement is a free software license agreement that is the result of discussions between its authors
cecill | ce logiciel est regi par la licence cecill soumise au droit francais
cecill | this software is governed by the cecill license under french law and abiding by the rules of distribution of free software
sspl | if you make the functionality of the program or a modified version available to third parties as a service
busl | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl | effective on the change date or the fourth anniversary of the first publicly available distribution
elastic-2 | you may not provide the software to third parties as a hosted or managed service
elastic-2 | you may not move change disable or circumvent the license key functionality in the software
polyform | the licensor grants you a copyright license for the software to do everything you might do with the software
commons-clause | the license does not grant to you the right to sell the software
commons-clause | without limiting other conditions in the license the grant of rights under the license will not include
upl | to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights
json | the software shall be used for good not evil
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | for any file you distribute that contains code from the software in source code or binary format
osl | licensed under the open software license version
afl | licensed under the academic free license version
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
jasper | jasper software license and may not be used except as expressly permitted
fsf-all-permissive | copying and distribution of this file with or without modification are permitted in any medium without royalty
gnu-verbatim | permission is granted to make and distribute verbatim copies of this manual provided the copyright notice
gnu-verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lppl | this work may be distributed and or modified under the conditions of the latex project public license
lppl | the latex project public license maintained status
ijg | this software is based in part on the work of the independent jpeg group
freetype | portions of this software are copyright the freetype project
ftl | the freetype project is distributed under two licenses
naumen | naumen public license this software is copyright
sissl | the contents of this file are subject to the sun industry standards source license
rpl | unless explicitly acquired and licensed from licensor under another license the contents of this file are subject to the reciprocal public license
w3c | this work and any related software and documentation is being provided by the copyright holders under the following license
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood
ogl | you are free to copy publish distribute and transmit the information
ogl | contains public sector information licensed under the open government licence
etalab | la reutilisation gratuite de l information objet de la licence
dl-de | datenlizenz deutschland namensnennung version
rail | you agree not to use the model or derivatives of the model in any way that violates any applicable
llama | community license copyright c? meta platforms inc all rights
"""

#: Claims and notices outside licence texts.
NOTICES = """
reserved-long | no part of this (publication|book|document|work|site|page) may be reproduced (stored|distributed|copied|or|in)
reserved-long | may not be reproduced in whole or in part without (the)? (prior|express|written) (written)? (permission|consent)
reserved-long | reproduction in whole or in part without (written|prior|express)? (written)? permission is (strictly)? prohibited
reserved-long | tous droits reserves
reserved-long | todos los derechos reservados
reserved-long | alle rechte vorbehalten
reserved-long | tutti i diritti riservati
reserved-long | todos os direitos reservados
confidential | this (document|file|message|software|material) contains (confidential|proprietary) (and)? (proprietary|confidential)? information
confidential | this source code is confidential and proprietary
confidential | trade secrets? and confidential information of
confidential | the information contained in this (e)? (mail|message) is (confidential|privileged)
confidential | if you are not the intended recipient
proprietary | this software is the (confidential|proprietary|exclusive) and? (proprietary|property)? (information|property)? of
proprietary | use of this (software|file|source) (code)? is (governed|restricted) by (the)? (terms)? (of)? (a|your|the)? (license|licence)? agreement
proprietary | decompile disassemble or (otherwise)? reverse engineer
eula | end user license agreement
eula | by (installing|downloading|clicking|copying|using) (copying)? (or)? (otherwise)? (using)? the software you agree to be bound by
eula | this is a legal agreement between you and
eula | you may install and use one copy of the software
trademark | is a registered trademark of
trademark | are (registered)? trademarks of their respective owners
trademark | all (other)? trademarks are the property of their respective owners
patent | protected by (one or more)? (united states)? (u s)? patents
patent | patents? pending
government | restricted rights legend use duplication or disclosure by the government
government | this is a work of the united states government and is not subject to copyright protection
government | crown copyright
public-domain | this (work|file|code|software|document|image) is in the public domain
public-domain | the author (hereby)? (disclaims|places|puts|releases) (copyright)? (this|to|all)
public-domain | this image is in the public domain because
public-domain | gemeinfrei
public-domain | domaine public
non-commercial | for non commercial use only
non-commercial | free for (personal|educational|academic|private) (and|or)? (non)? (commercial|personal|educational|academic)? use
non-commercial | not (be)? (for|used) (for)? (resale|sale|commercial) (purposes|use)?
non-commercial | commercial use (is)? (strictly)? (prohibited|forbidden) without
academic | for research purposes only
academic | free of charge for academic use
evaluation | for evaluation purposes only
shareware | this is (a)? shareware (program|version)
freeware | this (program|software) is freeware
terms | subject to the terms and conditions of
terms | terms of (use|service) and (our)? privacy policy
terms | your use of this (site|website|service) constitutes (your)? acceptance
reprint | reprinted (here)? (by|with) (kind)? permission
reprint | used (here)? (by|with) (kind)? permission (of|from)
reprint | originally published (in|by|on)
attribution | please (credit|attribute|cite) the (author|source|original)
attribution | if you use this (code|data|dataset|work|software) please cite
share-alike | share alike? (license)? under the same (license|terms)
dual | dual licensed under the
dual | licensed under (either|any) of
dual | available under (a)? (commercial|proprietary) (license|licence)
contribution | by contributing you agree that your contributions will be licensed under
contribution | unless you explicitly state otherwise any contribution intentionally submitted for inclusion
contribution | developer s? certificate of origin
dmca | digital millennium copyright act
dmca | in response to a complaint we received under the
fair-use | copyright disclaimer under section 107
fair-use | allowance is made for fair use for purposes such as criticism
no-scraping | scraping (or)? (crawling)? (of)? (this)? (site|website)? (is|are) (expressly|strictly)? (prohibited|reserved|forbidden)
no-scraping | text and data mining (is|are|rights) (expressly|strictly)? (prohibited|reserved|forbidden)
no-ai | may not be used (to|for) (train|training) (or)? (develop)? (artificial|machine|ai|any)
liability | in no event shall
liability | as is without warranties? or conditions of any kind
liability | to the maximum extent permitted by (applicable)? law
liability | at your own risk
"""

#: Words that stand in too many texts to gate a rule.
FREQUENT = frozenset(
    "software license licence copyright permission conditions following provided including documentation distribution distributed information public warranty "
    "warranties version without agreement original modification notice general material available purposes applicable contributors".split()
)


def keyword(words: str) -> str:
    """The longest plain word of a sentence that isn't frequent; the longest one where all are."""
    plain = [w for w in re.findall(r"\([^)]*\)\??|\S+", words) if w.isalpha()]
    rare = [w for w in plain if w not in FREQUENT]
    return max(rare or plain, key=len)


def signatures() -> list[tuple[str, str, str, int, float]]:
    """Label, words, keyword, priority and weight of each signature; a longer sentence goes before a shorter one."""
    out = []
    for text, priority, weight in ((TEXTS, 10, 1.0), (NOTICES, 55, 0.5)):
        for line in text.strip().splitlines():
            label, words = line.split(" | ")
            out.append((label, words, keyword(words), priority - (len(words.split()) > 30), weight))
    return out
