r"""Hand-written signatures of license texts, headers and rights notices.

Each line is ``label | keyword | pattern``.  Patterns match lower-cased words joined by
single spaces; a pattern can't match where its keyword is missing.
"""

from __future__ import annotations

#: Sentences of the license texts themselves.
TEXTS = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit | substantial portions of the software | (?:this|the above copyright notice and this) permission notice shall be included in all copies or substantial portions of the software
mit | liable for any claim damages or other liability | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | without restriction including without limitation | free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | shall not be used in advertising | except as contained in this notice the name of (?:[^ ]+ ){1,6}shall not be used in advertising or otherwise to promote the sale use or other dealings
isc | permission to use copy modify and | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | disclaims all warranties with regard | (?:the author|[^ ]+) disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
hpnd | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions
bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | used to endorse or promote products | neither the names? of (?:[^ ]+ ){1,10}may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | this software is provided by | this software is provided by the (?:[^ ]+ ){1,8}as is and any express or implied warranties
bsd | procurement of substitute goods | direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
apache | grant of copyright license | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you
apache | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
apache | terms and conditions for use reproduction and distribution | terms and conditions for use reproduction and distribution 1 definitions
apache | you may not use this file except in compliance | you may not use this file except in compliance with the license
apache | distributed under the license is distributed on an | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl | this program is free software you can redistribute it | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | the licenses for most software are designed to take away | the licenses for most software are designed to take away your freedom to share and change it
gpl | free copyleft license for software | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | without even the implied warranty of merchantability | but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | you should have received a copy of the gnu general | you should have received a copy of the gnu general public license along with this
gpl | the precise terms and conditions for copying | the precise terms and conditions for copying distribution and modification follow
gpl | everyone is permitted to copy and distribute verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl | this library is free software you can redistribute it | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received a copy of the gnu l | you should have received a copy of the gnu (?:lesser|library) general public license along with this
lgpl | in isolation is not a derivative work | such a work in isolation is not a derivative work of the library
lgpl | work that uses the library | a program that contains no derivative of any portion of the library but is designed to work with the library (?:[^ ]+ ){1,12}is called a work that uses the library
agpl | with it remotely through a computer network | all users interacting with it remotely through a computer network|users who interact with it remotely through a computer network
agpl | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with this
fdl | with no invariant sections | with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts
fdl | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl | this source code form is subject to the terms | this source code form is subject to the terms of the mozilla public license
mpl | contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version
mpl | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
epl | this program and the accompanying materials are made available under | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | constitutes recipient s acceptance of this agreement | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl | subject to the terms of the common development | the contents of this file are subject to the terms of the common development and distribution license
cpl | under the terms of this common public license | the accompanying program is provided under the terms of this common public license
zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | in no event will the authors be held liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
libpng | contributing authors and glenn | the png reference library is supplied as is the contributing authors and glenn randers pehrson|the contributing authors and glenn randers pehrson
boost | obtaining a copy of the software and accompanying documentation covered by this license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic | form of the standard version of | you may make and give away verbatim copies of the source form of the standard version of (?:this|the) package
artistic | artistic control over the development | the copyright holder maintains some semblance of artistic control over the development of the package
psf | psf hereby grants licensee | psf hereby grants licensee a nonexclusive royalty free world wide license
ruby | you may make and give away verbatim copies of the source form of the software | you may make and give away verbatim copies of the source form of the software without restriction
php | this product includes php software | this product includes php software freely available from
openssl | developed by the openssl project | this product includes software developed by the openssl project
ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
wtfpl | you just do what the fuck | you just do what the fuck you want to
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use | anyone is free to copy modify publish use compile sell or distribute this software
cc0 | waives abandons and surrenders | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc0 | the person who associated a work with this deed | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | you must give appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | distribute your contributions under the same license | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | you may not use the material for commercial purposes | noncommercial you may not use the material for commercial purposes
cc-by-nd | you may not distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
odbl | available under the open database license | made available under the open database license
pddl | public domain dedication and license | made available under the public domain dedication and license
ofl | font software may be bundled | the font software may be bundled redistributed and or sold with any software
ofl | reserved font name | with reserved font names?
eupl | licensed under the eupl | licensed under the eupl (?:version )?(?:v )?1(?: [12])?
ms-pl | if you use the software you accept this license | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | reciprocal grants | reciprocal grants for any file you distribute that contains code from the software
apsl | subject to the apple public source license | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
ncsa | to deal with the software without restriction | to deal with the software without restriction including without limitation the rights
afl | licensed under the academic free | licensed under the academic free license
osl | licensed under the open software | licensed under the open software license
postgresql | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
w3c | by obtaining using and or copying this work | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
sleepycat | redistributions in any form must be accompanied by information | redistributions in any form must be accompanied by information on how to obtain complete source code
vim | copies of unmodified vim | you may distribute copies of unmodified vim
vim | unmodified copies of vim | there are no restrictions on distributing unmodified copies of vim
zpl | this software consists of contributions made by zope | this software consists of contributions made by zope corporation
qpl | you may copy this software provided that you distribute the complete | you may copy this software provided that you distribute the complete unmodified software
lppl | distributed and or modified under the conditions of the latex | this work may be distributed and or modified under the conditions of the latex project public license
cecill | governed by the cecill | this software is governed by the cecill (?:[^ ]+ )?license under french law
upl | larger work to which the software is contributed | larger work to which the software is contributed by such licensors
bsl | change date | effective on the change date|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work (?:[^ ]+ ){0,40}change date
sspl | functionality of the program or a modified version available to third parties as a service | if you make the functionality of the program or a modified version available to third parties as a service
elastic | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
openrail | use based restrictions | use based restrictions as referenced in paragraph 5|subject to the use based restrictions
llama | llama materials | you will not use the llama materials or any output or results of the llama materials
beerware | buy me a beer | you can buy me a beer in return
json | used for good not evil | the software shall be used for good not evil
curl | except as contained in this notice the name of a copyright holder | except as contained in this notice the name of a copyright holder shall not be used
icu | associated documentation files the unicode | unicode data files and any associated documentation the data files or unicode software and any associated documentation files the unicode|associated documentation files the unicode
tcl | the authors hereby grant permission to use copy modify distribute | the authors hereby grant permission to use copy modify distribute and license this software
ftl | freetype | portions of this software are copyright (?:[^ ]+ ){1,4}the freetype project
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
bzip2 | product documentation would be appreciated but is not required | an acknowledg(?:e)?ment in the product documentation would be appreciated but is not required
eula | by installing copying or otherwise using | by installing copying or otherwise using the (?:software|product) you agree to be bound
eula | end user licen | end user licen[cs]e agreement
"""

#: Headers and pointers to a license that name it otherwise than "X license".
HEADERS = """
mit | opensource org licenses mit | (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
apache | apache org licenses license | (?:www )?apache org licenses license 2 0(?: txt| html)?
gpl | gnu org licenses gpl | (?:www )?gnu org licenses gpl(?: [23] 0)?(?: txt| html)?
gpl | gnu org copyleft | (?:www )?gnu org copyleft gpl(?: html| txt)?
gpl | gplv | gplv[23](?: only| or later)?
lgpl | gnu org licenses lgpl | (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: txt| html)?
lgpl | lgplv | lgplv[23](?: [01])?
agpl | gnu org licenses agpl | (?:www )?gnu org licenses agpl(?: 3 0)?(?: txt| html)?
agpl | agplv | agplv3
fdl | gnu org licenses fdl | (?:www )?gnu org licenses fdl(?: 1 [0-3])?(?: txt| html)?
bsd | opensource org licenses bsd | (?:www )?opensource org licenses bsd(?: [23] clause| license)?(?: php| html)?
bsd | use of this source code is governed | use of this source code is governed by a bsd style license
mit | use of this source code is governed by an mit | use of this source code is governed by an mit style license
mpl | mozilla org mpl | (?:www )?mozilla org mpl(?: [12] [01])?
epl | eclipse org legal epl | (?:www )?eclipse org legal epl(?: v)?(?: ?[12]0| [12] 0)?(?: html)?
boost | boost org license | (?:www )?boost org license 1 0(?: txt)?
cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa(?: \\d \\d)?
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: \\d \\d)?
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: \\d \\d)?
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc(?: \\d \\d)?
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd(?: \\d \\d)?
cc-by | creativecommons org licenses by | creativecommons org licenses by(?: \\d \\d)?
wtfpl | wtfpl net | (?:www )?wtfpl net
unlicense | unlicense org | unlicense org
ofl | scripts sil org ofl | scripts sil org ofl
odbl | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: \\d \\d)?
isc | isc style | isc style licen[cs]e
mit | mit style | mit style licen[cs]e
bsd | bsd style | bsd style licen[cs]e
gpl | gpl compatible | gpl compatible
gpl | dual licensed under the | dual licensed under the (?:mit|bsd) and gpl
mit | dual licensed under the | dual licensed under the mit
"""

#: Notices about rights that name no license.
NOTICES = """
rights-reserved | all rights reserved | all rights reserved
rights-reserved | alle rechte vorbehalten | alle rechte vorbehalten
rights-reserved | tous droits | tous droits r\u00e9serv\u00e9s
rights-reserved | todos los derechos | todos los derechos reservados
proprietary | proprietary and confidential | proprietary and confidential
proprietary | unauthorized copying of this | unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited
proprietary | may not be reproduced | (?:no part of this (?:publication|work|document|book) )?may not be reproduced (?:stored )?(?:or )?(?:distributed |transmitted )?(?:in any form )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)
proprietary | no part of this | no part of this (?:publication|work|document|book) may be reproduced
public-domain | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | this work is in the public | this work is in the public domain
public-domain | no rights reserved | no rights reserved
permission | used with permission | used with permission
permission | reprinted with | reprinted with (?:the )?(?:kind )?permission
noncommercial | non commercial use only | for (?:personal and )?non commercial use only
noncommercial | noncommercial use only | for (?:personal and )?noncommercial use only
research-only | research purposes only | for research purposes only
"""


def lines(block: str) -> list[tuple[str, str, str]]:
    """Label, keyword and pattern of every line of a block."""
    return [tuple(part.strip() for part in line.split(" | ", 2)) for line in block.strip().splitlines()]
