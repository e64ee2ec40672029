"""The signature rules of the license scan, written by hand, in order.

A line is: label, priority, keyword, pattern. Patterns see words in lower case joined by blanks, so "2.0" is "2 0". The
keyword is a word that every match of the pattern holds, and one that plain prose seldom has.
"""

RULES_TEXT = r"""
mit 60 mit mit licen[cs]e
mit 80 mit (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit 95 spdx spdx license identifier mit
mit 90 sublicense permission is hereby granted free of charge to any person obtaining a copy .{0,400}sublicense and or sell
mit 85 hereby permission is hereby granted free of charge to any person obtaining a copy
mit 85 notice the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit 80 opensource opensource org licenses mit(?: license)?(?: php)?
mit 70 expat expat licen[cs]e
mit-0 95 spdx spdx license identifier mit 0
mit-0 85 attribution mit no attribution(?: licen[cs]e)?
x11 80 x11 x11 licen[cs]e
x11 85 consortium except as contained in this notice the name of the x consortium shall not be used in advertising
apache 60 apache apache licen[cs]e
apache 60 apache apache software licen[cs]e
apache 85 apache apache licen[cs]e (?:version |v ?)?2 0
apache 85 apache apache 2 0 licen[cs]e
apache 84 apache apache software license (?:version )?1 1
apache 84 apache apache software license (?:version )?1 0
apache 95 spdx spdx license identifier apache 2 0
apache 95 spdx spdx license identifier apache 1 1
apache 92 apache licensed under the apache licen[cs]e
apache 90 compliance you may not use this file except in compliance with the license
apache 88 apache apache org licenses license 2 0(?: txt| html)?
apache 82 applicable unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache 82 apache this product includes software developed by the apache software foundation
apache 70 asl asl 2 0
gpl 60 general general public licen[cs]e
gpl 62 gnu gnu general public licen[cs]e
gpl 50 gpl gpl
gpl 70 gnu gnu gpl
gpl 85 gpl gpl (?:v ?)?1(?: 0)?(?: only| or later)?
gpl 85 gpl gpl (?:v ?)?2(?: 0)?(?: only| or later)?
gpl 85 gpl gpl (?:v ?)?3(?: 0)?(?: only| or later)?
gpl 86 gnu gnu general public licen[cs]e (?:version |v ?)1
gpl 86 gnu gnu general public licen[cs]e (?:version |v ?)2
gpl 86 gnu gnu general public licen[cs]e (?:version |v ?)3
gpl 92 gnu gnu general public license as published by the free software foundation
gpl 94 redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl 90 gnu you should have received a copy of the gnu general public licen[cs]e
gpl 80 gpl2 gpl2(?: only| or later)?
gpl 80 gpl3 gpl3(?: only| or later)?
gpl 80 gplv2 gplv2(?: only| or later)?
gpl 80 gplv3 gplv3(?: only| or later)?
gpl 95 spdx spdx license identifier gpl 1 0(?: only| or later)?
gpl 95 spdx spdx license identifier gpl 2 0(?: only| or later)?
gpl 95 spdx spdx license identifier gpl 3 0(?: only| or later)?
gpl 94 spdx spdx license identifier gpl 3 or later
gpl 88 gnu gnu org licenses (?:old licenses )?gpl(?: 2 0| 3 0)?(?: txt| html)?
gpl 80 classpath gpl (?:version )?2 (?:0 )?with (?:the )?classpath exception
gpl 75 copyleft gpl style copyleft
lgpl 50 lgpl lgpl
lgpl 70 lesser lesser general public licen[cs]e
lgpl 71 gnu gnu lesser general public licen[cs]e
lgpl 71 gnu gnu library general public licen[cs]e
lgpl 86 lesser lesser general public licen[cs]e (?:version |v ?)2 1
lgpl 86 lesser lesser general public licen[cs]e (?:version |v ?)3
lgpl 86 library library general public licen[cs]e (?:version |v ?)2
lgpl 85 lgpl lgpl (?:v ?)?2 1(?: only| or later)?
lgpl 85 lgpl lgpl (?:v ?)?3(?: 0)?(?: only| or later)?
lgpl 95 spdx spdx license identifier lgpl 2 0(?: only| or later)?
lgpl 95 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl 95 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl 94 redistribute this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl 80 lgplv2 lgplv2(?: 1)?(?: or later)?
lgpl 80 lgplv3 lgplv3(?: or later)?
agpl 50 agpl agpl
agpl 72 affero affero general public licen[cs]e
agpl 73 gnu gnu affero general public licen[cs]e
agpl 86 affero affero general public licen[cs]e (?:version |v ?)3
agpl 84 affero affero general public licen[cs]e (?:version |v ?)1
agpl 85 agpl agpl (?:v ?)?3(?: 0)?(?: only| or later)?
agpl 95 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl 80 agplv3 agplv3(?: or later)?
fdl 60 gfdl gfdl
fdl 72 documentation gnu free documentation licen[cs]e
fdl 86 documentation gnu free documentation licen[cs]e (?:version |v ?)1 [123]
fdl 90 invariant with no invariant sections no front cover texts and no back cover texts
fdl 95 spdx spdx license identifier gfdl 1 [123](?: only| or later)?
bsd 60 bsd bsd licen[cs]e
bsd 65 bsd bsd style licen[cs]e
bsd 70 berkeley berkeley software distribution
bsd 85 bsd (?:new|modified|revised) bsd licen[cs]e
bsd 85 bsd simplified bsd licen[cs]e
bsd 85 bsd original bsd licen[cs]e
bsd 84 bsd (?:2|two) clause bsd(?: licen[cs]e)?
bsd 84 bsd (?:3|three) clause bsd(?: licen[cs]e)?
bsd 84 bsd (?:4|four) clause bsd(?: licen[cs]e)?
bsd 84 bsd bsd (?:2|two) clause(?: licen[cs]e)?
bsd 84 bsd bsd (?:3|three) clause(?: licen[cs]e)?
bsd 84 bsd bsd (?:4|four) clause(?: licen[cs]e)?
0bsd 85 bsd (?:0|zero) clause bsd(?: licen[cs]e)?
0bsd 85 0bsd 0bsd
bsd 95 spdx spdx license identifier bsd [234] clause
0bsd 95 spdx spdx license identifier 0bsd
bsd 90 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 88 redistributions redistributions of source code must retain the above copyright notice this list of conditions
bsd 88 redistributions redistributions in binary form must reproduce the above copyright notice
bsd 88 contributors neither the name of .{1,80} nor the names of (?:its|their|any) contributors may be used to endorse
bsd 86 advertising all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc 60 isc isc licen[cs]e
isc 95 spdx spdx license identifier isc
isc 90 hereby permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 88 hereby permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
mpl 50 mpl mpl
mpl 70 mozilla mozilla public licen[cs]e
mpl 86 mozilla mozilla public licen[cs]e (?:version |v ?)?2 0
mpl 86 mozilla mozilla public licen[cs]e (?:version |v ?)?1 1
mpl 86 mozilla mozilla public licen[cs]e (?:version |v ?)?1 0
mpl 85 mpl mpl (?:v ?)?[12] [01]
mpl 95 spdx spdx license identifier mpl [12] [01]
mpl 92 mozilla this source code form is subject to the terms of the mozilla public licen[cs]e
mpl 88 mozilla mozilla org mpl(?: mpl)?(?: 2 0)?
npl 80 netscape netscape public licen[cs]e
epl 70 eclipse eclipse public licen[cs]e
epl 86 eclipse eclipse public licen[cs]e (?:version |v ?)?[12] 0
epl 95 spdx spdx license identifier epl [12] 0
epl 88 eclipse eclipse org legal epl v10(?: html)?
edl 80 eclipse eclipse distribution licen[cs]e
cpl 75 common common public licen[cs]e
cpl 86 common common public licen[cs]e (?:version |v ?)?(?:0 5|1 0)
ipl 80 ibm ibm public licen[cs]e
cddl 60 cddl cddl(?: 1 [01])?
cddl 80 development common development and distribution licen[cs]e
cddl 95 spdx spdx license identifier cddl 1 [01]
eupl 60 eupl eupl(?: v? ?1 [012])?
eupl 80 european european union public licen[cs]e
eupl 95 spdx spdx license identifier eupl 1 [12]
artistic 75 artistic artistic licen[cs]e
artistic 86 artistic artistic licen[cs]e (?:version )?2 0
artistic 84 perl under the same terms as perl itself
artistic 95 spdx spdx license identifier artistic [12] 0
ofl 75 font (?:sil )?open font licen[cs]e
ofl 86 font (?:sil )?open font licen[cs]e (?:version )?1 [01]
ofl 95 spdx spdx license identifier ofl 1 [01]
ofl 86 reserved with reserved font name
osl 80 open open software licen[cs]e (?:version |v ?)?[123] [01]
osl 95 spdx spdx license identifier osl [123] [01]
afl 80 academic academic free licen[cs]e(?: (?:version |v ?)?[123] [012])?
afl 95 spdx spdx license identifier afl [123] [012]
boost 80 boost boost software licen[cs]e(?: (?:version )?1 0)?
boost 95 spdx spdx license identifier bsl 1 0
boost 88 boost boost org license 1 0 txt
cecill 70 cecill cecill(?: [abc])?(?: (?:version |v ?)?[12] [01])?
php 80 php php licen[cs]e(?: (?:version )?3 0?1?)?
python 80 python python software foundation licen[cs]e(?: (?:version )?2)?
python 75 psf psf licen[cs]e(?: agreement)?
python 86 cnri cnri open source licen[cs]e agreement
ruby 75 ruby ruby licen[cs]e
ruby 84 ruby under the same terms as ruby(?: itself)?
zpl 80 zope zope public licen[cs]e(?: (?:version )?[12] [01])?
ms-pl 82 microsoft microsoft public licen[cs]e
ms-rl 82 microsoft microsoft reciprocal licen[cs]e
ms-pl 95 spdx spdx license identifier ms pl
ms-rl 95 spdx spdx license identifier ms rl
zlib 75 zlib zlib licen[cs]e
zlib 76 zlib zlib libpng licen[cs]e
zlib 95 spdx spdx license identifier zlib
zlib 88 implied this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 88 misrepresented the origin of this software must not be misrepresented
libpng 80 libpng libpng licen[cs]e
unlicense 80 unlicense the unlicense
unlicense 86 unlicense unlicense org
unlicense 95 spdx spdx license identifier unlicense
unlicense 90 unencumbered this is free and unencumbered software released into the public domain
wtfpl 70 wtfpl wtfpl
wtfpl 82 fuck do what the fuck you want to public licen[cs]e
postgresql 80 postgresql postgresql licen[cs]e
postgresql 95 spdx spdx license identifier postgresql
beerware 75 beerware beerware(?: licen[cs]e)?
beerware 80 beer beer ware licen[cs]e
beerware 88 beer if we meet some day and you think this stuff is worth it you can buy me a beer
ncsa 80 ncsa (?:university of illinois )?ncsa open source licen[cs]e
ncsa 95 spdx spdx license identifier ncsa
openssl 80 openssl openssl licen[cs]e
openssl 86 openssl this product includes software developed by the openssl project
curl 80 curl curl licen[cs]e
vim 80 vim vim licen[cs]e
json 80 json json licen[cs]e
json 86 evil the software shall be used for good not evil
sleepycat 80 sleepycat sleepycat licen[cs]e
qpl 80 trolltech q public licen[cs]e .{0,60}trolltech
apsl 82 apple apple public source licen[cs]e(?: (?:version )?[12] [012])?
rpl 82 reciprocal reciprocal public licen[cs]e(?: (?:version )?1 [15])?
upl 82 universal universal permissive licen[cs]e(?: (?:version )?1 0)?
bsl 82 business business source licen[cs]e(?: (?:version )?1 1)?
bsl 90 licensor the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl 82 server server side public licen[cs]e(?: (?:version |v ?)?1)?
elastic 82 elastic elastic licen[cs]e(?: (?:version )?2 0)?
confluent 82 confluent confluent community licen[cs]e
commons-clause 84 clause commons clause licen[cs]e condition(?: v1 0)?
blueoak 84 oak blue oak model licen[cs]e(?: 1 0 0)?
mulan 82 mulan mulan permissive software licen[cs]e(?: (?:version )?[12])?
hippocratic 82 hippocratic hippocratic licen[cs]e(?: (?:version )?[123])?
parity 82 parity parity public licen[cs]e(?: 7 0)?
polyform 82 polyform polyform (?:noncommercial|strict|small business|shield|perimeter) licen[cs]e(?: 1 0 0)?
openrail 82 openrail (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
llama 82 llama llama (?:[23] )?community licen[cs]e(?: agreement)?
odbl 82 database open (?:data commons )?database licen[cs]e
odbl 80 odbl odbl(?: 1 0)?
odc-by 82 commons open data commons attribution licen[cs]e
pddl 82 dedication (?:open data commons )?public domain dedication and licen[cs]e
cdla 82 community community data licen[cs]e agreement (?:permissive|sharing)
ogl 82 government open government licen[cs]e(?: v?[123](?: 0)?)?
cc0 70 cc0 cc0(?: 1 0)?(?: universal)?
cc0 86 creativecommons creativecommons org publicdomain zero(?: 1 0)?
cc0 95 spdx spdx license identifier cc0 1 0
cc-by 84 commons creative commons attribution(?: (?:international|unported))?(?: licen[cs]e)?(?! (?:noncommercial|non commercial|sharealike|share alike|noderiv|no deriv))
cc-by 84 commons creative commons attribution [1234] [05](?: (?:international|unported|generic))?
cc-by-sa 85 commons creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd 85 commons creative commons attribution no ?deriv(?:ative)?s?(?: [1234] [05])?
cc-by-nc 85 commons creative commons attribution non ?commercial(?: [1234] [05])?(?! (?:share|no ?deriv))
cc-by-nc-sa 86 commons creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd 86 commons creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?
cc-by 80 cc cc by [1234] [05]
cc-by-sa 81 cc cc by sa(?: [1234] [05])?
cc-by-nd 81 cc cc by nd(?: [1234] [05])?
cc-by-nc 80 cc cc by nc(?: [1234] [05])?(?! (?:sa|nd))
cc-by-nc-sa 82 cc cc by nc sa(?: [1234] [05])?
cc-by-nc-nd 82 cc cc by nc nd(?: [1234] [05])?
cc-by 87 creativecommons creativecommons org licenses by [1234] [05]
cc-by-sa 87 creativecommons creativecommons org licenses by sa [1234] [05]
cc-by-nd 87 creativecommons creativecommons org licenses by nd [1234] [05]
cc-by-nc 87 creativecommons creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa 87 creativecommons creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd 87 creativecommons creativecommons org licenses by nc nd [1234] [05]
public-domain 75 dedicated dedicated to the public domain
public-domain 75 dedication public domain dedication
public-domain 75 placed (?:has been|is hereby|hereby) placed in(?:to)? the public domain
public-domain 80 copyright the author(?:s)? (?:hereby )?disclaims? copyright to this source code
proprietary 70 confidential proprietary and confidential
proprietary 80 prohibited unauthorized (?:copying|use|distribution) of this (?:file|software|program).{0,60} is strictly prohibited
proprietary 75 eula end user licen[cs]e agreement .{0,20}eula
proprietary 60 reserved all rights reserved
"""
